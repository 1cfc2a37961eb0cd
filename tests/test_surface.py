"""Readers, sinks, streaming, the command line, and every registered query."""

import io
import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tonguemix import cli
from tonguemix.operators import corpus, matching, model
from tonguemix.operators import detect as detection
from tonguemix.plans import registry, train
from tonguemix.sources import corpora, sinks
from tonguemix.streaming import lines

TEXTS = {"d1/en/1.txt": "the cat and the dog and the bird", "d2/en/2.txt": "the house and the tree", "d1/de/3.txt": "der hund und die katze und der vogel", "d2/de/4.txt": "das haus und der baum"}


@pytest.fixture
def folder(tmp_path):
    for name, text in TEXTS.items():
        path = tmp_path / "corpus" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return tmp_path


def test_directory_and_list(spark, folder):
    read = corpora.read_directory(spark, str(folder / "corpus"))
    assert sorted((r.domain, r.lang, bytes(r.data).decode()) for r in read.collect()) == sorted((k.split("/")[0], k.split("/")[1], v) for k, v in TEXTS.items())
    (folder / "list").write_text("".join(f"{folder}/corpus/{k}\n\n" for k in TEXTS))
    listed = corpora.read_path_list(spark, str(folder / "list"))
    assert sorted(map(tuple, listed.collect())) == sorted(map(tuple, read.collect()))


def test_index_files(spark, folder):
    index = corpus.index_corpus(corpora.read_directory(spark, str(folder / "corpus")))
    sinks.write_index(index, str(folder / "m"))
    langs = corpora.read_index(spark, str(folder / "m/lang_index"), corpora.LANGS)
    assert sorted(map(tuple, langs.collect())) == [(0, "de", 2), (1, "en", 2)]
    assert corpora.read_index(spark, str(folder / "m/paths"), corpora.PATHS).count() == 4


def test_features_and_weights(spark, folder):
    terms = spark.createDataFrame([(b"b\n",), (b"\xff\x00",), (b"a",)], "term binary")
    sinks.write_features(terms, str(folder / "f"))
    assert [bytes(r.term) for r in corpora.read_features(spark, str(folder / "f")).collect()] == [b"a", b"b\n", b"\xff\x00"]
    weights = spark.createDataFrame([(b"k", 1.0), (b"l", 2.5), (b"n", float("nan"))], "key binary, value double")
    sinks.write_weights(weights, str(folder / "w"))
    assert {bytes(r.key): r["values"] for r in corpora.read_weights(spark, str(folder / "w")).collect()} == {b"k": [1.0], b"l": [2.5], b"n": [0.0]}
    many = spark.createDataFrame([(b"z", [1.0, 2.0]), (b"k", [3.0, 4.0])], "key binary, value array<double>")
    sinks.write_weights(many, str(folder / "v"))
    assert [(bytes(r.key), r["values"]) for r in corpora.read_weights(spark, str(folder / "v")).collect()] == [(b"k", [3.0, 4.0]), (b"z", [1.0, 2.0])]


def trained(spark, folder):
    return train.train(corpora.read_directory(spark, str(folder / "corpus")), train.Settings(count=40))


def test_training_and_threshold(spark, folder):
    built = trained(spark, folder)
    assert built.detector().detect("und der hund") == {"de": 1.0} and built.detector().detect("and the dog") == {"en": 1.0}
    norms = built.prototypes.groupBy("lang_id").agg(F.sum(F.col("w") * F.col("w")).alias("n")).collect()
    assert all(abs(r.n - 1) < 1e-12 for r in norms)
    by_k = train.train(corpora.read_directory(spark, str(folder / "corpus")), train.Settings(k=2.0, count=None, sample_count=3, sample_size=10))
    assert isinstance(by_k, model.Model)


def test_json_and_lines(spark, folder):
    one = trained(spark, folder).detector(max_order=2)
    (folder / "lines.txt").write_text("und der hund\nand the dog\n\n")
    from tonguemix.operators.detect import detect

    found = detect(corpora.read_lines(spark, str(folder / "lines.txt")), one)
    assert found.count() == 3
    sinks.write_json_lines(detect(corpora.read_whole(spark, str(folder / "lines.txt")), one), "langs", str(folder / "out"))
    (line,) = [r.value for r in spark.read.text(str(folder / "out")).collect()]
    got = json.loads(line)
    assert set(got) == {"path", "langs"} and abs(sum(got["langs"].values()) - 1) < 1e-9
    table = spark.createDataFrame([(1, "a\nb\n"), (2, None), (3, "x\n\ny")], "doc_id long, text string")
    assert sorted((r.doc_id, r.line, bytes(r.data)) for r in corpora.lines_of(table).collect()) == [(1, 0, b"a\n"), (1, 1, b"b\n"), (3, 0, b"x\n"), (3, 1, b"\n"), (3, 2, b"y")]


def test_udf_in_sql(spark, folder):
    from tonguemix.operators.detect import detect_udf

    spark.udf.register("languages", detect_udf(trained(spark, folder).detector()))
    rows = spark.sql("SELECT languages(t) AS l FROM VALUES ('und der hund'), ('and the dog'), (NULL) AS v(t)").collect()
    assert sorted(next(iter(r.l)) for r in rows) == ["de", "en", "en"]


def test_stream(spark, folder):
    one = trained(spark, folder).detector()
    (folder / "in").mkdir()
    (folder / "in" / "a.txt").write_text("und der hund\nand the dog\n")
    q = lines.start(lines.line_stream(spark, str(folder / "in")), one, str(folder / "out"), str(folder / "ck"), once=True)
    q.awaitTermination(120)
    got = sorted(json.loads(r.value)["langs"].popitem()[0] for r in spark.read.text(str(folder / "out")).collect())
    assert got == ["de", "en"]


def test_command_line(spark, folder, capsys):
    m = str(folder / "model")
    cli.main(["index", "-m", m, str(folder / "corpus")])
    cli.main(["tokenize", "--ngram", m])
    cli.main(["featsel", "-c", "40", m])
    cli.main(["scanner", m])
    cli.main(["model", m])
    target = str(folder / "corpus/d1/de/3.txt")
    cli.main(["detect", "-m", f"{m}/model", "--max_order", "2", target])
    cli.main(["score", "-m", f"{m}/model", target])
    detected, scored = [json.loads(x) for x in capsys.readouterr().out.strip().splitlines()]
    assert max(detected["langs"], key=detected["langs"].get) == "de" and set(scored["score"]) == {"de", "en"}
    cli.main(["tokenize", "--prager", "--words", "--sample_count", "3", m])
    cli.main(["featsel", "-k", "0.5", m])
    cli.main(["tokenize", "--scanner", f"{m}/features", m])
    with pytest.raises(SystemExit):
        cli.main(["featsel", "-k", "1", "-c", "3", m])


def test_entry(spark):
    found = __spark_entry__.entry(spark)
    assert found.columns == ["doc_id", "lang", "score", "has_features"] and found.count() == 200


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_queries_agree_with_sql(same_as_sql, name):
    same_as_sql(registry.QUERIES[name], registry.ORACLE_SQL[name])


def test_min_domain_over_all_documents(spark, tmp_path):
    """Documents without a label count, and a language in too few domains goes."""
    rows = [(i, f"d{i % 9}", "en") for i in range(18)] + [(100 + i, f"x{i % 7}", "xx") for i in range(40)] + [(300 + i, f"e{i}", "fr") for i in range(8)]
    docs = spark.createDataFrame([(i, "text", lang, source, 4) for i, source, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = registry.QUERIES["min_domain_prune_documents"](spark, str(tmp_path)).collect()
    assert {r.doc_id for r in kept} == {i for i, _, lang in rows if lang == "en" or lang == "fr"}
    index = {r.domain: r.n_docs for r in registry.QUERIES["min_domain_index_documents"](spark, str(tmp_path)).collect()}
    assert index == {d: sum(x[1] == d and x[2] in ("en", "fr") for x in rows) for d in {x[1] for x in rows}}


def test_hidden_files_are_named(spark, folder):
    for name in ("d1/en/_x.txt", "d1/en/.y.txt", "_d/en/z.txt"):
        path = folder / "corpus" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("hidden")
    assert [p.split("/corpus/")[1] for p in corpora.hidden_files(spark, str(folder / "corpus"))] == ["_d/en/z.txt", "d1/en/.y.txt", "d1/en/_x.txt"]
    assert corpora.read_directory(spark, str(folder / "corpus")).count() == len(TEXTS)


def test_model_as_a_string(spark, folder):
    built = trained(spark, folder)
    again = model.Model.from_string(spark, built.to_string())
    texts = corpora.read_directory(spark, str(folder / "corpus"))
    assert sorted(map(str, detection.detect(texts, again.detector()).collect())) == sorted(map(str, detection.detect(texts, built.detector()).collect()))


def test_features_beyond_the_limit_are_joined(spark, folder, monkeypatch):
    built, texts = trained(spark, folder), corpora.read_directory(spark, str(folder / "corpus"))
    index = corpus.index_corpus(texts)
    forms = lambda: [sorted(map(str, df.collect())) for df in (matching.feature_terms(texts, built.features), matching.document_features(texts, built.features), matching.class_totals(index.items, built.features))]
    short = forms()
    monkeypatch.setattr(matching, "MATCHER_LIMIT", 5)
    assert matching.feature_list(built.features) is None and forms() == short


def test_totals_are_flushed(spark, folder, monkeypatch):
    built, items = trained(spark, folder), corpus.index_corpus(corpora.read_directory(spark, str(folder / "corpus"))).items
    whole = sorted(map(tuple, matching.class_totals(items, built.features).collect()))
    monkeypatch.setattr(matching, "HELD", 1)
    assert sorted(map(tuple, matching.class_totals(items, built.features).collect())) == whole


class _Input(io.StringIO):
    def __init__(self, text, tty=False):
        super().__init__(text)
        self.buffer, self.tty = io.BytesIO(text.encode()), tty

    def isatty(self):
        return self.tty


@pytest.mark.parametrize(("options", "tty", "answers"), [([], False, 1), (["--line"], False, 2), ([], True, 2)])
def test_standard_input(spark, folder, monkeypatch, capsys, options, tty, answers):
    """All of it as one document, line by line, and asked for at a terminal; each answer is a line."""
    built = trained(spark, folder)
    built.save(str(folder / "model"))
    monkeypatch.setattr("sys.stdin", _Input("the cat and the dog\nund der hund\n", tty))
    cli.main(["detect", "-m", str(folder / "model"), *options])
    out = [x for x in capsys.readouterr().out.replace(">>> ", "").splitlines() if x]
    assert len(out) == answers and "en" in out[0] and (answers == 1 or "de" in out[1])


UNLABELLED = ("byte_count", "cosine_score", "detect_in_sql", "detect_json", "detect_mono", "detect_tri", "doc_feature_tf", "ftc", "lang_index", "ngram_terms", "prager_word_terms", "record_counts", "sampled_terms", "scanner_terms", "stream_lines")


@pytest.fixture(scope="module")
def unlabelled(spark, tmp_path_factory):
    """Documents some of which lack a language, a source, both, or a text."""
    path = tmp_path_factory.mktemp("unlabelled")
    none, every = F.lit(None).cast("string"), lambda n: F.col("doc_id") % n == 0
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 60")
    docs = docs.withColumns({"lang": F.when(every(5), none).otherwise(F.col("lang")), "source": F.when(every(7), none).otherwise(F.col("source")), "text": F.when(every(11), none).otherwise(F.col("text"))})
    docs.write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.mark.parametrize("name", UNLABELLED)
def test_documents_without_labels(same_as_sql, unlabelled, name):
    same_as_sql(registry.QUERIES[name], registry.ORACLE_SQL[name], unlabelled)


def test_every_document_is_detected(spark, unlabelled):
    assert registry.QUERIES["detect_mono"](spark, unlabelled).count() == spark.read.parquet(f"{unlabelled}/documents.parquet").count()


def test_record_counts(spark):
    rows = spark.createDataFrame([(0, 0, 3), (1, 0, 4)], "doc_id long, feature_id int, tf long")
    sums = spark.createDataFrame([(0, 0, 7)], "feature_id int, lang_id int, n long")
    assert tuple(matching.record_counts(rows, sums).first()) == (7, 7)
    assert tuple(matching.record_counts(rows.limit(0), sums.limit(0)).first()) == (0, 0)
