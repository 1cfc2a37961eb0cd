"""Command line: index, tokenize, featsel, scanner, model, detect, score.

The commands hand on their work in a model directory: paths, lang_index and domain_index as CSV,
term_lang, term_domain and features as Parquet, features also as text, and the model's own tables.
"""

from __future__ import annotations

import argparse
import logging
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.corpus import index_corpus
from .operators.detect import check_orders, detect, score
from .operators.matching import class_totals
from .operators.model import Model, build_model, number_features
from .operators.selection import select_features, selection_stats
from .operators.tokens import NGrams, Prager, Scanner, byte_count, sampled, term_counts
from .plans.shipping import ship_package
from .sources import corpora, sinks

log = logging.getLogger(__name__)


def session(args: argparse.Namespace) -> SparkSession:
    builder = SparkSession.builder.appName("tonguemix").config("spark.ui.enabled", "false")
    if args.jobs:
        builder = builder.master(f"local[{args.jobs}]")
    if args.temp:
        builder = builder.config("spark.local.dir", args.temp)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def corpus(spark: SparkSession, path: str) -> DataFrame:
    return corpora.read_directory(spark, path) if os.path.isdir(path) else corpora.read_path_list(spark, path)


def indexed(spark: SparkSession, model: str) -> DataFrame:
    """doc_id, domain_id, lang_id, path, data of the indexed paths."""
    paths = corpora.read_index(spark, f"{model}/paths", corpora.PATHS)
    listed = [r.path for r in paths.select("path").collect()]  # the reader takes the list of its files
    files = spark.read.format("binaryFile").load(listed).select(F.regexp_replace("path", "^file:", "").alias("path"), F.col("content").alias("data"))
    return paths.withColumn("doc_id", F.col("path")).join(files, "path")


def c_index(args: argparse.Namespace) -> None:
    spark = session(args)
    model = args.model or f"./{os.path.basename(args.corpus.rstrip('/'))}.model"
    found = index_corpus(corpus(spark, args.corpus), langs=args.lang, domains=args.domain, min_domain=args.min_domain, proportion=args.proportion)
    sinks.write_index(found, model)
    log.info("wrote the index to %s", model)


def c_tokenize(args: argparse.Namespace) -> None:
    spark = session(args)
    items = indexed(spark, args.model)
    log.info("%s bytes", byte_count(items).first().n_bytes)
    if args.scanner:
        tokenizer = Scanner([bytes(r.term) for r in spark.read.parquet(args.scanner).collect()])
    elif args.prager:
        tokenizer = Prager(args.order, args.words)
    else:
        tokenizer = NGrams(args.min_order, args.max_order)
    taken = sampled(items, args.sample_size, args.sample_count)
    for name, by in (("term_lang", "lang_id"), ("term_domain", "domain_id")):
        term_counts(taken, tokenizer, by).write.mode("overwrite").parquet(f"{args.model}/{name}")


def c_featsel(args: argparse.Namespace) -> None:
    spark = session(args)
    counts = spark.read.parquet(f"{args.model}/term_lang")
    chosen = select_features(counts, k=args.k, count=args.count)
    sinks.write_features(chosen, args.features or f"{args.model}/features.txt")
    log.info("selected %s of %s terms (%s)", *selection_stats(counts, chosen).first())


def c_scanner(args: argparse.Namespace) -> None:
    spark = session(args)
    source = args.input
    if not args.input.endswith(".txt") and os.path.isdir(f"{args.input}/features.txt"):
        source = f"{args.input}/features.txt"
    number_features(corpora.read_features(spark, source)).write.mode("overwrite").parquet(args.output or f"{os.path.dirname(source.rstrip('/'))}/features")


def c_model(args: argparse.Namespace) -> None:
    spark = session(args)
    features = spark.read.parquet(args.scanner or f"{args.model}/features")
    langs = corpora.read_index(spark, f"{args.model}/lang_index", corpora.LANGS).select("lang_id", "lang")
    ftc = class_totals(indexed(spark, args.model), features).persist()
    build_model(features, ftc, langs).save(args.output or f"{args.model}/model")


def _show(results: DataFrame, value: str, output: str | None) -> None:
    if output:
        sinks.write_json_lines(results, value, output)
    else:
        for row in sinks.json_lines(results, value).toLocalIterator():
            print(row.value)


def c_detect(args: argparse.Namespace) -> None:
    check_orders(args.topn, args.max_order)
    spark = session(args)
    detector = Model.load(spark, args.model).detector(args.topn, args.max_order)
    if args.docs:
        _show(detect(corpora.read_files(spark, args.docs), detector), "langs", args.output)
    elif sys.stdin.isatty():
        try:
            while True:
                print(detector.detect(input(">>> ")))
        except (EOFError, KeyboardInterrupt):
            pass
    elif args.line:
        for line in sys.stdin.buffer:
            print(detector.detect(line))
    else:
        print(detector.detect(sys.stdin.buffer.read()))


def c_score(args: argparse.Namespace) -> None:
    spark = session(args)
    _show(score(corpora.read_files(spark, args.docs), Model.load(spark, args.model).detector()), "score", args.output)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tonguemix", description=__doc__)
    top.add_argument("-v", "--verbose", action="store_true")
    top.add_argument("-j", "--jobs", type=int, help="threads of a local session")
    top.add_argument("-t", "--temp", help="directory for what Spark spills")
    commands = top.add_subparsers(required=True)

    def command(name: str, run, **options) -> argparse.ArgumentParser:
        p = commands.add_parser(name, **options)
        p.set_defaults(run=run)
        return p

    p = command("index", c_index, help="index a corpus: a directory domain/lang/file, or a file that lists paths")
    p.add_argument("-p", "--proportion", type=float, default=1.0)
    p.add_argument("-m", "--model")
    p.add_argument("-d", "--domain", action="append")
    p.add_argument("-l", "--lang", action="append")
    p.add_argument("--min_domain", type=int, default=1)
    p.add_argument("corpus")
    p = command("tokenize", c_tokenize, help="count terms by language and by domain")
    kind = p.add_mutually_exclusive_group(required=True)
    kind.add_argument("--ngram", action="store_true")
    kind.add_argument("--prager", action="store_true")
    kind.add_argument("--scanner", help="a table of features")
    for name, default in (("min_order", 1), ("max_order", 4), ("order", 4), ("sample_size", 140), ("sample_count", None), ("buckets", 64), ("chunksize", 50)):
        p.add_argument(f"--{name}", type=int, default=default, help="without effect: Spark deals out the work" if name in ("buckets", "chunksize") else None)
    p.add_argument("--words", action="store_true")
    p.add_argument("model")
    p = command("featsel", c_featsel, help="choose features")
    p.add_argument("-f", "--features")
    which = p.add_mutually_exclusive_group(required=True)
    which.add_argument("-k", type=float)
    which.add_argument("-c", "--count", type=int)
    p.add_argument("model")
    p = command("scanner", c_scanner, help="number features for matching")
    p.add_argument("-o", "--output")
    p.add_argument("input")
    p = command("model", c_model, help="build the model")
    p.add_argument("-s", "--scanner")
    p.add_argument("-o", "--output")
    p.add_argument("--chunksize", type=int, default=100, help="without effect")
    p.add_argument("--buckets", type=int, default=64, help="without effect")
    p.add_argument("model")
    p = command("detect", c_detect, help="languages of files, or of standard input")
    p.add_argument("-m", "--model", required=True)
    p.add_argument("-t", "--topn", type=int, default=5)
    p.add_argument("-o", "--output")
    p.add_argument("--max_order", type=int, default=1)
    p.add_argument("--line", action="store_true")
    p.add_argument("docs", nargs="*")
    p = command("score", c_score, help="cosines of files with every language")
    p.add_argument("-m", "--model", required=True)
    p.add_argument("-o", "--output")
    p.add_argument("docs", nargs="+")
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.WARNING)
    args.run(args)


if __name__ == "__main__":
    main()
