"""SQL for DuckDB that computes what the queries compute, put together from common table expressions.

Bytes are pairs of hexadecimal digits; n-grams are joined from neighbours by lead().
"""

from __future__ import annotations

TOP, K = 300, 0.5
SPACES = "('20', '09', '0A', '0B', '0C', '0D')"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


#: All documents. Those without a language or a source teach nothing (both are null then), but are detected like the others.
DOC = "doc AS (SELECT doc_id AS key, CASE WHEN source IS NOT NULL THEN lang END AS lang, CASE WHEN lang IS NOT NULL THEN source END AS domain, coalesce(text, '') AS text FROM documents)"
LANGS = "langs AS (SELECT lang, (row_number() OVER (ORDER BY lang) - 1)::INT AS lang_id FROM (SELECT DISTINCT lang FROM doc WHERE lang IS NOT NULL))"


def grams(name: str, columns: str = "key, lang, domain") -> str:
    """name_gram: for each byte of the texts of table name what begins there: g1 to g4; len is the text's length."""
    chars = f"regexp_extract_all(hex(encode(text)), '..')"
    joined = [" || ".join(["x", *[f"lead(x, {k}) OVER w" for k in range(1, n)]]) + f" AS g{n}" for n in range(1, 5)]
    return f"""{name}_byte AS (SELECT {columns}, octet_length(encode(text)) AS len, unnest({chars}) AS x, generate_subscripts({chars}, 1) AS i FROM {name}),
{name}_gram AS (SELECT {columns}, len, i, x, {', '.join(joined)} FROM {name}_byte WINDOW w AS (PARTITION BY key ORDER BY i)),
{name}_occ AS (SELECT * FROM (SELECT {columns}, len, unnest([g1, g2, g3, g4]) AS term FROM {name}_gram) WHERE term IS NOT NULL)"""


def counted(by: str, name: str = "doc") -> str:
    return f"term_{by} AS (SELECT term, {by}, count(*) AS n FROM (SELECT DISTINCT key, {by}, term FROM {name}_occ WHERE len >= 3 AND {by} IS NOT NULL) GROUP BY term, {by})"


SCORED = "scored AS (SELECT term, max(n) AS most, count(*) AS lf FROM term_lang GROUP BY term)"
TOP_TERMS = f"top AS (SELECT term, most / lf::DOUBLE AS score FROM scored ORDER BY score DESC, term LIMIT {TOP})"
FEATURES = "features AS (SELECT term, (row_number() OVER (ORDER BY term) - 1)::INT AS feature_id FROM top)"
TRAINING = [DOC, LANGS, grams("doc"), counted("lang"), SCORED, TOP_TERMS, FEATURES]
FTC = "ftc AS (SELECT feature_id, lang_id, count(*) AS n FROM doc_occ JOIN features USING (term) JOIN langs USING (lang) GROUP BY feature_id, lang_id)"
ILF = "ilf AS (SELECT f.feature_id, f.term, coalesce(lf, 0)::BIGINT AS lf, CASE WHEN coalesce(lf, 0) = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE / lf END AS ilf FROM features f LEFT JOIN (SELECT feature_id, count(*) AS lf FROM ftc GROUP BY feature_id) USING (feature_id))"
#: Languages in which a feature occurs, with ids that have no gaps; what follows knows only these.
PROTOTYPES = """used AS (SELECT lang, lang_id AS old_id, (row_number() OVER (ORDER BY lang_id) - 1)::INT AS lang_id FROM langs WHERE lang_id IN (SELECT lang_id FROM ftc)),
raw AS (SELECT used.lang_id, feature_id, n * ilf AS raw FROM ftc JOIN used ON ftc.lang_id = old_id JOIN ilf USING (feature_id)),
prototypes AS (SELECT lang_id, feature_id, raw / sqrt(sum(raw * raw) OVER (PARTITION BY lang_id)) AS w FROM raw)"""
GRAM = """gramm AS (SELECT a.lang_id AS l1, b.lang_id AS l2, coalesce(dot, 0.0::DOUBLE) AS dot FROM used a CROSS JOIN used b
  LEFT JOIN (SELECT p.lang_id AS l1, q.lang_id AS l2, sum(p.w * q.w) AS dot FROM prototypes p JOIN prototypes q USING (feature_id) GROUP BY p.lang_id, q.lang_id) d ON d.l1 = a.lang_id AND d.l2 = b.lang_id)"""
MODEL = [*TRAINING, FTC, ILF, PROTOTYPES, GRAM]


def detection(name: str, order: int, topn: int = 5) -> list[str]:
    """vectors, norms, dots, candidates and best mixes of the texts of table name, whose n-grams are there."""
    out = [
        f"tf AS (SELECT key, feature_id, count(*) AS tf FROM {name}_occ JOIN features USING (term) GROUP BY key, feature_id)",
        "vectors AS (SELECT key, feature_id, tf * ilf AS v FROM tf JOIN ilf USING (feature_id))",
        "norms AS (SELECT key, sqrt(sum(v * v)) AS norm FROM vectors GROUP BY key)",
        f"""dots AS (SELECT k.key, l.lang_id, l.lang, coalesce(dot, 0.0::DOUBLE) AS dot FROM (SELECT DISTINCT key FROM {name}) k CROSS JOIN used l
  LEFT JOIN (SELECT key, lang_id, sum(v * w) AS dot FROM vectors JOIN prototypes USING (feature_id) GROUP BY key, lang_id) d ON d.key = k.key AND d.lang_id = l.lang_id)""",
        f"cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY dot DESC, lang_id DESC) AS rank FROM dots) WHERE rank <= {topn})",
        "mixes1 AS (SELECT key, 1 AS ord, rank AS r1, 0 AS r2, 0 AS r3, dot AS score, [lang] AS ls, [1.0::DOUBLE] AS ws FROM cand WHERE rank = 1)",
    ]
    if order >= 2:
        out.append("""two AS (SELECT *, CASE WHEN (1 - g12) * (x + y) <> 0 THEN (x - y * g12) / ((1 - g12) * (x + y)) END AS a FROM (
  SELECT c.key, c.rank AS r1, d.rank AS r2, c.lang AS n1, d.lang AS n2, c.dot AS x, d.dot AS y, g.dot AS g12 FROM cand c JOIN cand d ON c.key = d.key AND c.rank < d.rank JOIN gramm g ON g.l1 = c.lang_id AND g.l2 = d.lang_id)),
mixes2 AS (SELECT key, 2 AS ord, r1, r2, 0 AS r3, (a * x + (1 - a) * y) / sqrt(a * a + 2 * a * (1 - a) * g12 + (1 - a) * (1 - a)) AS score, [n1, n2] AS ls, [a, 1 - a] AS ws FROM two WHERE a > 0 AND a < 1)""")
    if order >= 3:
        out.append("""three AS (SELECT *, (1 - g23 * g23) * x + (g23 * g13 - g12) * y + (g12 * g23 - g13) * z AS p, (g23 * g13 - g12) * x + (1 - g13 * g13) * y + (g12 * g13 - g23) * z AS q,
    (g12 * g23 - g13) * x + (g12 * g13 - g23) * y + (1 - g12 * g12) * z AS r FROM (
  SELECT c.key, c.rank AS r1, d.rank AS r2, e.rank AS r3, c.lang AS n1, d.lang AS n2, e.lang AS n3, c.dot AS x, d.dot AS y, e.dot AS z, g.dot AS g12, h.dot AS g23, k.dot AS g13
  FROM cand c JOIN cand d ON c.key = d.key AND c.rank < d.rank JOIN cand e ON d.key = e.key AND d.rank < e.rank
  JOIN gramm g ON g.l1 = c.lang_id AND g.l2 = d.lang_id JOIN gramm h ON h.l1 = d.lang_id AND h.l2 = e.lang_id JOIN gramm k ON k.l1 = c.lang_id AND k.l2 = e.lang_id)),
solved AS (SELECT *, CASE WHEN p + q + r <> 0 THEN p / (p + q + r) END AS a, CASE WHEN p + q + r <> 0 THEN q / (p + q + r) END AS b FROM three),
mixes3 AS (SELECT key, 3 AS ord, r1, r2, r3, (a * x + b * y + (1 - a - b) * z) / sqrt(a * a + b * b + (1 - a - b) * (1 - a - b) + 2 * (a * b * g12 + a * (1 - a - b) * g13 + b * (1 - a - b) * g23)) AS score, [n1, n2, n3] AS ls, [a, b, 1 - a - b] AS ws
  FROM solved WHERE a > 0 AND a < 1 AND b > 0 AND b < 1 AND 1 - a - b > 0 AND 1 - a - b < 1)""")
    union = " UNION ALL ".join(f"SELECT * FROM mixes{i}" for i in range(1, order + 1))
    out.append(f"best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, ord, r1, r2, r3) AS place FROM ({union})) WHERE place = 1)")
    return out


def detect_sql(order: int, name: str = "doc", texts: str | None = None) -> str:
    """key as doc_id, lang, weight of the best mix for texts (SQL for key, text), or for the documents themselves."""
    own = [] if texts is None else [f"{name} AS ({texts})", grams(name, "key")]
    return with_(*MODEL, *own, *detection(name, order)) + "SELECT key AS doc_id, lang, round(weight, 6) AS weight FROM (SELECT key, unnest(ls) AS lang, unnest(ws) AS weight FROM best)"


INDEXED = """item AS (SELECT doc_id, source AS domain, lang FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL),
li AS (SELECT lang, (row_number() OVER (ORDER BY lang) - 1)::INT AS lang_id, n_docs FROM (SELECT lang, count(*) AS n_docs FROM item GROUP BY lang)),
di AS (SELECT domain, (row_number() OVER (ORDER BY domain) - 1)::INT AS domain_id, n_docs FROM (SELECT domain, count(*) AS n_docs FROM item GROUP BY domain))"""
MARKED = """item AS (SELECT doc_id, source AS domain, lang || ':' || coalesce(toxic::VARCHAR, '-') AS lang FROM documents LEFT JOIN labels USING (doc_id) WHERE lang IS NOT NULL AND source IS NOT NULL),
wide AS (SELECT lang FROM (SELECT DISTINCT lang, domain FROM item) GROUP BY lang HAVING count(*) >= {least}), kept AS (SELECT * FROM item WHERE lang IN (SELECT lang FROM wide))"""
#: The same over all documents.
SPREAD = """item AS (SELECT doc_id, source AS domain, lang FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL),
wide AS (SELECT lang FROM (SELECT DISTINCT lang, domain FROM item) GROUP BY lang HAVING count(*) >= {least}), kept AS (SELECT * FROM item WHERE lang IN (SELECT lang FROM wide))"""
GIVEN_LANGS, GIVEN_DOMAINS = ["fr", "xx", "en"], ["src3", "src1", "none"]


def _list(names: list[str]) -> str:
    return "(" + ", ".join(f"'{x}'" for x in names) + ")"


def _given(column: str, names: list[str], id_name: str) -> str:
    values = ", ".join(f"('{x}', {i})" for i, x in enumerate(names))
    return f"""SELECT v.id::INT AS {id_name}, v.name AS {column}, count(doc_id) AS n_docs FROM (VALUES {values}) v(name, id) LEFT JOIN
  (SELECT doc_id, source AS domain, lang FROM documents WHERE lang IN {_list(GIVEN_LANGS)} AND source IN {_list(GIVEN_DOMAINS)}) d ON d.{column} = v.name GROUP BY 1, 2"""


LEAST_DOMAINS = 8
#: Shares that candidates are listed with: at exactly 0 the last digits of sums, which engines order differently, would decide.
CLEAR = "1e-9"
WINDOW_OF_FOUR = "len >= 4 AND g4 IS NOT NULL AND substr(g4, 1, 2) NOT IN {s} AND substr(g4, 3, 2) NOT IN {s} AND substr(g4, 5, 2) NOT IN {s}".format(s=SPACES)
WORDS = f"""runs AS (SELECT key, lang, i, x, sum(CASE WHEN x IN {SPACES} THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY i) AS run FROM doc_byte),
words AS (SELECT key, lang, string_agg(x, '' ORDER BY i) AS term FROM runs WHERE x NOT IN {SPACES} GROUP BY key, lang, run)"""
SAMPLES, SAMPLE = 2, 140
SAMPLED = f"""pos AS (SELECT key, lang, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM doc),
place AS (SELECT key, greatest(1, n - {SAMPLE}) AS places FROM pos),
step AS (SELECT key, list_transform(range(places - least(places, {SAMPLES}), places), lambda j: [j, ('0x' || substr(md5(key || ':' || j || ':0'), 1, 15))::BIGINT % (j + 1)]) AS steps FROM place),
chosen AS (SELECT key, unnest(list_reduce(steps, lambda taken, x: list_append(taken, CASE WHEN list_contains(taken, x[2]) THEN x[1] ELSE x[2] END), []::BIGINT[])) AS p FROM step),
cut AS (SELECT key || ':' || p AS key, lang, regexp_extract_all(substr(h, (2 * p + 1)::INT, {2 * SAMPLE}), '..') AS xs FROM chosen JOIN pos USING (key)),
cut_byte AS (SELECT key, lang, len(xs) AS len, unnest(xs) AS x, generate_subscripts(xs, 1) AS i FROM cut),
cut_gram AS (SELECT key, lang, len, x AS g1, x || lead(x, 1) OVER w AS g2, x || lead(x, 1) OVER w || lead(x, 2) OVER w AS g3, x || lead(x, 1) OVER w || lead(x, 2) OVER w || lead(x, 3) OVER w AS g4 FROM cut_byte WINDOW w AS (PARTITION BY key ORDER BY i)),
cut_occ AS (SELECT * FROM (SELECT key, lang, len, unnest([g1, g2, g3, g4]) AS term FROM cut_gram) WHERE term IS NOT NULL)"""
LINES = """SELECT doc_id || ':' || (line - 1) AS key, body AS text FROM (SELECT doc_id, generate_subscripts(parts, 1) AS line, unnest(parts) AS body FROM
  (SELECT doc_id, list_filter(string_split(replace(coalesce(text, ''), chr(10), chr(10) || chr(1)), chr(1)), lambda x: x <> '') AS parts FROM documents))"""
#: Bytes of what is said in each domain and language, a line feed after each text.
DIRECTORY = "SELECT source AS domain, lang, sum(octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS n_bytes FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2"

SQL = {
    "corpus_items": with_(INDEXED) + "SELECT doc_id, domain, lang, domain_id, lang_id FROM item JOIN li USING (lang) JOIN di USING (domain)",
    "lang_index": with_(INDEXED) + "SELECT lang_id, lang, n_docs FROM li",
    "domain_index": with_(INDEXED) + "SELECT domain_id, domain, n_docs FROM di",
    "coverage": with_(INDEXED) + "SELECT DISTINCT domain, lang FROM item",
    "min_domain_prune": with_(MARKED.format(least=LEAST_DOMAINS)) + "SELECT doc_id, domain, kept.lang, lang_id FROM kept JOIN (SELECT lang, (row_number() OVER (ORDER BY lang) - 1)::INT AS lang_id FROM wide) USING (lang)",
    "min_domain_index": with_(MARKED.format(least=LEAST_DOMAINS)) + "SELECT (row_number() OVER (ORDER BY d.domain) - 1)::INT AS domain_id, d.domain, coalesce(n, 0)::BIGINT AS n_docs FROM (SELECT DISTINCT domain FROM item) d LEFT JOIN (SELECT domain, count(*) AS n FROM kept GROUP BY domain) k USING (domain)",
    "min_domain_prune_documents": with_(SPREAD.format(least=LEAST_DOMAINS)) + "SELECT doc_id, domain, kept.lang, lang_id FROM kept JOIN (SELECT lang, (row_number() OVER (ORDER BY lang) - 1)::INT AS lang_id FROM wide) USING (lang)",
    "min_domain_index_documents": with_(SPREAD.format(least=LEAST_DOMAINS)) + "SELECT (row_number() OVER (ORDER BY d.domain) - 1)::INT AS domain_id, d.domain, coalesce(n, 0)::BIGINT AS n_docs FROM (SELECT DISTINCT domain FROM item) d LEFT JOIN (SELECT domain, count(*) AS n FROM kept GROUP BY domain) k USING (domain)",
    "allow_list": f"SELECT doc_id, source AS domain, lang, (list_position({GIVEN_DOMAINS}, source) - 1)::INT AS domain_id, (list_position({GIVEN_LANGS}, lang) - 1)::INT AS lang_id FROM documents WHERE lang IN {_list(GIVEN_LANGS)} AND source IN {_list(GIVEN_DOMAINS)}",
    "allow_list_langs": _given("lang", GIVEN_LANGS, "lang_id"),
    "allow_list_domains": _given("domain", GIVEN_DOMAINS, "domain_id"),
    "onehot_classmap": "SELECT doc_id, " + ", ".join(f"(lang = '{x}')::INT AS lang_{x}" for x in ("de", "en", "es", "fr")) + " FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL",
    "sample_corpus": "SELECT doc_id, source AS domain, lang FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL AND ('0x' || substr(md5(doc_id || ':7'), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.5",
    "byte_count": "SELECT sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS n_bytes FROM documents",
    "ngram_terms": with_(DOC, grams("doc"), counted("lang")) + "SELECT term, lang, n FROM term_lang",
    "ngram_term_domain": with_(DOC, grams("doc"), counted("domain")) + "SELECT term, domain, n FROM term_domain",
    "prager_terms": with_(DOC, grams("doc")) + f"SELECT g4 AS term, lang, count(DISTINCT key) AS n FROM doc_gram WHERE {WINDOW_OF_FOUR} AND lang IS NOT NULL GROUP BY g4, lang",
    "prager_word_terms": with_(DOC, grams("doc"), WORDS) + f"SELECT term, lang, count(DISTINCT key) AS n FROM (SELECT key, lang, g4 AS term FROM doc_gram WHERE {WINDOW_OF_FOUR} UNION ALL SELECT key, lang, term FROM words WHERE length(term) <> 8 AND length(term) <= 60) WHERE lang IS NOT NULL GROUP BY term, lang",
    "sampled_terms": with_(DOC, SAMPLED, counted("lang", "cut")) + "SELECT term, lang, n FROM term_lang",
    "scanner_terms": with_(*TRAINING) + "SELECT term, lang, count(DISTINCT key) AS n FROM doc_occ JOIN features USING (term) WHERE lang IS NOT NULL GROUP BY term, lang",
    "lang_freq": with_(DOC, grams("doc"), counted("lang"), SCORED) + "SELECT term, lf FROM scored",
    "prager_select_k": with_(DOC, grams("doc"), counted("lang"), SCORED) + f"SELECT term, most, lf FROM scored WHERE most >= {K}::DOUBLE * lf",
    "tfilf_topn": with_(DOC, grams("doc"), counted("lang"), SCORED, TOP_TERMS) + "SELECT term, round(score, 6) AS score FROM top",
    "selection_stats": with_(DOC, grams("doc"), counted("lang"), SCORED, TOP_TERMS) + "SELECT (SELECT count(*) FROM top) AS n_selected, count(*) AS n_total, round((SELECT count(*) FROM top) / count(*)::DOUBLE, 6) AS share FROM scored",
    "doc_feature_tf": with_(*TRAINING) + "SELECT key AS doc_id, feature_id, count(*) AS tf FROM doc_occ JOIN features USING (term) GROUP BY key, feature_id",
    "ftc": with_(*TRAINING, FTC) + "SELECT feature_id, lang_id, n FROM ftc",
    "ilf": with_(*TRAINING, FTC, ILF) + "SELECT feature_id, term, lf, round(ilf, 6) AS ilf FROM ilf",
    "unused_langs": with_(*TRAINING, FTC) + "SELECT lang_id, lang FROM (SELECT * FROM langs UNION ALL SELECT 'none', 99) WHERE lang_id NOT IN (SELECT lang_id FROM ftc)",
    "prototypes": with_(*MODEL) + "SELECT lang_id, feature_id, round(w, 6) AS w FROM prototypes",
    "gram": with_(*MODEL) + "SELECT l1, l2, round(dot, 6) AS dot FROM gramm",
    "query_vectors": with_(*MODEL, *detection("doc", 1)) + "SELECT key AS doc_id, feature_id, round(v, 6) AS v FROM vectors",
    "dot_products": with_(*MODEL, *detection("doc", 1)) + "SELECT key AS doc_id, lang_id, round(dot, 6) AS dot FROM dots",
    "cosine_score": with_(*MODEL, *detection("doc", 1)) + "SELECT key AS doc_id, lang, round(CASE WHEN norm > 0 THEN dot / norm ELSE 'NaN'::DOUBLE END, 6) AS score FROM dots LEFT JOIN norms USING (key)",
    "topn_candidates": with_(*MODEL, *detection("doc", 1, 3)) + "SELECT key AS doc_id, rank::INT AS rank, lang_id, round(dot, 6) AS dot FROM cand",
    "detect_mono": with_(*MODEL, *detection("doc", 1)) + "SELECT key AS doc_id, ls[1] AS lang, round(score, 6) AS score, coalesce(norm, 0) > 0 AS has_features FROM best LEFT JOIN norms USING (key)",
    "bilingual_candidates": with_(*MODEL, *detection("doc", 2)) + f"SELECT key AS doc_id, ls[1] AS lang1, ls[2] AS lang2, round(ws[1], 6) AS a, round(score, 6) AS score FROM mixes2 WHERE least(ws[1], ws[2]) > {CLEAR}",
    "trilingual_candidates": with_(*MODEL, *detection("doc", 3)) + f"SELECT key AS doc_id, ls[1] AS lang1, ls[2] AS lang2, ls[3] AS lang3, round(ws[1], 6) AS a, round(ws[2], 6) AS b, round(score, 6) AS score FROM mixes3 WHERE least(ws[1], ws[2], ws[3]) > {CLEAR}",
    "detect_bi": detect_sql(2),
    "detect_tri": detect_sql(3),
    "detect_relational": detect_sql(3),
    "detect_lines": detect_sql(1, "q", LINES),
    "detect_conversations": detect_sql(2, "q", "SELECT conv_id || ':' || turn AS key, coalesce(text, '') AS text FROM conversations"),
    "detect_pages": detect_sql(2, "q", "SELECT page_id AS key, coalesce(html, '') AS text FROM pages"),
    "detect_benchmark": detect_sql(2, "q", "SELECT item_id AS key, coalesce(text, '') AS text FROM benchmark"),
    "detect_json": with_(*MODEL, *detection("doc", 1)) + "SELECT '{\"path\":\"' || key || '\",\"langs\":{\"' || ls[1] || '\":1.0}}' AS value FROM best",
    "accuracy_confusion": with_(*MODEL, *detection("doc", 1)) + "SELECT doc.lang, ls[1] AS detected, count(*) AS n FROM best JOIN doc USING (key) WHERE doc.lang IS NOT NULL GROUP BY 1, 2",
    "corpus_paths": "SELECT doc_id::VARCHAR AS path FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL",
    "index_paths_file": with_(INDEXED) + "SELECT domain_id, lang_id, doc_id::VARCHAR AS path FROM item JOIN li USING (lang) JOIN di USING (domain)",
    "index_langs_file": with_(INDEXED) + "SELECT lang_id, lang, n_docs FROM li",
    "index_domains_file": with_(INDEXED) + "SELECT domain_id, domain, n_docs FROM di",
    "directory_corpus": DIRECTORY,
    "listed_corpus": DIRECTORY,
    "features_file": with_(*TRAINING) + "SELECT term FROM top",
    "weights_file": with_(*TRAINING, FTC, ILF) + "SELECT term, round(ilf, 6) AS ilf FROM ilf",
    "record_counts": with_(*TRAINING, FTC) + "SELECT (SELECT count(*) FROM doc_occ JOIN features USING (term) WHERE lang IS NOT NULL) AS n_written, (SELECT sum(n) FROM ftc)::BIGINT AS n_read",
    "saved_model": detect_sql(2, "q", "SELECT item_id AS key, coalesce(text, '') AS text FROM benchmark"),
    "model_string": detect_sql(2, "q", "SELECT item_id AS key, coalesce(text, '') AS text FROM benchmark"),
    "detect_in_sql": detect_sql(1),
    "stream_lines": detect_sql(1, "q", LINES),
}
