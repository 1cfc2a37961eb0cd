"""Secret scans: fixed patterns, and a battery of randomness tests over long tokens.

Base spans are matches of three patterns. Beside them every token of MIN_TOKEN or more letters,
digits and signs is read as numbers under the alphabet that its characters infer, and put to three
tests of randomness: chi-squared uniformity over the alphabet, runs above and below the alphabet's
middle, and serial correlation of neighbouring numbers. Their distributions under random characters
are known, so a token that one of them refutes is no secret.

Passing for random is not enough where ordinary names are far more frequent. So the same three
questions are put once more against ordinary words and names: how often symbols coincide, how many
runs of one word or class there are, and how vowels follow one another. Each gives a normal score;
together they are a p-value under "ordinary". Long tokens are few but decide easily, short ones are
many, so false discoveries are held by Benjamini and Hochberg's rule within each stratum of length,
over all tokens of the corpus. The rule only needs counts by stratum and by bin of log p, which is
all that is gathered.

Time is in proportion to the text: positions are summed by chunks of matches, tokens that meet base
spans are told by marks in the text, and texts are masked chunk by chunk.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import stored

#: Kinds in order of rank, their patterns, and the least length of what must be long.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HEAD = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ACCESS, HEX, TOKEN = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}", r"[A-Za-z0-9+/_=-]{20,}"
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH, MIN_TOKEN = 6, 20, 24, 20

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings in the order in which they are inferred, as pattern and alphabet, and of ordinary tokens in them
#: how often two symbols agree, how often a run of words and classes ends at a symbol (0: there is one class alone), whether
#: vowels are looked at, and by what the sum of scores is divided. The rates are those of identifiers and paths in the
#: standard library of Python, 79,000 tokens; the divisors make a score of 2 to 3 as rare as a normal one among them.
ENCODINGS = (
    ("^[0-9]+$", DIGITS, 0.25, 0.0, False, 1.0),
    ("^[0-9a-f]+$", DIGITS + LOWER[:6], 0.13, 0.1, True, 1.5),
    ("^[0-9A-F]+$", DIGITS + UPPER[:6], 0.13, 0.1, True, 1.5),
    ("^[a-z]+$", LOWER, 0.062, 0.0, True, 1.3),
    ("^[A-Z]+$", UPPER, 0.062, 0.0, True, 1.3),
    ("^[A-Z2-7]+=*$", UPPER + DIGITS[2:8], 0.062, 0.05, True, 1.5),
    ("^[0-9a-z]+$", DIGITS + LOWER, 0.062, 0.1, True, 1.5),
    ("^[0-9A-Z]+$", DIGITS + UPPER, 0.062, 0.1, True, 1.5),
    ("^[A-Za-z]+$", UPPER + LOWER, 0.056, 0.145, True, 1.5),
    ("", UPPER + LOWER + DIGITS + "+/", 0.055, 0.25, True, 1.5),
)
#: Signs of the url-safe alphabet and padding as those of the other; runs of a word or a class.
SIGNS, AS_SIGNS, RUN = "-_=", "+//", "[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+"
#: Of ordinary words: how vowels correlate with the next, and how much more coincidences vary than a count; the most that vowels add.
VOWEL_CORRELATION, OVERDISPERSION, MOST_OF_VOWELS = -0.38, 1.6, 3.0
#: The scale and coefficients of polynomial 26.2.17 of Abramowitz and Stegun.
TAIL_SCALE, TAIL = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
#: Each test refutes randomness beyond this normal score on either side (one in a thousand).
REFUTED = 3.29
#: Share of false discoveries; width and number of the bins of -log10 p.
FALSE_DISCOVERIES, BIN, BINS = 0.01, 0.25, 160

SPAN = "array<struct<start:int,end:int,rank:int,text:string>>"
CHUNK = 512  # even: a chunk begins outside a match
#: Signs that the text has no use for, around matches: where the text is split, and where a base span begins or ends.
CUT, MARK = "\u0001", "\u0002"
#: Base matches that lie within one token, and tokens in a text with marks.
INNER, MARKED_TOKEN = f"{ACCESS}|{HEX}", f"[A-Za-z0-9+/_={MARK}-]{{{MIN_TOKEN},}}"


def _let(value: Column, of) -> Column:
    """of(value), with value worked out once."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _chunks(text: Column, pattern: str) -> Column:
    """The text split at its leftmost non-overlapping matches, so that every second part is one; CHUNK parts at a time.

    Each part comes with its length, in which marks do not count.
    """
    parts = F.split(F.regexp_replace(text, pattern, f"{CUT}$0{CUT}"), CUT)
    pairs = F.transform(parts, lambda p: F.struct(p.alias("part"), F.length(F.replace(p, F.lit(MARK), F.lit(""))).alias("long")))
    count = lambda xs: F.ceil(F.size(xs) / CHUNK).cast("int")
    return _let(pairs, lambda xs: F.transform(F.sequence(F.lit(0), count(xs) - 1), lambda i: F.slice(xs, i * CHUNK + 1, F.lit(CHUNK))))


def _located(chunks: Column, rank: int, least: int, size) -> Column:
    """Spans, in code points, of the matches whose size is the least or more.

    Running lengths are summed by chunk and then within chunks, so that a text with very many
    matches does not take time by the square of their number.
    """
    sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, p: a + p["long"]))
    starts = F.aggregate(sums, F.array(F.lit(0)), lambda a, s: F.concat(a, F.array(F.element_at(a, -1) + s)))

    def of_chunk(chunk: Column, start: Column) -> Column:
        empty = F.struct(start.alias("at"), F.lit(False).alias("inside"), F.array().cast(SPAN).alias("found"))

        def step(a: Column, p: Column) -> Column:
            end = a["at"] + p["long"]
            new = F.array(F.struct(a["at"].alias("start"), end.alias("end"), F.lit(rank).alias("rank"), p["part"].alias("text")))
            return F.struct(end.alias("at"), (~a["inside"]).alias("inside"), F.when(a["inside"] & (size(p["part"]) >= least), F.concat(a["found"], new)).otherwise(a["found"]).alias("found"))

        return F.aggregate(chunk, empty, step, lambda a: a["found"])

    return F.flatten(F.zip_with(chunks, F.slice(starts, F.lit(1), F.size(chunks)), of_chunk))


def _value_size(part: Column) -> Column:
    return F.length(F.regexp_replace(part, ASSIGN_HEAD, ""))


def with_candidates(docs: DataFrame, text: str) -> DataFrame:
    """docs with base (spans of the patterns) and tokens (spans for the battery that meet no base span).

    A token meets a base span if and only if there is a mark in it: matches of INNER lie within a
    token, and beside an assignment's ends there is a token's character only if it belongs to one.
    """
    none = F.array().cast(SPAN)
    clean = F.translate(F.coalesce(F.col(text), F.lit("")), CUT + MARK, "��")
    # Kinds whose matches are whole runs are only looked for at sufficient length: shorter runs hold no other match.
    wanted = (("assign", ASSIGN, ASSIGN_VALUE, _value_size), ("access", ACCESS, ACCESS_LENGTH, F.length), ("hex", HEX, HEX_LENGTH, F.length))
    out = docs.withColumn("__clean", clean)
    for rank, (kind, pattern, least, size) in enumerate(wanted):
        chunks = F.col(f"__{kind}_chunks")
        out = out.withColumn(f"__{kind}_chunks", F.when(F.col("__clean").rlike(pattern), _chunks(F.col("__clean"), pattern)))
        out = out.withColumn(f"__{kind}", F.coalesce(F.when(chunks.isNotNull(), _located(chunks, rank, least, size)), none))
    base = F.array_sort(F.transform(F.concat("__assign", "__access", "__hex"), lambda s: F.struct(s["start"], s["rank"], s["end"])))
    out = out.withColumn("base", F.transform(base, lambda s: F.struct(s["start"], s["end"], s["rank"])))
    marked = lambda p, i: F.when((i % 2 == 1) & (_value_size(p["part"]) >= ASSIGN_VALUE), F.concat(F.lit(MARK), p["part"], F.lit(MARK))).otherwise(p["part"])
    assigned = F.array_join(F.flatten(F.transform("__assign_chunks", lambda c: F.transform(c, marked))), "")
    out = out.withColumn("__marked", F.when(F.size("base") == 0, F.col("__clean")).otherwise(F.regexp_replace(F.coalesce(assigned, F.col("__clean")), INNER, f"{MARK}$0{MARK}")))
    out = out.withColumn("__token_chunks", F.when(F.col("__marked").rlike(MARKED_TOKEN), _chunks(F.col("__marked"), MARKED_TOKEN)))
    unmarked = lambda part: F.when(F.contains(part, F.lit(MARK)), -1).otherwise(F.length(part))
    tokens = F.when(F.col("__token_chunks").isNotNull(), _located(F.col("__token_chunks"), 3, MIN_TOKEN, unmarked))
    spare = ("__clean", "__marked", "__token_chunks", *(f"__{k}{x}" for k, *_ in wanted for x in ("", "_chunks")))
    return out.withColumn("tokens", F.coalesce(tokens, none)).drop(*spare)


def _upper_tail(z: Column) -> Column:
    """The normal distribution above z; polynomial 26.2.17 of Abramowitz and Stegun."""
    t = 1 / (1 + F.lit(TAIL_SCALE) * F.abs(z))
    series = sum((F.lit(x) * F.pow(t, F.lit(i)) for i, x in enumerate(TAIL, 1)), F.lit(0.0))
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * series
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _encoding(token: Column) -> Column:
    """struct of what ENCODINGS has of the first pattern that matches, and the token as symbols of the alphabet."""
    kinds = []
    for pattern, alphabet, agree, rate, vowels, divisor in ENCODINGS:
        symbols = F.rtrim(token, F.lit("=")) if "=" in pattern else token if pattern else F.translate(token, SIGNS, AS_SIGNS)
        of = F.struct(
            symbols.alias("symbols"), F.lit(alphabet).alias("alphabet"), F.lit(float(len(alphabet))).alias("letters"), F.lit(agree).alias("agree"),
            F.lit(rate).alias("rate"), F.lit(vowels).alias("vowels"), F.lit(divisor).alias("divisor"),
        )
        kinds.append(F.when(token.rlike(pattern), of) if pattern else of)
    return F.coalesce(*kinds)


def judged(token: Column) -> Column:
    """struct(stratum, bin): the stratum of length and the bin of -log10 p; bin -1 if refuted as random."""

    def with_values(e: Column) -> Column:
        values = F.transform(F.split(e["symbols"], ""), lambda c: (F.instr(e["alphabet"], c) - 1).cast("double"))
        return _let(values, lambda v: _verdict(token, e, v))

    return _let(_encoding(token), with_values)


def _verdict(token: Column, e: Column, values: Column) -> Column:
    symbols, letters = e["symbols"], e["letters"]
    size = F.length(symbols).cast("double")
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    tally = F.transform(F.array_distinct(F.split(symbols, "")), lambda c: (size - F.length(F.replace(symbols, c, F.lit("")))))
    pairs = F.aggregate(tally, F.lit(0.0), lambda a, n: a + n * (n - 1) / 2)
    # Chi-squared over the alphabet, made normal by the cube root.
    chi = (2 * pairs + size) * letters / size - size
    spread = 2 / (9 * (letters - 1))
    uniformity = (F.pow(F.greatest(chi, F.lit(0.0)) / (letters - 1), F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread)
    # Runs above and below the middle of the alphabet, given how many symbols are above.
    above = F.size(F.filter(values, lambda v: 2 * v >= letters)).cast("double")
    runs = 1.0 + F.size(F.filter(F.zip_with(values, F.slice(values, F.lit(2), F.size(values)), lambda a, b: (2 * a >= letters) != (2 * b >= letters)), lambda x: x))
    both = 2 * above * (size - above) / size
    run_score = (runs - 1 - both) / F.sqrt(F.greatest(both * (both - 1), F.lit(0.25)) / (size - 1))
    # Serial correlation, from the last symbol on to the first.
    one, squares = total(values), total(F.transform(values, lambda v: v * v))
    products = total(F.zip_with(values, F.concat(F.slice(values, F.lit(2), F.size(values)), F.slice(values, 1, 1)), lambda a, b: a * b))
    correlation = (size * products - one * one) / F.greatest(size * squares - one * one, F.lit(1.0))
    serial = (correlation + 1 / (size - 1)) * (size - 1) * F.sqrt(size - 2) / size
    refuted = (above == 0) | (above == size) | (F.abs(uniformity) > REFUTED) | (F.abs(run_score) > REFUTED) | (F.abs(serial) > REFUTED)
    # Against ordinary words and names: coincidences by square roots, runs, and vowels after vowels.
    coincidences = 2 * (F.sqrt(e["agree"] * size * (size - 1) / 2 + 0.375) - F.sqrt(pairs + 0.375)) / OVERDISPERSION
    ends = F.size(F.regexp_extract_all(symbols, F.lit(RUN), F.lit(0))) - 1.0
    words = F.when(e["rate"] == 0, 0.0).otherwise((ends - e["rate"] * (size - 1)) / F.sqrt((size - 1) * F.greatest(e["rate"], F.lit(0.01)) * (1 - e["rate"])))
    vowels = size - F.length(F.regexp_replace(symbols, "[aeiouAEIOU]", ""))
    twice = vowels - F.size(F.regexp_extract_all(symbols, F.lit("[aeiouAEIOU]+"), F.lit(0)))
    mean = vowels / size
    known = e["vowels"] & (vowels > 0) & (vowels < size)
    follow = F.when(known, ((twice / (size - 1) - mean * mean) / F.greatest(mean * (1 - mean), F.lit(1e-12)) - VOWEL_CORRELATION) * F.sqrt(size)).otherwise(0.0)
    score = (coincidences + words + F.least(follow, F.lit(MOST_OF_VOWELS))) / e["divisor"]
    bin_ = F.least(F.floor(-F.log10(F.greatest(_upper_tail(score), F.lit(1e-300))) / BIN), F.lit(BINS)).cast("int")
    return F.struct(F.floor(F.log2(F.length(token).cast("double"))).cast("int").alias("stratum"), F.when(refuted, -1).otherwise(F.greatest(bin_, F.lit(0))).alias("bin"))


def with_judgements(candidates: DataFrame) -> DataFrame:
    """Each token as start, end, stratum and bin; its text goes no further."""
    judge = lambda t: F.struct(t["start"], t["end"], judged(t["text"]).alias("as"))
    return candidates.withColumn("tokens", F.transform("tokens", judge))


def least_bins(judgements: DataFrame) -> dict[int, int]:
    """For each stratum of length the least bin that is a discovery, by the rule of Benjamini and Hochberg.

    The table has a row for each stratum and bin, at most 31 times 162 whatever the corpus.
    """
    tally = judgements.select(F.explode("tokens").alias("t")).groupBy("t.as.stratum", "t.as.bin").agg(F.count("*").alias("n"))
    above = Window.partitionBy("stratum").orderBy(F.col("bin").desc())
    tested = tally.withColumn("found", F.sum("n").over(above)).withColumn("all", F.sum("n").over(Window.partitionBy("stratum")))
    most = F.lit(FALSE_DISCOVERIES) * F.col("found") / F.col("all")
    passing = tested.where((F.col("bin") > 0) & (F.pow(F.lit(10.0), -F.col("bin") * BIN) <= most))
    return {r.stratum: r.least for r in passing.groupBy("stratum").agg(F.min("bin").alias("least")).collect()}


def found_spans(least: dict[int, int]) -> Column:
    """base and the tokens that are discoveries, by start, then kind, as start, end and rank."""
    limits = F.create_map(*[F.lit(x) for pair in least.items() for x in pair]) if least else F.lit(None).cast("map<int,int>")
    discovered = F.filter("tokens", lambda t: F.coalesce(t["as"]["bin"] >= F.element_at(limits, t["as"]["stratum"]), F.lit(False)))
    added = F.transform(discovered, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("rank"), t["end"].alias("end")))
    both = F.array_sort(F.concat(F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"))), added))
    return F.transform(both, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["rank"].alias("rank")))


def scan_secrets(docs: DataFrame, *, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, base and spans (arrays of start, end, rank in code points): one row for each row of docs.

    A null or empty text has no spans; null ids and repeated rows pass through; an empty table gives
    no rows. Texts are read once: what is stored between counting and deciding are spans.
    """
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    judgements = stored(with_judgements(with_candidates(chosen, "text")).select("doc_id", "base", "tokens"), "secrets")
    return judgements.select("doc_id", "base", found_spans(least_bins(judgements)).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, *, text="text", n_chars: str | None = "n_chars", mask: str = "[SECRET]") -> DataFrame:
    """docs with its own columns, the spans of its texts replaced by mask (overlapping ones by one), and n_chars set anew.

    Every row stays, repeated ones too; a null text stays null; an empty table gives no rows. Rows are
    stored with their spans while those are counted, so texts are neither scanned twice nor shuffled.
    """
    mine = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    found = with_judgements(with_candidates(docs.select(mine, F.col(text).alias("text")), "text"))
    keyed = stored(found.select("row", "base", "tokens"), "secrets")
    spans = keyed.select("row", F.col("row").getField(text).alias("text"), found_spans(least_bins(keyed)).alias("spans"))
    masked = spans.select("row", F.when(F.size("spans") == 0, F.col("text")).otherwise(_masked(F.col("text"), F.col("spans"), mask)).alias("masked"))
    new = {text: F.col("masked")} | ({n_chars: F.length("masked").cast(docs.schema[n_chars].dataType)} if n_chars in docs.columns else {})
    return masked.select([new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def _masked(text: Column, spans: Column, mask: str) -> Column:
    """text with mask for each union of overlapping spans, which come by start: chunk by chunk of spans, each over its part of the text."""
    last = lambda xs: F.aggregate(xs, F.lit(0), lambda a, s: F.greatest(a, s["end"]))

    def of_chunk(chunk: Column, begin: Column) -> Column:
        def walk(part: Column) -> Column:
            start = F.struct(F.lit("").alias("out"), begin.alias("at"))

            def step(a: Column, s: Column) -> Column:
                kept = F.substring(part, a["at"] - begin + 1, F.greatest(s["start"] - a["at"], F.lit(0)))
                out = F.concat(a["out"], kept, F.when(s["start"] >= a["at"], F.lit(mask)).otherwise(F.lit("")))
                return F.struct(out.alias("out"), F.greatest(a["at"], s["end"]).alias("at"))

            return F.aggregate(chunk, start, step, lambda a: a["out"])

        return _let(F.substring(text, begin + 1, F.greatest(last(chunk) - begin, F.lit(0))), walk)

    count = F.ceil(F.size(spans) / CHUNK).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(spans, i * CHUNK + 1, F.lit(CHUNK)))

    def of_chunks(cs: Column) -> Column:
        begins = F.aggregate(F.transform(cs, last), F.array(F.lit(0)), lambda a, e: F.concat(a, F.array(F.greatest(F.element_at(a, -1), e))))
        return _let(begins, lambda bs: F.concat(F.array_join(F.zip_with(cs, F.slice(bs, F.lit(1), F.size(cs)), of_chunk), ""), F.substring(text, F.element_at(bs, -1) + 1, F.length(text))))

    return _let(chunks, of_chunks)


def _sql() -> str:
    """The same in DuckDB: matches and their places, the battery, the strata, and the digests of op5."""
    d = lambda x: f"{float(x)!r}::DOUBLE"
    folded = {w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")}  # its (?i) would fold other letters too
    either = lambda pattern: pattern.replace("(?i:password|passwd|secret|token|api_?key)", f"(?:{'|'.join(folded.values())})").replace("'", "''")
    wanted = ((either(ASSIGN), ASSIGN_VALUE), (ACCESS, ACCESS_LENGTH), (HEX, HEX_LENGTH), (TOKEN, MIN_TOKEN))
    parts = " UNION ALL ".join(f"SELECT row, {rank} AS rank, {least} AS least, string_split(regexp_replace(t, '{p}', chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS xs FROM d" for rank, (p, least) in enumerate(wanted))
    def pick(given) -> str:
        return "CASE " + " ".join((f"WHEN regexp_matches(x, '{p}') THEN " if p else "ELSE ") + given(p, *v) for p, *v in ENCODINGS) + " END"

    tail = f"exp(-z * z / {d(2)}) / {d(math.sqrt(2 * math.pi))} * ({' + '.join(f'{d(b)} * pow(t, {i})' for i, b in enumerate(TAIL, 1))})"
    kinds = "CASE rank " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"
    written = f"string_agg({kinds} || ':' || start || ':' || stop, ',' ORDER BY start, rank)"
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, translate(coalesce(text, ''), chr(1) || chr(2), '��') AS t FROM documents
), u AS (
  SELECT row, rank, least, unnest(xs) AS x, generate_subscripts(xs, 1) AS i FROM ({parts}) WHERE len(xs) > 1
), s AS (
  SELECT row, rank, least, x, i, (sum(length(x)) OVER (PARTITION BY row, rank ORDER BY i))::BIGINT AS stop FROM u
), m AS (
  SELECT row, rank, x, stop - length(x) AS start, stop FROM s
  WHERE i % 2 = 0 AND length(CASE WHEN rank = 0 THEN regexp_replace(x, '{either(ASSIGN_HEAD)}', '') ELSE x END) >= least
), base AS (
  SELECT * FROM m WHERE rank < 3
), e AS (
  SELECT *, {pick(lambda p, *v: "rtrim(x, '=')" if "=" in p else "x" if p else f"translate(x, '{SIGNS}', '{AS_SIGNS}')")} AS symbols, {pick(lambda p, a, *v: f"'{a}'")} AS alphabet, {pick(lambda p, a, *v: d(len(a)))} AS letters,
         {pick(lambda p, a, agree, *v: d(agree))} AS agree, {pick(lambda p, a, agree, rate, *v: d(rate))} AS rate, {pick(lambda p, a, agree, rate, vowels, *v: str(vowels).lower())} AS by_vowels, {pick(lambda p, *v: d(v[-1]))} AS divisor
  FROM m WHERE rank = 3 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.row = m.row AND b.start < m.stop AND m.start < b.stop)
), v AS (
  SELECT *, length(symbols)::DOUBLE AS size, list_transform(string_split(symbols, ''), lambda c: (instr(alphabet, c) - 1)::DOUBLE) AS vs FROM e
), token AS (
  SELECT *, list_sum(list_transform(list_distinct(string_split(symbols, '')), lambda c: (length(symbols) - length(replace(symbols, c, ''))) * (length(symbols) - length(replace(symbols, c, '')) - 1) / {d(2)}))::DOUBLE AS pairs,
         {d(2)} / (9 * (letters - 1)) AS spread, len(list_filter(vs, lambda v: 2 * v >= letters))::DOUBLE AS above,
         1 + len(list_filter(range(1, len(vs)), lambda i: (2 * vs[i] >= letters) <> (2 * vs[i + 1] >= letters)))::DOUBLE AS runs,
         list_sum(vs) AS one, list_sum(list_transform(vs, lambda v: v * v)) AS squares, list_sum(list_transform(range(1, len(vs) + 1), lambda i: vs[i] * vs[i % len(vs) + 1])) AS products,
         len(regexp_extract_all(symbols, '{RUN}')) - {d(1)} AS ends, (length(symbols) - length(regexp_replace(symbols, '[aeiouAEIOU]', '', 'g')))::DOUBLE AS vowels,
         len(regexp_extract_all(symbols, '[aeiouAEIOU]+'))::DOUBLE AS vowel_runs
  FROM v
), a AS (
  SELECT *, (2 * pairs + size) * letters / size - size AS chi, 2 * above * (size - above) / size AS mixed, vowels / size AS mean,
         (size * products - one * one) / greatest(size * squares - one * one, {d(1)}) AS correlation, by_vowels AND vowels > 0 AND vowels < size AS known
  FROM token
), z AS (
  SELECT *, above = 0 OR above = size OR abs((pow(greatest(chi, {d(0)}) / (letters - 1), {d(1 / 3)}) - (1 - spread)) / sqrt(spread)) > {d(REFUTED)}
           OR abs((runs - 1 - mixed) / sqrt(greatest(mixed * (mixed - 1), {d(0.25)}) / (size - 1))) > {d(REFUTED)}
           OR abs((correlation + 1 / (size - 1)) * (size - 1) * sqrt(size - 2) / size) > {d(REFUTED)} AS refuted,
         (2 * (sqrt(agree * size * (size - 1) / 2 + {d(0.375)}) - sqrt(pairs + {d(0.375)})) / {d(OVERDISPERSION)}
           + CASE WHEN rate = 0 THEN {d(0)} ELSE (ends - rate * (size - 1)) / sqrt((size - 1) * greatest(rate, {d(0.01)}) * (1 - rate)) END
           + least(CASE WHEN known THEN (((vowels - vowel_runs) / (size - 1) - mean * mean) / greatest(mean * (1 - mean), {d(1e-12)}) - {d(VOWEL_CORRELATION)}) * sqrt(size) ELSE {d(0)} END, {d(MOST_OF_VOWELS)})) / divisor AS z
  FROM a
), q AS (
  SELECT row, rank, start, stop, floor(log2(length(x)))::INT AS stratum, refuted, z, 1 / (1 + {d(TAIL_SCALE)} * abs(z)) AS t FROM z
), j AS (
  SELECT *, CASE WHEN refuted THEN -1 ELSE greatest(least(floor(-log10(greatest(CASE WHEN z >= 0 THEN {tail} ELSE 1 - {tail} END, {d(1e-300)})) / {d(BIN)}), {BINS}), 0) END::INT AS bin FROM q
), h AS (
  SELECT stratum, bin, count(*) AS n FROM j GROUP BY stratum, bin
), b AS (
  SELECT stratum, bin, sum(n) OVER (PARTITION BY stratum ORDER BY bin DESC) AS found, sum(n) OVER (PARTITION BY stratum) AS tested FROM h
), l AS (
  SELECT stratum, min(bin) AS least FROM b WHERE bin > 0 AND pow({d(10)}, -bin * {d(BIN)}) <= {d(FALSE_DISCOVERIES)} * found / tested GROUP BY stratum
), f AS (
  SELECT row, rank, start, stop FROM base UNION ALL SELECT row, rank, start, stop FROM j JOIN l USING (stratum) WHERE bin >= least
), g AS (
  SELECT row, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
         {written} FILTER (rank < 3) AS base, {written} AS spans FROM f GROUP BY row
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (row)
"""


SQL = _sql()
