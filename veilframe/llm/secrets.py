"""Secret scans with patterns and character Markov models, in DataFrame expressions only.

Patterns find assigned passwords, access keys and hexadecimal runs.  Other long
tokens are scored by the log-likelihood ratio of two first-order Markov models of
characters: random strings and ordinary identifiers.  Both are trained on all
documents: random strings are what the patterns find and encoded digests of numbers;
ordinary ones are tokens of other text too short to be scored
(a longer one bears no label).

A place in a text is a sum over the pieces before it, taken in a window over the
matches of a text, so that texts without a match are never split.
"""

from math import log

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from veilframe.llm import common

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"                # longest runs, so the same as runs of any length that are long enough
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
BASE = KINDS[:3]
LEAST = {"assign": 8, "access": 16, "hex": 32, "random": 20}

FIRST, CODES = 43, 80                 # characters from + to z
SAMPLES = 4000                        # encoded digests among the random strings
SMOOTHING = 0.5
PER_CHARACTER = 0.4                   # nats of evidence a token needs, for each character


def _found(text: Column, pattern: str, group: int, body: bool) -> Column:
    """Array of (gap before the match, its length, length of the group, the match), in characters."""
    one = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    zipped = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.char_length).alias("gap"), F.transform(one(0), F.char_length).alias("len"),
                          F.transform(one(group), F.char_length).alias("size"), (one(0) if body else F.transform(one(0), lambda x: F.lit(None).cast("string"))).alias("body"))
    return F.filter(zipped, lambda x: x["len"].isNotNull())


def _may_assign(text: Column) -> Column:
    lower = F.lower(text)
    return lower.contains("passw") | lower.contains("secret") | lower.contains("token") | lower.contains("apikey") | lower.contains("api_key")


def _scan(docs: DataFrame) -> DataFrame:
    """uid, doc_id and the matches of each kind; a quick test keeps texts without one away from the patterns."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named, token = _may_assign(text), text.rlike(TOKEN.replace(",}", "}"))
    return common.with_row_id(docs.select("doc_id", "text")).select(
        "uid", "doc_id", F.when(named, _found(text, ASSIGN, 2, False)).alias("assign"), F.when(text.contains("AKIA"), _found(text, ACCESS, 0, False)).alias("access"),
        F.when(token, _found(text, HEX, 0, False)).alias("hex"), F.when(token, _found(text, TOKEN, 0, True)).alias("random"))


def _places(scanned: DataFrame) -> DataFrame:
    """(uid, kind, start, end, size, body) of every match."""
    parts = [scanned.where(F.size(k) > 0).select("uid", F.lit(i).alias("kind"), F.posexplode(k).alias("i", "m")) for i, k in enumerate(KINDS)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    before = Window.partitionBy("uid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    every = every.withColumn("end", F.sum(F.col("m.gap") + F.col("m.len")).over(before))
    return every.select("uid", "kind", (F.col("end") - F.col("m.len")).alias("start"), "end", F.col("m.size").alias("size"), F.col("m.body").alias("body")) \
        .where(F.col("size") >= F.element_at(F.array(*[F.lit(LEAST[k]) for k in KINDS]), F.col("kind") + 1))


def _bigrams(tokens: DataFrame) -> DataFrame:
    """(a, b, n): counts of neighbouring characters in the column ``token``, each token counted ``n`` times."""
    at = F.explode(F.sequence(F.lit(1), F.char_length("token") - 1)).alias("i")
    pairs = tokens.where(F.char_length("token") > 1).select("token", "n", at).select(F.substring("token", F.col("i"), F.lit(2)).alias("ab"), "n")
    return pairs.groupBy("ab").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame) -> list[float]:
    """Log-likelihood ratios of all pairs of characters, random against ordinary: CODES x CODES numbers."""
    spark = docs.sparkSession
    texts = docs.where("text is not null").select(F.col("text").cast("string").alias("text"))
    named, access, hexed = _may_assign(F.col("text")), F.col("text").contains("AKIA"), F.col("text").rlike(HEX)
    rest = F.when(named, F.regexp_replace("text", ASSIGN, " ")).otherwise(F.col("text"))
    rest = F.when(access | hexed | named, F.regexp_replace(F.regexp_replace(rest, ACCESS, " "), HEX, " ")).otherwise(F.col("text"))
    ordinary = texts.select(F.explode(F.regexp_extract_all(rest, F.lit("[A-Za-z0-9+/_=-]{4,}"), F.lit(0))).alias("token")) \
        .where(F.char_length("token") < LEAST["random"]).groupBy("token").agg(F.count("*").alias("n"))
    known = texts.where(named | hexed).select(F.explode(F.concat(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all("text", F.lit(HEX), F.lit(0)))).alias("token")) \
        .select(F.substring("token", 1, 64).alias("token"), F.lit(1).alias("n"))
    digest = F.sha2(F.col("id").cast("string"), 256)
    made = spark.range(SAMPLES).select(F.when(F.col("id") % 4 == 0, digest).otherwise(F.regexp_replace(F.base64(F.unhex(digest)), "=", "")).alias("token"), F.lit(1).alias("n"))
    counts = _bigrams(ordinary).withColumn("random", F.lit(False)).unionByName(_bigrams(known.unionByName(made)).withColumn("random", F.lit(True)))
    table = {True: [[SMOOTHING] * CODES for _ in range(CODES)], False: [[SMOOTHING] * CODES for _ in range(CODES)]}
    for r in counts.collect():                                # two tables of at most CODES x CODES pairs
        a, b = (ord(c) - FIRST for c in r["ab"])
        if 0 <= a < CODES and 0 <= b < CODES:
            table[r["random"]][a][b] += r["n"]
    rows = {k: [[log(x / sum(row)) for x in row] for row in m] for k, m in table.items()}
    return [round(x - y, 4) for one, other in zip(rows[True], rows[False]) for x, y in zip(one, other)]


def _evidence(token: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio over the token's neighbouring characters."""
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))

    def step(acc, ch):
        code = F.ascii(ch) - FIRST
        return F.struct(code.alias("last"), (acc["sum"] + F.when(acc["last"] >= 0, F.element_at(table, acc["last"] * CODES + code + 1)).otherwise(0.0)).alias("sum"))
    return F.aggregate(F.filter(F.split(token, ""), lambda x: x != ""), start, step, lambda acc: acc["sum"]) / (F.char_length(token) - 1)


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row for each document: uid, doc_id and ``found``, its spans (kind, start, end) by start and kind.

    Places count code points, the end is exclusive.  Null texts are empty.  A token
    of the models' kind is left out where a pattern's span overlaps it.  Other
    columns of ``docs`` are not used, and repeated ids stay rows of their own.
    """
    scanned = common.stage(_scan(docs), "secret-matches")
    places = _places(scanned)
    base = places.where(F.col("kind") < len(BASE)).select("uid", "kind", "start", "end")
    ratios = learn(docs)
    scored = places.where((F.col("kind") == len(BASE)) & (_evidence(F.col("body"), ratios) >= PER_CHARACTER)).select("uid", "kind", "start", "end")
    pattern = F.col("kind") < len(BASE)
    before = Window.partitionBy("uid").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("uid").orderBy(F.desc("start"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    every = base.unionByName(scored).withColumn("left", F.max(F.when(pattern, F.col("end"))).over(before)) \
        .withColumn("right", F.min(F.when(pattern, F.col("start"))).over(after))
    free = every.where(pattern | ((F.coalesce("left", F.lit(0)) <= F.col("start")) & (F.coalesce("right", F.col("end")) >= F.col("end"))))
    spans = free.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    name = F.array(*map(F.lit, KINDS))
    spans = spans.select("uid", F.transform("spans", lambda x: F.struct(F.element_at(name, x["kind"] + 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("found"))
    none = F.array().cast("array<struct<kind: string, start: bigint, end: bigint>>")
    return scanned.select("uid", "doc_id").join(spans, "uid", "left").withColumn("found", F.coalesce("found", none))


def has_secret(text: Column, ratios: list[float]) -> Column:
    """Whether ``find_secrets`` finds anything in a text, told within its row; ``ratios`` come from ``learn``."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    named, token = _may_assign(text), text.rlike(TOKEN.replace(",}", "}"))
    assigned = F.exists(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.char_length(v) >= LEAST["assign"])
    scored = F.exists(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: _evidence(t, ratios) >= PER_CHARACTER)
    return text.rlike(rf"AKIA[A-Z0-9]{{{LEAST['access'] - 4},}}") | F.when(named, assigned).otherwise(False) \
        | F.when(token, text.rlike(HEX) | scored).otherwise(False)


def without_secrets(docs: DataFrame) -> DataFrame:
    """The documents in which ``find_secrets`` finds nothing; no row leaves its partition."""
    return docs.where(~has_secret(F.col("text"), learn(docs.select("text"))))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    out = find_secrets(common.read(spark, sf_dir, "documents", "doc_id", "text"))
    joined = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("found", lambda x: x["kind"] != KINDS[-1])
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return out.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined("found").alias("spans"))
