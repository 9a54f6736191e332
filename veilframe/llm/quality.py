"""Quality rules with cross-document line frequency, in DataFrame expressions only.

Lines are normalised and hashed, and counted over the documents of a host (here
the column ``source``).  Documents are told by a hash of their text, so copies
of a document count once, as they do in the size of the host.  Lines on more documents than a limit are
removed; a document that loses most of its words is rejected, as is one that
fails the rules on its own text.  All that concerns one text alone is computed
within its row.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veilframe.llm import common

BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS, MAX_REPEATED = 20, 30
MIN_DOCUMENTS, MIN_SHARE = 10, 0.001      # a line is boilerplate above this many documents and above this share of its host's
LEAST_LEFT = 0.3                          # share of words that must be left
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _repeated(words: Column) -> Column:
    """Words in windows found twice or more.  Windows are told by 64-bit hashes within one text, sorted to find equal neighbours."""
    def covered(windows: Column) -> Column:
        by_hash = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = _let(by_hash, lambda s: F.filter(F.transform(s, lambda x, k: F.when(
            ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)), x["i"])), lambda p: p.isNotNull()))
        start = F.struct(F.lit(0).alias("to"), F.lit(0).cast("bigint").alias("n"))
        return F.aggregate(F.sort_array(twice), start, lambda acc, p: F.struct(
            (p + WINDOW).alias("to"), (acc["n"] + WINDOW - F.greatest(acc["to"] - p, F.lit(0))).alias("n")), lambda acc: acc["n"])

    windows = F.when(F.size(words) >= WINDOW, F.transform(F.sequence(F.lit(1), F.size(words) - WINDOW + 1), lambda i: F.xxhash64(F.slice(words, i, WINDOW))))
    return F.coalesce(_let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w))), F.lit(0).cast("bigint"))


def _normal(line: Column) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(F.translate(line, UPPER, SMALL), "[0-9]+", "0"), BLANK, " "), F.lit(" "))


def _measure(docs: DataFrame) -> DataFrame:
    """Counts of each text, and its lines as (hash, words), and a hash of the whole."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split(text, BLANK), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    hashes = F.transform(lines, lambda x: F.xxhash64(_normal(x)))
    counts = F.transform(lines, lambda x: F.size(F.filter(F.split(x, BLANK), lambda w: w != "")))
    without = lambda drop: F.char_length(F.translate(text, drop, ""))
    return common.with_row_id(docs.select("doc_id", "text", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"))).select(
        "uid", "doc_id", "host", F.xxhash64(text).alias("digest"), _let(words, lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), _repeated(w).alias("n_repeat_words"))).alias("w"),
        without(BLANKS).cast("bigint").alias("word_chars"), (F.char_length(text) - without(SYMBOLS)).cast("bigint").alias("n_symbols"),
        _let(lines, lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("bigint")).alias("n_dup_lines"),
        F.arrays_zip(hashes.alias("h"), counts.alias("words")).alias("lines"))


def judge(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_share: float = MIN_SHARE, least_left: float = LEAST_LEFT) -> DataFrame:
    """One row for each document: uid, doc_id, the counts, base_failed, ``boilerplate`` (hashes of its lines to remove), n_left, kept.

    Null texts have no words; a null source is a host of its own.  Rows that share a
    doc_id stay rows of their own.  ``without_lines`` applies the removal to a text.
    """
    measured = common.stage(_measure(docs), "line-counts")
    lines = measured.select("uid", "host", "digest", F.inline("lines"))
    seen = lines.groupBy("host", "h", "digest").agg(F.count("*").alias("rows")) \
        .groupBy("host", "h").agg(F.count("*").alias("n"), F.sum("rows").alias("rows")).where(F.col("n") > min_documents)
    sizes = measured.select("host", "digest").distinct().groupBy("host").agg(F.count("*").alias("documents"))
    line = F.concat_ws(":", F.hex("h"), "host").alias("line")
    common_lines = common.stage(seen.join(sizes, "host").where(F.col("n") > min_share * F.col("documents")).select(line, "rows"), "common-lines")
    lost = common.join_spread(lines.select("uid", "h", "words", line), common_lines, "line", "rows").groupBy("uid").agg(F.sum("words").alias("lost"), F.array_sort(F.collect_set("h")).alias("boilerplate"))
    failed = (F.col("w.n_words") < MIN_WORDS) | (100 * F.col("w.n_repeat_words") > MAX_REPEATED * F.col("w.n_words"))
    left = F.col("w.n_words") - F.coalesce("lost", F.lit(0))
    return measured.drop("lines", "digest").join(lost, "uid", "left").select(
        "uid", "doc_id", "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words", failed.alias("base_failed"),
        F.coalesce("boilerplate", F.array().cast("array<bigint>")).alias("boilerplate"), left.alias("n_left"),
        (~failed & (left >= least_left * F.col("w.n_words"))).alias("kept"))


def without_lines(text: Column, boilerplate: Column) -> Column:
    """The text without the lines that have one of the hashes."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(boilerplate, F.xxhash64(_normal(x)))), "\n")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules on every document."""
    return judge(common.read(spark, sf_dir, "documents", "doc_id", "text", "source")).drop("uid", "boilerplate", "n_left")


OP7_SQL = r"""
with d as (select row_number() over () as uid, doc_id, coalesce(source, '') as host, coalesce(text, '') as t from documents),
w as (select uid, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from d),
g as (select uid, i, array_to_string(w[i:i + 7], ' ') as g from (select uid, w, unnest(range(1, len(w) - 6)) as i from w where len(w) >= 8)),
r as (select uid, count(distinct p) as n from (select uid, unnest(range(i, i + 8)) as p from (select uid, i, count(*) over (partition by uid, g) as c from g) where c > 1) group by uid),
l as (select uid, host, i, line from (select uid, host, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as i from d) where regexp_matches(line, '[^\x20\x09-\x0D]')),
n as (select uid, host, i, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) as words, trim(regexp_replace(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') as h from l),
f as (select host, h, count(distinct t) as n from n join d using (uid, host) group by host, h having count(distinct t) > 10),
s as (select host, count(distinct t) as documents from d group by host),
x as (select uid, sum(words) as lost from n join f using (host, h) join s using (host) where f.n > 0.001 * documents group by uid),
u as (select uid, count(*) - count(distinct line) as n_dup_lines from l group by uid),
o as (select doc_id, cast(len(w) as bigint) as n_words, cast(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
  cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines,
  cast(coalesce(r.n, 0) as bigint) as n_repeat_words, len(w) - coalesce(lost, 0) as n_left
  from w left join r using (uid) left join u using (uid) left join x using (uid))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and n_left >= 0.3 * n_words as kept from o
"""
