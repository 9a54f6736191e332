"""Benchmark decontamination by winnowing.

Every ``WINDOW`` consecutive words of a text hold ``WINDOW - GRAM + 1`` grams, of
which the one with the smallest hash (the last among equals) is the fingerprint.
Equal windows have equal fingerprints.  Fingerprints of documents pass a bitmap of
the benchmark's (2 MB at any size of the benchmark); those that do are extended to
the windows that chose them, which are joined with the benchmark's as texts, so a
gram that stands everywhere in other surroundings joins nothing.  Windows next to
each other make longer spans.  An item with fewer words than a window is one gram,
looked up at every place.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from veilframe.llm import common, words as W

WINDOW, GRAM = 10, 5
REACH = WINDOW - GRAM               # places of a gram in a window, less one
BITMAP_BITS = 1 << 24

_HIT = "struct<fp: bigint, start: int, said: string>"


def _chosen(h: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, fingerprint) of every window of a text: the least of its grams."""
    g = W.grams(h, GRAM)
    n = len(h) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    best, step = g[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, REACH + 1):
        other = g[j:j + n]
        better = other <= best
        best[better] = other[better]
        step[better] = j
    inside = np.arange(n) + WINDOW <= last[:n]
    at = np.flatnonzero(inside)
    return at, g[(np.arange(n) + step)[inside]]


def _hits(w: W.Words, lengths: list[int], bitmap: np.ndarray | None) -> list[list[dict]]:
    """For each text its fingerprints, those in the bitmap if there is one, with the windows that chose them."""
    h, last = w.hashes(), w.last()
    text = w.text_of()
    at, fp = _chosen(h, last)
    found = [(WINDOW, at, fp)]
    for k in lengths:
        g = W.grams(h, k, 1)
        at = np.flatnonzero(np.arange(len(g)) + k <= last[:len(g)])
        found.append((k, at, g[at]))
    out: list[list[dict]] = [[] for _ in range(len(w.first) - 1)]
    for k, at, fp in found:
        if bitmap is not None:
            bit = fp & np.uint64(BITMAP_BITS - 1)
            seen = (bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
            at, fp = at[seen], fp[seen]
        for p, f in zip(at.tolist(), fp.view(np.int64).tolist()):
            t = text[p]
            out[t].append({"fp": f, "start": p - int(w.first[t]), "said": " ".join(w.word(j) for j in range(p, p + k))})
    return out


def _benchmark(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes of items with the same words, their ids) and (fingerprints of each class), staged."""
    def make():
        def f(piece):
            w = W.words(piece.column("text"), W.ALNUM, W.LOWER)
            said = [" ".join(w.word(j) for j in range(a, z)) for a, z in zip(w.first, w.first[1:])]
            return {"item_id": piece.column("item_id"), "said": pa.array(said, pa.string())}
        return f
    named = common.map_pieces(items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")),
                              "text", make, "item_id string, said string").where("said <> ''")
    named = common.stage(named.select(F.sha2("said", 256).alias("class"), "item_id", "said"), "benchmark-words")

    def fingerprints():
        def f(piece):
            w = W.words(piece.column("said"), W.ALNUM)
            counts = w.counts.tolist()
            hits = _hits(w, [], None)
            for k in sorted({n for n in counts if n < WINDOW}):
                for t, own in enumerate(_hits(w, [k], None)):
                    hits[t] += own if counts[t] == k else []
            return {"class": piece.column("class"), "n": pa.array(counts, pa.int32()), "hits": pa.array(hits, pa.list_(_ARROW_HIT))}
        return f
    prints = common.map_pieces(named.groupBy("class").agg(F.first("said").alias("said")), "said", fingerprints,
                               f"class string, n int, hits array<{_HIT}>")
    prints = prints.select("class", "n", F.inline("hits"))
    return named.select("class", "item_id"), common.stage(common.few_files(prints, named.count()), "benchmark-fingerprints")


_ARROW_HIT = pa.struct([("fp", pa.int64()), ("start", pa.int32()), ("said", pa.string())])


def _bitmap(prints: DataFrame) -> np.ndarray:
    """One bit for each value of a fingerprint's low bits: at most 2 MB come to the driver, whatever the benchmark's size."""
    bit = prints.select(F.expr(f"(fp & {BITMAP_BITS - 1}L) + 1").alias("bit"))        # SQL's bitmaps count from 1
    parts = bit.groupBy(F.expr("bitmap_bucket_number(bit)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("bits"))
    bits = np.zeros(BITMAP_BITS // 8, np.uint8)
    for row in parts.collect():
        at = (row["bucket"] - 1) * 4096
        bits[at:at + 4096] |= np.frombuffer(bytes(row["bits"]), np.uint8)
    return bits


def _marked(docs: DataFrame, prints: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The columns in ``keep``, n_words, and the fingerprints of ``text`` that pass the benchmark's bitmap."""
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(prints))
    lengths = [r["n"] for r in prints.where(F.col("n") < WINDOW).select("n").distinct().collect()]     # at most nine
    kinds = dict(docs.dtypes)

    def make():
        def f(piece):
            w = W.words(piece.column("text"), W.ALNUM, W.LOWER)
            return {c: piece.column(c) for c in keep} | {"n_words": pa.array(w.counts, pa.int64()),
                                                         "hits": pa.array(_hits(w, lengths, bitmap.value), pa.list_(_ARROW_HIT))}
        return f
    return common.map_pieces(docs, "text", make, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + f", n_words bigint, hits array<{_HIT}>")


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents in which ``decontaminate`` finds no item, with their columns as they are.

    Texts are winnowed once and written with their fingerprints.  Most have none in
    the bitmap and are not looked at again; the others are confirmed by the join, and
    stay if clean.  Null and wordless texts stay, and repeated rows are judged one by one.
    """
    _, prints = _benchmark(items)
    columns = [F.col(f"`{c}`").alias(f"c{i}__") for i, c in enumerate(docs.columns)]
    plain = docs.select(*columns, F.col("text").cast("string").alias("text"))
    marked = _marked(plain, prints, tuple(plain.columns[:-1]))
    back = [F.col(f"c{i}__").alias(c) for i, c in enumerate(docs.columns)]
    staged = common.stage(common.with_row_id(marked.drop("n_words")), "marked")
    found = _windows(staged.select("uid", F.inline("hits")), prints).select("uid").distinct()
    clean = staged.where(F.size("hits") > 0).join(found, "uid", "left_anti")
    return staged.where(F.size("hits") == 0).select(*back).unionByName(clean.select(*back))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each document: uid, doc_id, n_words, n_hit, items (sorted ids of the items found).

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are
    left alone.  A null or wordless text has no words and no hits.  Rows that
    share a doc_id are judged one by one.  Items with the same words are one
    class until the end, so that copies of an item cost nothing.  Items without
    an id count for hits, but cannot be listed.  Texts of any length are read whole.
    """
    classes, prints = _benchmark(items)
    named = common.with_row_id(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    found = common.stage(_marked(named, prints, ("uid", "doc_id")), "document-fingerprints")
    spans = common.stage(_windows(found.select("uid", F.inline("hits")), prints), "spans")
    hit = spans.select("uid", "start", "end").distinct() \
        .select("uid", F.explode(F.sequence("start", F.col("end") - 1)).alias("at")).distinct() \
        .groupBy("uid").agg(F.count("*").alias("n_hit"))
    listed = spans.select("uid", "said").distinct().join(prints.select("said", "class").distinct(), "said").select("uid", "class").distinct() \
        .join(classes.where("item_id is not null").distinct(), "class") \
        .groupBy("uid").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    return found.select("uid", "doc_id", "n_words").join(hit, "uid", "left").join(listed, "uid", "left").select(
        "uid", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _windows(found: DataFrame, prints: DataFrame) -> DataFrame:
    """(uid, start, end, said) of windows that stand in the benchmark, from (uid, fp, start, said).

    Windows are compared as whole texts, each once for all items that hold it.
    """
    found = common.stage(found, "extended")
    counts = found.groupBy("said").agg(F.count("*").alias("n")).join(prints.select("said").distinct(), "said")
    both = common.join_spread(found, common.stage(common.few_files(counts, prints.count()), "shared-windows"), "said", "n")
    return both.select("uid", "start", (F.col("start") + F.size(F.split("said", " "))).alias("end"), "said")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    out = decontaminate(common.read(spark, sf_dir, "documents", "doc_id", "text"), common.read(spark, sf_dir, "benchmark", "item_id", "text"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                      F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP2_SQL = r"""
with d as (select row_number() over () as uid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (select distinct item_id, least(10, len(w)) as k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as g from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)),
ks as (select distinct k from bw),
dw as (select uid, i, k, array_to_string(w[i:i + k - 1], ' ') as g from (select uid, w, k, unnest(range(1, len(w) - k + 2)) as i from d, ks where len(w) >= k)),
m as (select distinct uid, i, bw.k as k, item_id from dw join bw on dw.g = bw.g and dw.k = bw.k),
h as (select uid, count(distinct p) as n_hit from (select uid, unnest(range(i, i + k)) as p from m) group by uid),
t as (select uid, count(*) as n_items, string_agg(s, ',' order by s) as ids from (select distinct uid, cast(item_id as varchar) as s from m) group by uid)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (uid) left join t using (uid)
"""
