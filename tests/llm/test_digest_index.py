import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from veilframe.llm import common, digest_index as D


def brute(docs):
    """(doc_id, keep_id, group_size, kept, sha) of each row; rows that are alike share one ``kept``."""
    groups = {}
    for i, (doc, text) in enumerate(docs):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), D.LAST if doc is None else doc, i))
    out = []
    for text, rows in groups.items():
        best = min(rows)
        out += [(docs[i][0], docs[best[2]][0], len(rows), i == best[2], hashlib.sha256(text.encode()).hexdigest()) for _, _, i in rows]
    return sorted(out, key=str)


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id int, text string").selectExpr("*", "'x' as uid", "1 as digest", "2 as size", "map(1, 2) as doc").repartition(3)


def run(spark, docs, index=None, **options):
    index = index or D.DigestIndex(spark, common.new_path(spark, "index"))
    return sorted((tuple(r) for r in D.deduplicate(frame(spark, docs), index, **options).collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)
    said = ["a b c", "ab c", "a\tb\nc", "ÄÖ 漢 \U0001F600", "\U0001F600", "", " \r\n", "\x0b\x0c", " ", " x", "x", "long " * 30_000]
    return [(rng.randrange(1000), rng.choice([*said, None])) for _ in range(120)] + [(None, "x"), (None, "alone"), (None, "alone"), (5, "twice"), (5, "twice")]


@pytest.mark.parametrize("arrivals", (1, 3))
def test_agrees_with_brute_force(spark, arrivals):
    docs = corpus(arrivals)
    assert run(spark, docs, arrivals=arrivals) == brute(docs)


def test_empty_table(spark):
    assert run(spark, []) == [] and run(spark, [], arrivals=2) == []


def test_later_data_meets_the_index(spark):
    path = common.new_path(spark, "index")
    index = D.DigestIndex(spark, path, 8)
    first = [(1, "a b"), (2, "ab"), (3, "c")]
    assert run(spark, first, index) == brute(first)
    assert run(spark, first, index) == brute(first) and index.entries().count() == 2           # again: nothing is appended
    index.close()
    index = D.DigestIndex(spark, path)                                                          # as another session opens it
    assert index.buckets == 8
    later = {r[0]: r[1:4] for r in run(spark, [(4, "ab"), (5, "c c"), (6, " c "), (7, "new"), (0, "a b")], index)}
    assert later == {4: (0, 2, False), 5: (5, 1, True), 6: (6, 1, True), 7: (7, 1, True), 0: (0, 2, True)}
    assert {(r.chars, r.doc) for r in index.standing().collect()} == {(3, 0), (3, 5), (3, 6), (3, 7)} and index.entries().count() == 6


def test_the_index_is_not_shuffled(spark):
    index = D.DigestIndex(spark, common.new_path(spark, "index"))
    groups = spark.range(100).groupBy(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest")).agg(F.max("id").alias("chars"), F.min("id").alias("doc"))
    plan = index.unknown(groups)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SortMergeJoin" in plan
    assert "Exchange" not in index.standing()._jdf.queryExecution().executedPlan().toString()
    buckets = {r[0] for r in index.spark.sql(f"describe extended {index.table}").where("col_name in ('Bucket Columns', 'Sort Columns')").select("data_type").collect()}
    assert buckets == {"[`digest`]"}


def test_hot_keys_and_nulls_in_a_spread_join(spark):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else i) for i in range(4000)], "i int, k int")
    table = rows.groupBy("k").count()
    got = common.join_spread(rows, table, "k", "count").collect()
    assert len(got) == 4000 and all(r["count"] == (1334 if r.k is None else 1) for r in got)
