"""Connected components of a graph given as a table of links."""

from pyspark.sql import DataFrame, functions as F

from veilframe.llm import common


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, component): the smallest node that each linked node reaches, from links (a, b) of whole numbers, about ``rows`` if that is known.

    Alternates two steps until nothing changes: every node hands its smallest
    neighbour to its larger neighbours, then to its smaller ones.  Rounds grow
    with the logarithm of the longest chain; each is written out, so none depends
    on executors of the one before.
    """
    now = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = common.stage(now if rows is None else common.few_files(now, rows), "links")
    rows, before = now.count(), None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(now.groupBy("a").agg(F.min("b").alias("b"))).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = common.stage(common.few_files(small.where("a <> b").distinct(), rows), "links")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        rows, before = state[0], state
    return now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node") \
        .unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
