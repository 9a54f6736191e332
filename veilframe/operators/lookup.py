"""Numbering of distinct values and lookups that survive hot keys."""

from pyspark.sql import Column, DataFrame, functions as F

from veilframe.functions.text import is_blank, named
from veilframe.session import stage

BROADCAST_BYTES = 32 << 20
HOT_SHARE = 1024        # a key with more than 1/1024 of the rows is hot; at most 1024 keys are
SPREAD = 4096


def distinct_first_seen(df: DataFrame, row_key: str, columns: list[str]) -> DataFrame:
    """(column, value, first_key, n_rows) of every distinct value that is not null or blank."""
    cells = df.select(named(row_key).alias("__first_key"), *map(named, columns)).unpivot(
        ["__first_key"], [named(c) for c in columns], "column", "value").where(F.col("value").isNotNull() & ~is_blank(F.col("value")))
    return cells.groupBy("column", "value").agg(F.min("__first_key").alias("first_key"), F.count("*").alias("n_rows"))


def first_seen_numbers(df: DataFrame, row_key: str, columns: list[str]) -> DataFrame:
    """Number the distinct values of each column 1, 2, ... in order of first appearance.

    No task ever holds a whole column: values are range-partitioned by first
    appearance, numbered within their partition, and shifted by the sizes of the
    partitions before it.  The partition of each value is written down, so the
    numbers do not depend on how a lost task is rerun.
    """
    return number_in_order(distinct_first_seen(df, row_key, columns))


def number_in_order(seen: DataFrame) -> DataFrame:
    """Numbers 1, 2, ... within each column for (column, value, first_key, n_rows), in the order of first_key and value."""
    parts = int(seen.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = seen.repartitionByRange(parts, "column", "first_key", "value")
    values = stage(ranged.withColumn("part", F.spark_partition_id()), "distinct")
    sizes = values.groupBy("column", "part").agg(F.count("*").alias("size"))
    # one row per (column, partition): bounded by the number of partitions
    before = sizes.selectExpr(
        "column", "part",
        "sum(size) over (partition by column order by part rows between unbounded preceding and 1 preceding) as before")
    return values.join(F.broadcast(before), ["column", "part"]).selectExpr(
        "column", "value", "n_rows",
        "coalesce(before, 0) + row_number() over (partition by column, part order by first_key, value) as number")


def look_up(df: DataFrame, key: Column, mapping: DataFrame, row_key: str, result: str,
            broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Add ``result`` = payload of ``mapping`` (value, payload, n_rows) for ``key``, or null.

    A mapping of checked small size is broadcast.  A larger one is joined by
    shuffle: the few hot keys (counted, at most ``HOT_SHARE`` of them) are
    answered by broadcast and their rows, like rows without a key, are spread
    over the partitions instead of meeting in one.
    """
    size = mapping.agg(F.coalesce(F.sum(F.octet_length("value") + 64), F.lit(0)).alias("bytes"),
                       F.coalesce(F.sum("n_rows"), F.lit(0)).alias("rows")).first()
    if size["bytes"] <= broadcast_bytes:
        small = mapping.select(F.col("value").alias("__value"), F.col("payload").alias(result))
        return df.join(F.broadcast(small), key == F.col("__value"), "left").drop("__value")
    hot = mapping.where(F.col("n_rows") > size["rows"] / HOT_SHARE).select(
        F.col("value").alias("__hot"), F.col("payload").alias("__hot_payload"))
    cold = mapping.select(F.col("value").alias("__value"), F.lit(0).alias("__zero"), F.col("payload").alias("__payload"))
    known = df.join(F.broadcast(hot), key == F.col("__hot"), "left")
    lane = F.when(F.col("__hot").isNotNull() | key.isNull() | is_blank(key),
                  F.pmod(F.xxhash64(named(row_key)), F.lit(SPREAD)) + 1).otherwise(0)
    # hot rows carry a lane above zero and so match nothing here
    joined = known.withColumn("__key", F.coalesce(key, F.lit(""))).withColumn("__lane", lane).join(
        cold, (F.col("__key") == F.col("__value")) & (F.col("__lane") == F.col("__zero")), "left")
    return joined.withColumn(result, F.coalesce("__hot_payload", "__payload")).drop(
        "__hot", "__hot_payload", "__value", "__zero", "__payload", "__key", "__lane")


def attach_numbers(df: DataFrame, row_key: str, columns: list[str], numbers: DataFrame,
                   broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Add ``__number_<column>`` for each column from ``numbers`` (column, value, n_rows, number).

    Columns with few distinct values are looked up by broadcast, smallest first,
    as long as all maps together stay within ``broadcast_bytes``.  The others are
    looked up together on narrow (row key, column, value) rows, and the wide table
    is shuffled once, by its row key.  That needs keys that name one row each, so
    they are counted first; where a key repeats or is null, each column is looked
    up by its own value instead.
    """
    sizes = numbers.groupBy("column").agg(F.sum(F.octet_length("value") + 64).alias("bytes")).collect()
    bytes_of = {r["column"]: r["bytes"] for r in sizes}         # one row per column
    large, total = [], 0
    for column in sorted(columns, key=lambda c: bytes_of.get(c, 0)):
        total += bytes_of.get(column, 0)
        if total > broadcast_bytes:
            large.append(column)
            continue
        small = numbers.where(F.col("column") == column).select(
            F.col("value").alias("__value"), F.col("number").alias(f"__number_{column}"))
        df = df.join(F.broadcast(small), named(column) == F.col("__value"), "left").drop("__value")
    if not large:
        return df
    if len(large) == 1 or _repeats(df, row_key):
        for column in large:
            mapping = numbers.where(F.col("column") == column).select("value", "n_rows", F.col("number").alias("payload"))
            df = look_up(df, named(column), mapping, row_key, f"__number_{column}", 0)
        return df
    cells = df.select(named(row_key).alias("__row"), *map(named, large)).unpivot(
        ["__row"], [named(c) for c in large], "__column", "__cell").where(
        F.col("__cell").isNotNull() & ~is_blank(F.col("__cell")))
    key = F.concat(F.col("__column"), F.lit("\x00"), F.col("__cell"))
    mapping = numbers.where(F.col("column").isin(large)).select(
        F.concat(F.col("column"), F.lit("\x00"), F.col("value")).alias("value"), "n_rows", F.col("number").alias("payload"))
    found = look_up(cells, key, mapping, "__row", "__number", 0)
    wide = found.groupBy("__row").agg(*[
        F.max(F.when(F.col("__column") == c, F.col("__number"))).alias(f"__number_{c}") for c in large])
    return df.join(wide, named(row_key) == F.col("__row"), "left").drop("__row")


def _repeats(df: DataFrame, row_key: str) -> bool:
    """Whether some key names more than one row, or none."""
    keys = df.groupBy(named(row_key).alias("key")).agg(F.count("*").alias("n"))
    return bool(keys.where((F.col("n") > 1) | F.col("key").isNull()).limit(1).count())


def class_sizes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(columns..., class_size) of every combination that occurs; null is a value of its own."""
    return df.groupBy(*map(named, columns)).agg(F.count("*").alias("class_size"))
