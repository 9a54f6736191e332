"""Rows are dealt to all cores however a file is cut."""

from pyspark.sql import functions as F

from catalog import queries
from veilframe.session import FEWEST_ROWS, ROWS_A_TASK, spread, tasks_for


def test_every_core_gets_the_same_number_of_tasks_and_none_too_many_rows():
    assert [tasks_for(n, 12) for n in (0, 1, FEWEST_ROWS, FEWEST_ROWS + 1)] == [1, 1, 1, 2]
    for rows in (15_000, 900_000, 5_400_000, 10 ** 9):
        tasks = tasks_for(rows, 12)
        assert tasks % 12 == 0 and rows <= tasks * ROWS_A_TASK


def test_spread_keeps_all_rows_with_repeated_and_null_keys(spark):
    rows = spark.range(0, 3000, 1, 1).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 7).alias("k"), "id")
    dealt = spread(rows)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == tasks_for(3000, spark.sparkContext.defaultParallelism) > 1 and max(sizes) < 3000
    assert sorted(map(repr, dealt.collect())) == sorted(map(repr, rows.collect()))


def test_a_customer_file_of_one_row_group_is_staged_in_several_files(spark, tmp_path):
    path = str(tmp_path / "one")
    spark.range(1, 6001, 1, 1).select(F.col("id").alias("c_custkey"), (F.col("id") % 25).alias("c_nationkey"),
                                      F.lit("BUILDING").alias("c_mktsegment")).coalesce(1).write.parquet(f"{path}/customer.parquet")
    people = queries.people(spark, path)
    assert people.count() == 6000
    assert len(people.inputFiles()) == tasks_for(6000, spark.sparkContext.defaultParallelism) > 1
