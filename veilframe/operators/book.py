"""A book of pseudonym numbers that goes on from table to table and along a stream.

The book is a folder of Parquet tables, one for each entry that was made: an entry
numbers the values that none before it has, in order of first appearance, after the
numbers that are taken.  Values are held as salted SHA-256, so the book does not tell
them; who has the salt can look one up.  An entry has a name, and making it again
after a failure gives the same numbers, so that streams can make one per batch.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veilframe.functions.text import is_blank, named
from veilframe.operators import lookup
from veilframe.session import drop_staged, stage, staged_inside

SCHEMA = "column string, digest string, number bigint"


class PseudonymBook:
    """The book in the folder ``path``; ``salt`` must be the one it was begun with."""

    def __init__(self, spark: SparkSession, path: str, salt: str):
        self.spark, self.path, self.salt = spark, path.rstrip("/"), salt

    def digest(self, value: Column) -> Column:
        return F.sha2(F.concat(F.lit(self.salt), F.lit("\x00"), value), 256)

    def _folder(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def entries(self) -> list[str]:
        """Names of the entries that were completed, in order."""
        place = self._folder("*/_SUCCESS")
        found = place.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(place)
        return sorted(f.getPath().getParent().getName() for f in found or [])

    def numbers(self, without: str | None = None) -> DataFrame:
        """(column, digest, number) of everything in the book."""
        paths = [f"{self.path}/{name}" for name in self.entries() if name != without]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def extend(self, df: DataFrame, row_key: str, columns: list[str], name: str | None = None) -> None:
        """Number the values of ``columns`` that are new, as the entry ``name``; one that is complete stays as it is.

        Only distinct values are shuffled, and no task numbers a whole column.  Entries
        are made one after the other: two at a time would take the same numbers.
        """
        name = f"entry-{len(self.entries()):08d}" if name is None else name
        if name in self.entries():
            return
        with staged_inside() as staged:
            try:
                held = self.numbers(without=name)
                taken = held.groupBy("column").agg(F.max("number").alias("taken"))
                seen = lookup.distinct_first_seen(df.select(named(row_key), *[named(c).cast("string").alias(c) for c in columns]), row_key, columns)
                seen = seen.select("column", self.digest(F.col("value")).alias("value"), "first_key", "n_rows")
                known = held.select(F.col("column").alias("its_column"), "digest")
                new = seen.join(known, (F.col("column") == F.col("its_column")) & (F.col("value") == F.col("digest")), "left_anti")
                numbered = lookup.number_in_order(stage(new, "new-values"))
                # one row for each column
                shifted = numbered.join(F.broadcast(taken), "column", "left")
                shifted.select("column", F.col("value").alias("digest"), (F.col("number") + F.coalesce("taken", F.lit(0))).cast("bigint").alias("number")) \
                    .write.mode("overwrite").parquet(f"{self.path}/{name}")
            finally:
                drop_staged(self.spark, staged)

    def attach(self, df: DataFrame, row_key: str, columns: list[str], broadcast_bytes: int = lookup.BROADCAST_BYTES) -> DataFrame:
        """Add ``__number_<column>`` for each column; all values must be in the book."""
        held = self.numbers()
        for column in columns:
            key = F.when(named(column).isNotNull() & ~is_blank(named(column)), self.digest(named(column)))
            counts = df.groupBy(key.alias("value")).agg(F.count("*").alias("n_rows")).where("value is not null")
            mapping = held.where(F.col("column") == column).join(counts, F.col("digest") == F.col("value")).select("value", F.col("number").alias("payload"), "n_rows")
            df = lookup.look_up(df, key, mapping, row_key, f"__number_{column}", broadcast_bytes)
        return df
