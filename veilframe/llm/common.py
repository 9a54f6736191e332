"""Reading inputs, staging, joins that bear hot keys, and running numpy code over Arrow batches of bounded size."""

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from veilframe import session

__all__ = ["few_files", "join_spread", "map_pieces", "new_path", "read", "runs", "small", "stage", "with_row_id"]

#: Bytes of text that numpy code holds at a time; one longer text is a piece of its own.
PIECE_BYTES = 2 << 20
#: Bytes or characters of a piece that go through its largest temporary tables at a time.
RUN = 512 << 10
#: Rows of an Arrow batch, where the session has Spark's own default: texts are long, and a batch is held whole.
BATCH_ROWS, BATCH_SETTING, BATCH_DEFAULT = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"

#: Bytes of a table that goes to every executor, as long as it has no more.
BROADCAST_BYTES = 32 << 20

#: A key is hot with more than this part of the rows.
SPREAD = 1024


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared work folder and read back: later steps start from files and outlive executors."""
    return session.stage(df, name, compression="zstd")


def few_files(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of narrow rows, ``rows`` of them at most or about, in no more partitions than that is worth, to be staged.

    On a ``file:`` path Hadoop starts processes for each file that a task writes, and
    each of them counts for a moment with all the executor's memory.
    """
    return df.coalesce(session.tasks_for(rows, df.sparkSession.sparkContext.defaultParallelism))


def new_path(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared work folder."""
    return f"{session.work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """The named columns of a table; Parquet reads no others."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def with_row_id(df: DataFrame) -> DataFrame:
    """A row number ``uid`` that holds once the result is staged; ids in the data may repeat or be null."""
    return df.withColumn("uid", F.monotonically_increasing_id())


def small(df: DataFrame, size: str) -> DataFrame | None:
    """``df`` for a broadcast join if it has at most BROADCAST_BYTES by ``size``, an aggregate that is counted first; else null, and the join has to shuffle."""
    return F.broadcast(df) if (df.agg(F.expr(size)).first()[0] or 0) <= BROADCAST_BYTES else None


def join_spread(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """Inner join of ``rows`` with a staged ``table`` of one row for each key (null is a key), where ``weight`` tells how many rows have it.

    Keys with more than 1/SPREAD of the rows, fewer than SPREAD of them, are answered
    by broadcast while their rows stay where they are; all others are shuffled.
    """
    hot = F.col(weight) > table.agg(F.sum(weight)).first()[0] / SPREAD if table.limit(1).count() else F.lit(False)
    there = table.withColumnRenamed(key, "key__")
    same = F.col(key).eqNullSafe(F.col("key__"))
    large = F.broadcast(there.where(hot))
    many = rows.join(large, same)
    few = rows.join(large.select("key__"), same, "left_anti").join(there.where(~hot), same)
    return many.unionByName(few).drop("key__")


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``limit`` bytes in ``column``."""
    if not batch.num_rows:
        return
    for at, to in runs(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), limit):
        yield batch.slice(at, to - at)


def runs(sizes: np.ndarray | list[int], limit: int = RUN) -> Iterator[tuple[int, int]]:
    """Where runs of entries begin and end that are no larger than ``limit`` together, or one alone."""
    ends, at = np.cumsum(sizes), 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield at, to
        at = to


def map_pieces(df: DataFrame, column: str, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str) -> DataFrame:
    """``mapInArrow`` in bounded pieces.

    ``make`` runs once in each task, so that a model is set up once, and returns
    the function from a piece to the columns of its result.
    """
    if df.sparkSession.conf.get(BATCH_SETTING, BATCH_DEFAULT) == BATCH_DEFAULT:
        df.sparkSession.conf.set(BATCH_SETTING, str(BATCH_ROWS))
    names = [c.strip().split(" ")[0].strip("`") for c in _fields(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for piece in pieces(batch, column):
                out = f(piece)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (out[n] for n in names)], names)

    return df.mapInArrow(run, schema)


def _fields(schema: str) -> list[str]:
    """The parts of a DDL schema at its outer commas."""
    parts, depth, part = [], 0, ""
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            parts.append(part)
            part = ""
        else:
            part += ch
    return [*parts, part]
