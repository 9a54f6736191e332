"""Where intermediate tables go."""

import tempfile
import uuid
from contextvars import ContextVar
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_folder: dict[str, str] = {}
_lists: ContextVar[tuple[list[str], ...]] = ContextVar("lists of staged tables", default=())


def work_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may do without the setting and gets a folder of its
    own; on a cluster every executor must see the same place.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_folder:
        _local_folder[context.applicationId] = tempfile.mkdtemp(prefix="veilframe-")
    return _local_folder[context.applicationId]


ROWS_A_TASK = 1 << 16
FEWEST_ROWS = 1 << 10   # less than this is not worth a task


def tasks_for(rows: int, cores: int) -> int:
    """Tasks for so many rows: the same number on every core, none with more than ROWS_A_TASK rows."""
    return max(1, min(-(-rows // FEWEST_ROWS), cores * -(-rows // (ROWS_A_TASK * cores))))


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out evenly by its number of rows, which is counted first.

    A file is cut by bytes, and never inside a row group, so a narrow table with a
    million rows may be one task.  What is done here to a row costs far more than
    reading it.
    """
    return df.repartition(tasks_for(df.count(), df.sparkSession.sparkContext.defaultParallelism))


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as a table in the work folder, with the writer's ``options``, and read it back.

    Later steps start from files instead of recomputing, and survive the loss of
    executors; the columnar form also lets them read only the columns they use.
    """
    path = f"{work_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    for paths in _lists.get():
        paths.append(path)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def staged_inside() -> Iterator[list[str]]:
    """The paths of the tables that are staged inside the block, by its own thread alone."""
    paths: list[str] = []
    token = _lists.set((*_lists.get(), paths))
    try:
        yield paths
    finally:
        _lists.reset(token)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the tables staged inside the block when it ends, also when it fails.

    Write or collect results inside: one that still reads a staged table is gone
    with it.
    """
    with staged_inside() as paths:
        try:
            yield
        finally:
            drop_staged(spark, paths)


def drop_staged(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
