"""Helpers that several text operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word rules: space and U+0009 to U+000D.
ASCII_SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Most rows and bytes of whole documents that a Python worker gets at a time; Spark's own bound of 10,000 rows is no
#: bound on their texts.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches so that a worker's memory does not follow the length of documents."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a session whose executors run in
    the driver's own process gets a temporary one; on a cluster it must be set.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where


_STANDING: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts its lineage.

    The table stands until ``drop_tables``, as what was made of it reads it whenever it runs.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STANDING.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tables() -> list[str]:
    """The paths of this process's stored tables that still stand, in the order in which they were written."""
    return list(_STANDING)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Remove stored tables, once all that reads them has been written or collected."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _STANDING.remove(path)


def swept(spark: SparkSession) -> None:
    """Let the shuffle files of what has been stored go: Spark deletes them once the driver's garbage is collected, which may be late.

    The listeners' queues hold the last event, and with it the plan of a query that has just ended, until the next one comes.
    """
    spark.range(1).count()
    with contextlib.suppress(Py4JError):  # still busy: only less goes
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, to be read in bounded batches."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A mapper of frames whose worker gives its free memory back when the task is done: Spark keeps workers for later tasks."""

    def mapper(frames: Iterator) -> Iterator:
        yield from run(frames)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
        if trim:
            trim(0)

    return mapper


def text_of(column: str) -> Column:
    """The column's text, null as the empty one."""
    return F.coalesce(F.col(column), F.lit(""))
