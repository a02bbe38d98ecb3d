"""Helpers that the operators share: checkpoints, column conventions, row keys."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cut, shared_folder  # noqa: F401


#: Rows and bytes of an Arrow batch of texts; Spark's own limits (10000 rows, 64 MB) hold
#: several copies of too much text at once in a worker of a few hundred MB.
BATCH_ROWS, BATCH_BYTES = "1000", str(8 << 20)


def lean(df: DataFrame) -> DataFrame:
    """``df`` itself; from now on its session sends texts to Python in small batches,
    unless it was told another size."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def release() -> None:
    """Returns freed memory of a Python worker to the system.  Workers live on between
    tasks, and beside them the JVM needs the rest of the executor's memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(build: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A mapInArrow function that releases memory when its task is done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from build(batches)
        release()

    return run


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes what a finished step has left in the shared folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` as a Parquet table in the shared folder, and what deletes it again.  For rows
    that are read more than once and are many: a checkpoint takes three times the room."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/formweave-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), lambda: remove(spark, path)


def sweep(spark: SparkSession) -> None:
    """Lets Spark delete the shuffles and checkpoints that nothing refers to any more.  It
    does so when the driver collects garbage, which a driver that holds little rarely does."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def relieve(spark: SparkSession) -> None:
    """Has executors collect their garbage.  Sorts and hash tables take memory in pages of
    many MB; dead ones keep a heap at its limit though next to nothing in it is alive, and
    that memory is missing to the Python workers of the step that follows."""
    sweep(spark)
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc') AS done").filter("done IS NULL").count()


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column; a null is the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def small_side(df: DataFrame, most: int) -> DataFrame:
    """``df`` marked for broadcast if a count finds at most ``most`` rows; otherwise as it
    is, so that the join shuffles both sides."""
    return F.broadcast(df) if df.count() <= most else df


def semi_join(df: DataFrame, keys: DataFrame, on: str, most: int = 1 << 20) -> DataFrame:
    """Rows of ``df`` whose ``on`` is in ``keys`` (distinct); up to ``most`` keys (8 MB of
    longs) are broadcast, so that ``df`` is not shuffled."""
    return df.join(small_side(keys, most), on, "left_semi")
