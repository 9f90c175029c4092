"""Where intermediate tables go, and how large Arrow batches may grow."""

from __future__ import annotations

import uuid
from contextlib import suppress

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexafact.shipping import ship

#: Rows in a batch sent to a Python worker: few, as a text may be long.
BATCH_ROWS = 512
#: Bytes of written tables that are broadcast, or read by a few tasks, at most.
SMALL_BYTES = 4 << 20

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the batches sent to Python workers, and let them find this package. Returns the session."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; where it is unset, only a local master has a default."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    # one process only: its warehouse is shared by definition
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and lost executors recompute nothing before it.

    The shuffle files of the step go when it ends; the table goes with ``discard``, or when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    with suppress(PySparkException):
        spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        with suppress(PySparkException):
            spark.conf.set(_CLEAN, before)
    place, fs = _folder(spark, path)
    fs.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` has written and that nothing will read again."""
    for df in tables:
        place, fs = _folder(df.sparkSession, df._written_to)
        fs.delete(place, True)


def small(*tables: DataFrame) -> bool:
    """Whether tables that ``materialise`` has written are small together; a table it has not written is not."""
    total = 0
    for df in tables:
        if not hasattr(df, "_written_to"):
            return False
        place, fs = _folder(df.sparkSession, df._written_to)
        total += fs.getContentSummary(place).getLength()
    return total <= SMALL_BYTES


def few(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores at most, if the written tables that it comes from are small: a task costs more than its rows there."""
    return df.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism)) if small(*tables) else df


def light(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """``df``, broadcast to joins if the written tables that it comes from are small: such a join needs no exchange of either side."""
    return F.broadcast(few(df, *tables)) if small(*tables) else df


def parallelism(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session sets them."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
