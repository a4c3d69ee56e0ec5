"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


SHUFFLE_TARGET = 128 << 20


def build_session(
    app: str = "shelfline", master: str | None = None, shuffle_bytes: int | None = None, **conf
) -> SparkSession:
    """A session with the settings the operators are tested under.

    Adaptive execution merges shuffle partitions that turn out small and splits skewed ones, but
    never makes more than it starts with. Give `shuffle_bytes`, the size of the largest shuffle
    to start with partitions that fit a task.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    # Page bodies are long: a batch of the default number of rows could take a task's memory.
    b = b.config("spark.sql.parquet.columnarReaderBatchSize", "1024")
    if shuffle_bytes:
        first = max(1, -(-shuffle_bytes // SHUFFLE_TARGET))
        b = b.config("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(first))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; where that is unset, one beside the warehouse, which is shared as well."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (path or f"{spark.conf.get('spark.sql.warehouse.dir')}/_shelfline").rstrip("/")


_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new place for an intermediate table, in a folder of this application that goes when it ends, or with the
    `scratch` around the call."""
    home = _SCRATCH.get() or f"{shared_dir(spark)}/shelfline-{spark.sparkContext.applicationId}"
    place = spark._jvm.org.apache.hadoop.fs.Path(home)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.mkdirs(place):
        fs.deleteOnExit(place)
    return f"{home}/{label}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Intermediate tables made inside are removed at the end.

    For jobs that write what they work out: a table made inside must not be read after it. What is given is a `stage`
    for the results, which stay as long as if they were made outside.
    """
    outer, home = _SCRATCH.get(), fresh_path(spark, "scratch")

    def keep(df: DataFrame, label: str) -> DataFrame:
        inner = _SCRATCH.set(outer)
        try:
            return stage(df, label)
        finally:
            _SCRATCH.reset(inner)

    token = _SCRATCH.set(home)
    try:
        yield keep
    finally:
        _SCRATCH.reset(token)
        place = spark._jvm.org.apache.hadoop.fs.Path(home)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stage(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Used where one intermediate result feeds several branches. Unlike a cached copy it does not
    depend on executors staying alive, and unlike `checkpoint()` the reader keeps column pruning
    and real sizes, so join strategies stay informed.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    w = df.write
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
