"""Session-level helpers: shared storage, materialised intermediates and table loading."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from querent.errors import InvalidParameter

#: Used only where the session names no checkpoint folder and runs in one process, as in tests.
DEFAULT_SHARED_DIR = "file:///tmp/checkpoints/querent"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); on a cluster it has to be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise InvalidParameter("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = DEFAULT_SHARED_DIR
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing else uses."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    for held in _scratch:
        held.append(path)
    return path


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end every path in the shared folder that was given out inside, so results have to be written by then."""
    held: list[str] = []
    _scratch.append(held)
    try:
        yield
    finally:
        _scratch.remove(held)
        for path in held:
            remove_path(spark, path)


def materialize(df: DataFrame, tag: str, compression: str = "snappy", **options: str) -> DataFrame:
    """Write ``df`` as Parquet, with further ``options`` of its writer, into the shared folder and read it back.

    This cuts lineage so that lost executors cost a re-read and not a recomputation, and gives the
    planner a true size: what is small enough is broadcast by Spark's own threshold, the rest is shuffled.
    """
    path = fresh_path(df.sparkSession, tag)
    df.write.option("compression", compression).options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch that Python functions on texts are given at once.
BATCH_BYTES = 8 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, after lowering the session's bound on Arrow batches where it is higher: several copies of a batch exist at
    a time, in the executor and in its Python workers."""
    key, spark = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession
    now = re.match(r"-?\d+", spark.conf.get(key))
    if not now or not 0 < int(now[0]) <= BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)
    return df


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a path written by this engine."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if it isn't there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in files.listStatus(target)) if files.exists(target) else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as the session has cores, if it comes in fewer, as a small single file does.

    So few partitions are small or come from a file that can't be split; all else stays where it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def has_rows(df: DataFrame) -> bool:
    """Whether ``df`` has any row; reads one row at most from each partition it has to look at."""
    return bool(df.limit(1).take(1))
