"""Tables and checkpoints in the folder that all executors share.

A job that cuts lineage must not depend on any one executor's disk, so both helpers write below ``spark.checkpoint.dir``.
Only a session that names no such folder (tests, a laptop) gets one of its own.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: A side of a join is broadcast only while its measured size is below this.
BROADCAST_BYTES = 32 << 20
#: Bytes of input files for which a shuffle has a partition of its own.
SPREAD_BYTES = 8 << 20
_INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; for a session without one, a folder of this process is set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if spark.sparkContext.getCheckpointDir() is None:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="graphlode-"))
    return spark.sparkContext.getCheckpointDir()


def size_of(spark: SparkSession, *paths: str) -> int:
    """Bytes of the files at or below the paths; 0 for one that isn't there."""
    conf, total = spark.sparkContext._jsc.hadoopConfiguration(), 0
    for path in paths:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = hadoop.getFileSystem(conf)
        total += fs.getContentSummary(hadoop).getLength() if fs.exists(hadoop) else 0
    return total


def spread(spark: SparkSession, n_bytes: int) -> None:
    """Lets shuffles start with a partition for each SPREAD_BYTES of n_bytes, if that is more than the session's number.

    With a fixed number a task reads, sorts and holds a share that grows with the input. Adaptive execution joins partitions
    that turn out small, so there are no more tasks than before where there is little to do.
    """
    least, wanted = int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // SPREAD_BYTES)
    if wanted > least:
        spark.conf.set(_INITIAL, wanted)
    elif spark.conf.get(_INITIAL, None):
        spark.conf.unset(_INITIAL)


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def _drop_at_exit(spark: SparkSession, path: str) -> None:
    try:
        drop_path(spark, path)
    except Exception:  # the session has gone; so has a folder of its own
        pass


def stash(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: its lineage starts at files that survive executors.

    The files go when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    atexit.register(_drop_at_exit, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def release(df: DataFrame) -> None:
    """Deletes what stash() or cut() wrote for df, when nothing that is still to run reads it."""
    path = getattr(df, "_stored_at", None)
    if path:
        drop_path(df.sparkSession, path)


def cut(df: DataFrame) -> DataFrame:
    """df as a stored table, for loops: unlike an eager checkpoint(), which runs the last stage twice, it is made once."""
    return stash(df, "cut")


def hinted(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """broadcast_if_small() of a df whose rows have been counted."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def looked_up(df: DataFrame) -> DataFrame:
    """df, whose keys are few a value, as the side of a shuffled join that is hashed: the other side, edges or calls, isn't
    sorted, and a task holds its part of df only."""
    return df.hint("shuffle_hash")


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if counting shows that it fits, else df itself (a shuffled join follows).

    The count stops at the first row beyond the limit, but runs what df is made of: df should be a stored table or cheap.
    """
    most = limit // row_bytes
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
