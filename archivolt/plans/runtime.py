"""Session-level helpers shared by the operators: table access, checkpoints, size-checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if Catalyst's own size estimate is below this many bytes.
BROADCAST_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the archive's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the optimised plan; for a file scan it derives from the files' sizes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast if the estimated size is within ``limit``; else leave the join to Catalyst and AQE."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where that is unset, a local session gets one of its own; on a
    cluster, where no folder of one machine would do, that is an error."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if given is None:
        current = context._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        given = tempfile.mkdtemp(prefix="archivolt-checkpoint-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(given)
    return given


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage; it survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast of a materialised ``df`` if its rows, counted, are within ``limit`` at 16 bytes a
    field; for narrow results of fixed-width fields whose size Catalyst cannot know."""
    return F.broadcast(df) if 16 * len(df.columns) * df.count() <= limit else df


def micros(column) -> F.Column:
    """Microseconds since the epoch of a timestamp column (zoned, or naive and taken as UTC)."""
    return F.unix_micros(column.cast("timestamp"))


#: Scans of more bytes than this are never spread: they have work for many tasks as they are.
SPREAD_BYTES = 256 << 20


def spread(df: DataFrame, limit: int = SPREAD_BYTES) -> DataFrame:
    """``df`` over all cores if its scan gives work to fewer than half of them, as a few small files of one row group
    each do, for a costly Python pass over it. Only a scan of ``limit`` bytes at most is shuffled for that; anything
    larger is left as it is read, in splits of ``spark.sql.files.maxPartitionBytes``."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if estimated_bytes(df) <= limit and 2 * df.rdd.getNumPartitions() < cores else df
