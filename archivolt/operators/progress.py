"""Ingest progress: planning, rollups, pages, checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.functions import native as N

#: The states of a file, in the order in which they are listed.
STATES = ("parsing", "error", "pending", "parsed")


def parse_plan(files: DataFrame, progress: DataFrame) -> DataFrame:
    """Every known file with its progress; a file without any starts at 0, pending."""
    state = progress.select("file_id", "status", "byte_offset", "file_size", "records", "error")
    return files.select(F.col("id").alias("file_id"), "file_path").join(state, "file_id", "left").select(
        "file_id", "file_path", F.coalesce("status", F.lit("pending")).alias("status"), F.coalesce("byte_offset", F.lit(0)).alias("byte_offset"), "file_size", F.coalesce("records", F.lit(0)).alias("records"), "error"
    )


def parse_work(plan: DataFrame, sizes: DataFrame) -> DataFrame:
    """What to do with each planned file that is still on disk (``sizes``: file_path, size; a null size is unknown):
    ``reason`` new, resume, grew, replaced, retry or done, and where to ``start``. Vanished files are left out."""
    on_disk = plan.join(sizes, "file_path")
    known, at, size = F.col("file_size"), F.col("byte_offset"), F.col("size")
    reason = (
        F.when(F.col("status") == "error", "retry").when(F.col("status") == "pending", "new").when((F.col("status") == "parsing") & (at > 0), "resume").when(F.col("status") == "parsing", "new")
        .when(size.isNull() | known.isNull() | (size == known), "done").when(size > known, "grew").otherwise("replaced")
    )
    fresh = reason.isin("new", "replaced")
    return on_disk.select("file_id", "file_path", F.when(fresh, F.lit(0)).otherwise(at).cast("bigint").alias("start"), F.when(fresh, F.lit(0)).otherwise(F.col("records")).cast("bigint").alias("records"), "size", reason.alias("reason"))


def rollup(plan: DataFrame) -> DataFrame:
    """One row over all files: a count per state, records, bytes done, total bytes, files of unknown size, percent."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATES]
    done = plan.agg(F.count("*").alias("files"), *counts, F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.coalesce(F.sum("byte_offset"), F.lit(0)).alias("bytes_done"), F.sum("file_size").alias("bytes_total"), F.count_if(F.col("file_size").isNull()).alias("unknown_sizes"))
    return done.withColumn("percent", N.percent("bytes_done", "bytes_total"))


def page(plan: DataFrame, status: str | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Files in the order parsing, error, pending, parsed, then by path."""
    rank = F.array_position(F.array(*map(F.lit, STATES)), F.col("status"))
    rows = (plan.where(F.col("status") == status) if status else plan).withColumn("percent", N.percent("byte_offset", "file_size"))
    ordered = rows.orderBy(rank, "file_path").offset(offset)
    return ordered.limit(limit) if limit is not None else ordered


def advance(progress: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Checkpoints merged into progress; an offset never falls (``file_id``, ``byte_offset``, ``records``)."""
    both = progress.select("file_id", "byte_offset", "records").unionByName(checkpoints.select("file_id", "byte_offset", "records"))
    return both.groupBy("file_id").agg(F.max("byte_offset").alias("byte_offset"), F.max("records").alias("records"))


def low_watermark(batches: DataFrame) -> DataFrame:
    """Per file the offset that is safe to resume from: the smallest start among batches in flight, else the largest
    end (``file_id``, ``start``, ``end``, ``finished``)."""
    open_start = F.min(F.when(~F.col("finished"), F.col("start")))
    return batches.groupBy("file_id").agg(F.coalesce(open_start, F.max("end")).alias("safe_offset"))
