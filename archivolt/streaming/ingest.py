"""Resumable ingest of growing archives: the ``warc`` stream into the star schema, at least once and idempotent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from archivolt.functions import native as N
from archivolt.operators import ingest
from archivolt.sources import warc
from archivolt.sources.warc import GAPS


def http_date(text: Column) -> Column:
    """A date such as ``Tue, 15 Nov 1994 08:12:31 GMT``; null if it is not of that form."""
    bare = F.regexp_extract(text, r"(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2})", 1)
    return F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss"))


def bulk_rows(captures: DataFrame, batch_id: int) -> DataFrame:
    """Captures of the ``warc`` source as rows of a bulk batch, the identity being ``file::uri::uuid``."""
    identity = F.when(F.col("target_uri").isNotNull() & F.col("record_id").isNotNull(), F.concat_ws("::", "file_path", "target_uri", "record_id"))
    content_type = N.joined_content_type(N.header("http_headers", "content-type"))
    return captures.select(
        F.xxhash64("file_path", "entry", "offset").alias("row_id"), F.lit(batch_id).alias("batch_id"), identity.alias("warc_custom_id"), F.col("record_id").alias("warc_record_id"),
        F.col("warc_date").alias("warc_archived_date"), "file_path", "ip", F.col("target_uri").alias("uri"), content_type.alias("http_content_type"), F.col("http_headers"), F.col("status").alias("http_status"),
        http_date(N.header("http_headers", "last-modified")).alias("http_last_modified"),
        F.col("payload_offset").alias("payload_byte_offset"), F.col("payload_length").alias("payload_byte_length"), F.col("chunk_sizes").alias("payload_chunks"), "payload_digest",
    )


def ingest_batch(captures: DataFrame, batch_id: int, folder: str) -> None:
    """One micro-batch: sound responses into the star, everything else into ``quarantine``. A batch that comes again
    after a failure adds nothing."""
    captures = captures.persist()
    try:
        sound = captures.where("error is null and warc_type = 'response'")
        rows = bulk_rows(sound, batch_id)
        ingest.write_batch(rows, folder)
        broken = captures.where("error is not null").select("file_path", "offset", F.col("error").alias("reason"))
        refused = ingest.invalid_rows(rows).select("file_path", F.col("payload_byte_offset").alias("offset"), "reason")
        taken = captures.where("length is not null").groupBy("file_path").agg(F.max(F.col("offset") + F.col("length")).alias("byte_offset"), F.count("*").alias("records"))
        taken.write.mode("overwrite").parquet(f"{folder}/file_progress/batch={batch_id}")
        broken.unionByName(refused).write.mode("overwrite").json(f"{folder}/quarantine/batch={batch_id}")
    finally:
        captures.unpersist()


def file_progress(spark: SparkSession, folder: str, source: str) -> DataFrame:
    """``file_path``, ``status``, ``byte_offset``, ``file_size`` and ``records`` of every archive file of ``source``, by
    what the batches so far have written down: ``pending`` before the first record, ``parsing`` while bytes are left,
    ``parsed`` at the file's end (but for the line ends that close its last record). A batch that came again counts
    once. A compressed file is parsed once any of its records is, for it is taken whole."""
    from archivolt.sources.files import list_files

    sizes = spark.createDataFrame(list_files(source), "file_path string, file_size bigint")
    done = spark.read.parquet(f"{folder}/file_progress").groupBy("file_path").agg(F.max("byte_offset").alias("byte_offset"), F.sum("records").alias("records"))
    both = sizes.join(done, "file_path", "left")
    whole = ~F.lower("file_path").endswith(".warc") & F.col("records").isNotNull()
    at_end = whole | (F.col("byte_offset") + max(GAPS) >= F.col("file_size"))
    status = F.when(F.col("records").isNull(), "pending").when(at_end, "parsed").otherwise("parsing")
    return both.select("file_path", status.alias("status"), F.when(at_end, F.col("file_size")).otherwise(F.coalesce("byte_offset", F.lit(0))).alias("byte_offset"), "file_size", F.coalesce("records", F.lit(0)).alias("records"))


def last_offset(spark: SparkSession, checkpoint: str) -> str | None:
    """The source's offset in the newest entry of a query's log; None before the first."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/offsets")
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return None
    numbers = [int(f.getPath().getName()) for f in system.listStatus(folder) if f.getPath().getName().isdigit()]
    if not numbers:
        return None
    rows = spark.read.text(f"{checkpoint}/offsets/{max(numbers)}").collect()  # three short lines
    return next((r["value"] for r in rows if r["value"].startswith('{"files"')), None)


def start_ingest(spark: SparkSession, source: str, folder: str, checkpoint: str, available_now: bool = False, max_bytes: int | None = None) -> StreamingQuery:
    """Start the ingest of ``source`` into ``folder``; it resumes from ``checkpoint``. With ``available_now`` one batch
    is taken, of what is there or of ``max_bytes`` of it."""
    warc.register(spark)
    reader = spark.readStream.format("warc").option("path", source)
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    if resume := last_offset(spark, checkpoint):
        reader = reader.option("resumeFrom", resume)
    writer = reader.load().writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: ingest_batch(df, n, folder))
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")).start()
