"""Captures into the star schema: validated, keyed by natural keys, idempotent.

Surrogate keys are hashes of natural keys, so that writing a batch twice gives the same rows and no sequence has to be
shared; natural keys are kept beside them. Nothing is updated in place: new rows are those whose key is not there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.functions import native as N
from archivolt.operators.archive import last_written


def invalid_rows(batch: DataFrame) -> DataFrame:
    """The rows that may not be ingested, with the reason: a blank URI or id, an id that occurs twice in its batch."""
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    repeated = duplicate_ids(batch).select("batch_id", "warc_custom_id", F.lit(True).alias("repeated"))
    marked = batch.join(repeated, ["batch_id", "warc_custom_id"], "left")
    reason = F.when(blank("uri"), "blank uri").when(blank("warc_custom_id"), "blank id").when(F.col("repeated"), "repeated id")
    return marked.withColumn("reason", reason).where("reason is not null").drop("repeated")


def duplicate_ids(batch: DataFrame) -> DataFrame:
    return batch.where("warc_custom_id is not null").groupBy("batch_id", "warc_custom_id").agg(F.count("*").alias("n")).where("n > 1")


def valid_rows(batch: DataFrame) -> DataFrame:
    return batch.join(invalid_rows(batch).select("row_id"), "row_id", "left_anti")


def key(*natural: str | Column) -> Column:
    """The surrogate of a natural key; null if any part is."""
    parts = [F.col(c) if isinstance(c, str) else c for c in natural]
    some = parts[0].isNotNull()
    for p in parts[1:]:
        some = some & p.isNotNull()
    return F.when(some, F.xxhash64(*parts))


def star(batch: DataFrame) -> dict[str, DataFrame]:
    """The rows of each table that a valid batch brings. Of rows with one URI, payload place or id the last by
    ``row_id`` counts."""
    b = batch.withColumn("content_type", F.nullif(F.trim("http_content_type"), F.lit("")))
    last = lambda df, *keys: last_written(df.withColumn("_key", F.struct(*keys)), "_key", "row_id").drop("_key")
    files = b.where("file_path is not null").select(key("file_path").alias("id"), "file_path").distinct()
    ips = b.where("ip is not null").select(key("ip").alias("id"), "ip").distinct()
    types = b.where("content_type is not null").select(key("content_type").alias("id"), F.col("content_type").alias("type")).distinct()
    types = types.withColumn("base_type", N.content_type_base("type")).withColumn("charset", N.content_type_charset("type"))
    uris = last(b.select("uri", "row_id"), "uri").select(key("uri").alias("id"), "uri", N.recursion_level("uri").alias("recursion_level"))
    placed = b.where("payload_byte_offset is not null and payload_byte_length is not null and file_path is not null")
    payloads = last(placed.select("file_path", "payload_byte_offset", "payload_byte_length", "payload_chunks", "payload_digest", "row_id"), "file_path", "payload_byte_offset", "payload_byte_length")
    payloads = payloads.select(key("file_path", "payload_byte_offset", "payload_byte_length").alias("id"), key("file_path").alias("file_id"), F.col("payload_byte_offset").alias("byte_offset"), F.col("payload_byte_length").alias("byte_length"), F.col("payload_chunks").alias("chunks"), "payload_digest")
    one = last(b, "warc_custom_id")
    records = one.select(key("warc_custom_id").alias("id"), key("file_path").alias("warc_file_id"), "warc_record_id", "warc_custom_id", F.lit("response").alias("record_type"), F.col("warc_archived_date").alias("archived_date"), key("uri").alias("uri_id"), key("ip").alias("ip_id"), key("file_path", "payload_byte_offset", "payload_byte_length").alias("payload_id"), "payload_digest")
    responses = one.select(key(F.lit("response"), F.col("warc_custom_id")).alias("id"), key("warc_custom_id").alias("record_id"), F.col("http_status").alias("status"), key("content_type").alias("content_type_id"), F.col("http_headers").alias("headers"), F.col("http_last_modified").alias("last_modified"))
    type_sets = b.where("content_type is not null").groupBy(key("uri").alias("uri_id")).agg(F.array_sort(F.collect_set(key("content_type"))).alias("content_type_ids"))
    return {"warc_files": files, "ips": ips, "content_types": types, "uris": uris, "payloads": payloads, "records": records, "responses": responses, "uri_type_sets": type_sets}


def write_batch(batch: DataFrame, folder: str) -> dict[str, DataFrame]:
    """Append to each table of ``folder`` the rows whose id is not there yet; type sets are appended as sets and
    merged when read. Writing a batch twice changes nothing. Returns the rows that were new."""
    spark = batch.sparkSession
    fs = spark._jvm.org.apache.hadoop.fs
    new = {}
    for name, rows in star(valid_rows(batch)).items():
        path = f"{folder}/{name}"
        there = fs.Path(path)
        keys = ["uri_id", "content_type_ids"] if name == "uri_type_sets" else ["id"]
        if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
            rows = rows.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
        rows.write.mode("append").parquet(path)
        new[name] = rows
    return new


def refreshed_headers(old: Column, new: Column) -> Column:
    """Headers of a repeated upsert: the old ones, with the new ones over them."""
    mine, theirs = F.coalesce(new, F.create_map().cast("map<string,string>")), F.coalesce(old, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(theirs, lambda k, v: ~F.map_contains_key(mine, k)), mine)


def refreshed_responses(old: DataFrame, new: DataFrame) -> DataFrame:
    """Responses after a repeated upsert (both: record_id unique, status, headers, last_modified, content_type_id):
    new values where there are any, headers merged, a null date keeps the old one."""
    both = old.alias("o").join(new.alias("n"), "record_id", "full")
    pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)
    return both.select("record_id", pick("status"), refreshed_headers(F.col("o.headers"), F.col("n.headers")).alias("headers"), pick("last_modified"), pick("content_type_id"))
