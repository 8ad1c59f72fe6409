"""The queries of the WARC source: the pages written as archives of several shapes and read again; with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.functions import native as N
from archivolt.plans.runtime import checkpoint_dir, micros, table
from archivolt.sources import files, payloads, warc, warc_writer
from archivolt.streaming import ingest


#: Folders written so far, by session, tables and shape.
_FOLDERS: dict[tuple, str] = {}


def _written(spark: SparkSession, d: str, shape: str, whole: bool) -> str:
    """The pages as archives in the shared folder, written once a session."""
    key = (spark.sparkContext.applicationId, d, shape, whole)
    if key in _FOLDERS:
        return _FOLDERS[key]
    folder = f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    v = table(spark, d, "view_record")
    date = F.date_format("date_archived", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    pages = v.select(F.col("url").alias("uri"), date.alias("date"), "status", "content_type", F.col("payload").alias("body"), F.col("uuid").alias("identity"))
    warc_writer.write_warcs(pages, folder, shape=shape, whole=whole).agg(F.sum("records")).collect()
    warc.register(spark)
    _FOLDERS[key] = folder
    return folder


def _responses(spark: SparkSession, d: str, shape: str) -> DataFrame:
    rows = spark.read.format("warc").option("types", "response").load(_written(spark, d, shape, False))
    return rows.select(F.col("target_uri").alias("uri"), "status", F.col("record_id").alias("uuid"), micros(F.col("warc_date")).alias("archived_date_us"), F.col("payload_length").alias("n_bytes"))


def warc_scan(spark: SparkSession, d: str) -> DataFrame:
    return _responses(spark, d, "plain")


def warc_gz_scan(spark: SparkSession, d: str) -> DataFrame:
    return _responses(spark, d, "gz")


def _crawled(spark: SparkSession, d: str, shape: str, segment: int) -> DataFrame:
    rows = spark.read.format("warc").option("segmentBytes", segment).load(_written(spark, d, shape, True))
    return rows.select(F.col("target_uri").alias("uri"), "warc_type", "status", F.when(F.col("warc_type") == "response", F.col("record_id")).alias("uuid"), F.coalesce("is_chunked", F.lit(False)).alias("is_chunked"), F.coalesce(F.size("chunk_sizes"), F.lit(0)).alias("n_chunks"), F.col("error").isNull().alias("sound"), "skipped_bytes")


def warc_crawl_scan(spark: SparkSession, d: str) -> DataFrame:
    """Requests, responses (some in chunks), resources that quote a record, revisits; in segments smaller than many a
    record."""
    return _crawled(spark, d, "plain", 2_000)


def wacz_scan(spark: SparkSession, d: str) -> DataFrame:
    return _crawled(spark, d, "wacz", 1 << 26)


def _bodies(spark: SparkSession, d: str, shape: str) -> DataFrame:
    """From a capture to its body: out of its member, de-chunked and decoded."""
    rows = spark.read.format("warc").option("types", "response").load(_written(spark, d, shape, True))
    located = rows.withColumn("content_encoding", N.header("http_headers", "content-encoding"))
    return payloads.with_payloads(located, "record_id").select(F.col("id").alias("uuid"), F.md5("payload").alias("digest"), F.octet_length("payload").alias("n_bytes"), F.col("error").isNull().alias("sound"))


def warc_payloads(spark: SparkSession, d: str) -> DataFrame:
    return _bodies(spark, d, "plain")


def warc_gz_payloads(spark: SparkSession, d: str) -> DataFrame:
    return _bodies(spark, d, "gz")


def wacz_payloads(spark: SparkSession, d: str) -> DataFrame:
    return _bodies(spark, d, "wacz")


def warc_members(spark: SparkSession, d: str) -> DataFrame:
    """The members of the compressed archives, whether they lie without gaps, and what a listing says of the folder."""
    folder = _written(spark, d, "gz", True)
    members = files.member_table(spark, folder)
    per_file = members.groupBy("file_path").agg(F.count("*").alias("members"), F.sum("compressed_length").alias("compressed"), F.max(F.col("compressed_offset") + F.col("compressed_length")).alias("end"), F.sum("logical_length").alias("logical"), F.max(F.col("logical_offset") + F.col("logical_length")).alias("logical_end"))
    whole = per_file.agg(F.sum("members").alias("members"), F.bool_and((F.col("compressed") == F.col("end")) & (F.col("logical") == F.col("logical_end"))).alias("without_gaps"), F.sum("compressed").alias("bytes"))
    listed = files.folder_stats(spark, folder).first()["total_bytes"]
    return whole.select("members", "without_gaps", (F.col("bytes") == listed).alias("all_bytes"))


def warc_split_by_members(spark: SparkSession, d: str) -> DataFrame:
    """Compressed archives read in segments by a member index."""
    folder = _written(spark, d, "gz", False)
    index = f"{folder}-index-{uuid.uuid4().hex}"
    files.member_table(spark, folder).orderBy("file_path", "compressed_offset").coalesce(1).select(F.to_json(F.struct("file_path", "compressed_offset", "logical_offset")).alias("value")).write.text(index)
    part = next(p for p, _ in files.list_any(index) if "/part-" in p)
    rows = spark.read.format("warc").option("segmentBytes", 5_000).option("memberIndex", part).load(folder)
    return rows.select(F.col("target_uri").alias("uri"), "status", F.col("record_id").alias("uuid"), micros(F.col("warc_date")).alias("archived_date_us"), F.col("payload_length").alias("n_bytes"))


def wacz_index(spark: SparkSession, d: str) -> DataFrame:
    """The responses that the containers' indexes list."""
    return files.cdx_table(spark, _written(spark, d, "wacz", True)).select("status", F.regexp_replace("record", "^urn:uuid:", "").alias("uuid"), F.col("mime").alias("content_type"))


def warc_stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The growing archive streamed into the star schema, batch by batch: rows per table, and how far its files are."""
    source = _written(spark, d, "plain", True)
    star = f"{source}-{uuid.uuid4().hex}"
    total = sum(size for _, size in files.list_files(source))
    for _ in range(3):  # two batches, and one that finds nothing new
        ingest.start_ingest(spark, source, f"{star}-star", f"{star}-log", available_now=True, max_bytes=total // 2 + 1).awaitTermination()
    read = lambda name: spark.read.parquet(f"{star}-star/{name}")
    out = read("uris").agg(F.lit("uris").alias("table_name"), F.count("*").alias("n"), F.count_distinct("id").alias("keys"))
    for name in ("records", "responses", "payloads"):
        out = out.unionByName(read(name).agg(F.lit(name).alias("table_name"), F.count("*").alias("n"), F.count_distinct("id").alias("keys")))
    progress = ingest.file_progress(spark, f"{star}-star", source)
    return out.unionByName(progress.agg(F.lit("unfinished files").alias("table_name"), F.count_if(F.col("status") != "parsed").alias("n"), F.coalesce(F.sum(F.col("file_size") - F.col("byte_offset")), F.lit(0)).alias("keys")))


_NAMES = "warc_scan warc_gz_scan warc_crawl_scan wacz_scan warc_payloads warc_gz_payloads wacz_payloads warc_members warc_split_by_members wacz_index warc_stream_ingest"
QUERIES = {name: globals()[name] for name in _NAMES.split()}

_FLAT = r"array_to_string(list_filter(regexp_split_to_array({0}, '[ \t\r\n]+'), lambda x: x <> ''), ' ')"
_HELD = f"held as (select *, {_FLAT.format('url')} uri, lower(uuid) id, octet_length(encode(payload)) n from view_record where url is not null and payload is not null)"
_SCAN = f"with {_HELD} select uri, coalesce(status, 200) status, id uuid, epoch_us(date_archived) archived_date_us, n n_bytes from held"
_CRAWL = f"""with {_HELD} select uri, t warc_type, case when t = 'response' then coalesce(status, 200) end status, case when t = 'response' then id end uuid, t = 'response' and n % 2 = 1 is_chunked,
  cast(case when t = 'response' and n % 2 = 1 then ceil(n / 100.0) else 0 end as integer) n_chunks, true sound, 0 skipped_bytes from held, (select unnest(['request', 'response', 'resource', 'revisit']) t)"""
_BODIES = f"with {_HELD} select id uuid, md5(encode(payload)) digest, n n_bytes, true sound from held"
SQL = {
    "warc_scan": _SCAN, "warc_gz_scan": _SCAN, "warc_split_by_members": _SCAN, "warc_crawl_scan": _CRAWL, "wacz_scan": _CRAWL, "warc_payloads": _BODIES, "warc_gz_payloads": _BODIES, "wacz_payloads": _BODIES,
    "warc_members": f"with {_HELD} select 4 * count(*) members, true without_gaps, true all_bytes from held",
    "wacz_index": f"with {_HELD} select coalesce(status, 200) status, uuid, coalesce(nullif(replace({_FLAT.format('content_type')}, ' ', ''), ''), '-') content_type from held",
    "warc_stream_ingest": f"""with {_HELD}, good as (select * from held where trim(uri) <> '') select 'uris' table_name, count(distinct uri) n, count(distinct uri) "keys" from good
union all select t, count(*), count(*) from good, (select unnest(['records', 'responses', 'payloads']) t) group by t union all select 'unfinished files', 0, 0""",
}
