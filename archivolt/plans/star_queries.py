"""The queries over the star that an ingest writes, upserts, point gets and single records; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.functions import native as N
from archivolt.operators import archive as A
from archivolt.operators import ingest, progress, redirects
from archivolt.operators.archive import Archive
from archivolt.plans.archive_queries import _EDGES, _LOCATION, _STAR, _VALID, MOMENT
from archivolt.plans.runtime import micros, table


def _bulk(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "warc_response_bulk_input")


def _star(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return ingest.star(ingest.valid_rows(_bulk(spark, d)))


def star_captures(spark: SparkSession, d: str) -> DataFrame:
    """Records with their URIs, files, addresses and payload places."""
    p = A.record_payloads(_star(spark, d))
    return p.select("warc_custom_id", "uri", "file_path", "ip", micros(F.col("archived_date")).alias("archived_date_us"), "byte_offset", "byte_length", F.coalesce(F.size("chunks"), F.lit(-1)).alias("n_chunks"))


def payload_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The payload places of a list of records, in the order of the list; unknown ones have none."""
    b = _bulk(spark, d)
    ids = [r[0] for r in b.where("warc_custom_id is not null and trim(warc_custom_id) <> ''").select("warc_custom_id").distinct().orderBy("warc_custom_id").limit(40).collect()]
    return A.payloads_of(_star(spark, d), [*ids, "unknown::id"]).select("ordinal", "warc_custom_id", "file_path", "byte_offset", "byte_length")


def response_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Responses of the history after the same captures have come again in later batches."""
    b = _bulk(spark, d).where("uri is not null and trim(uri) <> ''")
    one = lambda df: A.last_written(df.select(F.col("uri").alias("record_id"), F.col("http_status").alias("status"), F.col("http_headers").alias("headers"), F.col("http_last_modified").alias("last_modified"), F.col("http_content_type").alias("content_type_id"), "row_id"), "record_id", "row_id")
    out = ingest.refreshed_responses(one(b.where("batch_id = 1")), one(b.where("batch_id > 1")))
    return out.select(F.col("record_id").alias("uri"), "status", F.size("headers").alias("n_headers"), F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws("=", e["key"], e["value"])), "\n").alias("headers"), micros(F.col("last_modified")).alias("last_modified_us"), F.col("content_type_id").alias("content_type"))


def point_gets(spark: SparkSession, d: str) -> DataFrame:
    """One row of each table by its natural key."""
    a = Archive.read(spark, d)
    out = None
    for name, column in (("uris", "uri"), ("content_types", "type"), ("warc_files", "file_path"), ("records", "warc_custom_id")):
        rows = (a.rows("records", "warc_custom_id") if name == "records" else getattr(a, name)).where(F.col(column).isNotNull())
        key = rows.agg(F.min(column)).first()[0]
        got = a.get(name, **{column: key}).select(F.lit(name).alias("table_name"), "id")
        out = got if out is None else out.unionByName(got)
    return out


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests of their own for half of the responses, by status; the others are found by record only."""
    r = A.last_written(table(spark, d, "responses").select("id", "record_id", "status", "created_at"), "id", "created_at", "record_id")
    return r.select("id", "record_id", F.when(F.col("status") < 400, "GET").otherwise("HEAD").alias("method"))


def record_requests(spark: SparkSession, d: str) -> DataFrame:
    """The first record's detail with its request."""
    a = Archive.read(spark, d)
    first = a.captures(["warc_custom_id"]).agg(F.min("warc_custom_id")).first()[0] or ""
    return a.detail(first, _requests(spark, d)).select("record_id", "warc_custom_id", "status", "is_redirect", "method").distinct()


def _redirecting(a: Archive) -> tuple[str, str]:
    """The first URI, and its first record, that answers with a redirect."""
    c = a.captures(["warc_custom_id", "uri", "status", "headers"]).where(N.is_redirect("status") & N.header("headers", "location").isNotNull())
    row = c.orderBy("uri", "warc_custom_id").select("uri", "warc_custom_id").first()
    return tuple(row) if row else ("", "")


def redirect_from_uri(spark: SparkSession, d: str) -> DataFrame:
    """The redirect path that begins at the capture of a URI nearest to a moment."""
    a = Archive.read(spark, d)
    return redirects.path_from(a, _redirecting(a)[0], MOMENT).select("hop", "response_id", "uri", "resolved_location", "warc_custom_id")


def detail_chain(spark: SparkSession, d: str) -> DataFrame:
    a = Archive.read(spark, d)
    return a.detail_chain(_redirecting(a)[1]).select("start_id", "hop", "response_id", "uri")


def low_watermark(spark: SparkSession, d: str) -> DataFrame:
    """Where each file can be resumed if every payload is a unit of work, of which those without a date are in flight."""
    b = _bulk(spark, d).where("payload_byte_offset is not null and payload_byte_length is not null and file_path is not null")
    work = b.select(F.col("file_path").alias("file_id"), F.col("payload_byte_offset").alias("start"), (F.col("payload_byte_offset") + F.col("payload_byte_length")).alias("end"), F.col("warc_archived_date").isNotNull().alias("finished"))
    return progress.low_watermark(work)


_NAMES = "star_captures payload_lookup response_upsert point_gets record_requests redirect_from_uri detail_chain low_watermark"
QUERIES = {name: globals()[name] for name in _NAMES.split()}

_ONE = f"""with {_VALID}, one as (select * from good qualify row_number() over (partition by warc_custom_id order by row_id desc) = 1),
pay as (select * from good where file_path is not null and payload_byte_offset is not null and payload_byte_length is not null qualify row_number() over (partition by file_path, payload_byte_offset, payload_byte_length order by row_id desc) = 1),
whole as (select o.warc_custom_id, o.uri, o.file_path, o.ip, epoch_us(o.warc_archived_date) archived_date_us, p.payload_byte_offset byte_offset, p.payload_byte_length byte_length, cast(coalesce(len(p.payload_chunks), -1) as integer) n_chunks
  from one o left join pay p on p.file_path = o.file_path and p.payload_byte_offset = o.payload_byte_offset and p.payload_byte_length = o.payload_byte_length)"""
_FIRST = f"red as (select uri, warc_custom_id from cap where status between 300 and 399 and {_LOCATION} is not null order by uri, warc_custom_id limit 1)"
_WALK = """path as (select response_id start_id, 1 hop, response_id, uri, cast(null as varchar) resolved_location, [uri] seen from begin
  union all select p.start_id, p.hop + 1, c.response_id, c.uri, e.target, list_append(p.seen, c.uri) from path p join edges e on e.response_id = p.response_id join cap c on c.response_id = e.next_id where p.hop < 20 and not list_contains(p.seen, c.uri))"""
_RECURSIVE = _STAR.replace("with rec", "with recursive rec", 1)
SQL = {
    "star_captures": _ONE + " select * from whole",
    "payload_lookup": _ONE + """, ids as (select distinct warc_custom_id from warc_response_bulk_input where warc_custom_id is not null and trim(warc_custom_id, ' ') <> '' order by 1 limit 40),
asked as (select cast(row_number() over (order by warc_custom_id) - 1 as integer) ordinal, warc_custom_id from ids union all select cast(count(*) as integer), 'unknown::id' from ids)
select ordinal, a.warc_custom_id, file_path, byte_offset, byte_length from asked a left join whole w on w.warc_custom_id = a.warc_custom_id""",
    "response_upsert": """with b as (select * from warc_response_bulk_input where uri is not null and trim(uri, ' ') <> ''),
o as (select * from b where batch_id = 1 qualify row_number() over (partition by uri order by row_id desc) = 1), n as (select * from b where batch_id > 1 qualify row_number() over (partition by uri order by row_id desc) = 1),
j as (select coalesce(n.uri, o.uri) uri, coalesce(n.http_status, o.http_status) status, coalesce(n.http_last_modified, o.http_last_modified) lm, coalesce(n.http_content_type, o.http_content_type) content_type,
  list_concat(list_filter(coalesce(map_entries(o.http_headers), []), lambda e: not list_contains(coalesce(map_keys(n.http_headers), []), e.key)), coalesce(map_entries(n.http_headers), [])) es from o full join n on o.uri = n.uri)
select uri, status, cast(len(es) as integer) n_headers, array_to_string(list_transform(list_sort(es), lambda e: e.key || '=' || e.value), chr(10)) headers, epoch_us(lm) last_modified_us, content_type from j""",
    "point_gets": " union all ".join(f"select '{t}' table_name, id from {t} where {c} = (select min({c}) from {t})" for t, c in (("uris", "uri"), ("content_types", "type"), ("warc_files", "file_path")))
    + " union all select 'records', id from (select * from records qualify row_number() over (partition by id order by created_at desc, warc_custom_id desc) = 1) where warc_custom_id = (select min(warc_custom_id) from (select * from records qualify row_number() over (partition by id order by created_at desc, warc_custom_id desc) = 1))",
    "record_requests": _STAR + ", first as (select min(warc_custom_id) w from cap) select distinct c.id record_id, c.warc_custom_id, s.status, coalesce(s.status between 300 and 399, false) is_redirect, case when q.status < 400 then 'GET' when q.id is not null then 'HEAD' end \"method\" from rec c left join res s on s.record_id = c.id left join res q on q.record_id = c.id where c.warc_custom_id = (select w from first)",
    "redirect_from_uri": _RECURSIVE + f", {_EDGES}, {_FIRST}, begin as (select * from cap where uri = (select uri from red) order by abs(epoch_us(archived_date) - epoch_us(timestamptz '{MOMENT}')), archived_date, response_id limit 1), {_WALK} select hop, p.response_id, p.uri, resolved_location, c.warc_custom_id from path p join cap c on c.response_id = p.response_id",
    "detail_chain": _RECURSIVE + f", {_EDGES}, {_FIRST}, begin as (select * from cap where warc_custom_id = (select warc_custom_id from red) and status between 300 and 399), {_WALK} select start_id, hop, response_id, uri from path",
    "low_watermark": "select file_path file_id, coalesce(min(case when warc_archived_date is null then payload_byte_offset end), max(payload_byte_offset + payload_byte_length)) safe_offset from warc_response_bulk_input where payload_byte_offset is not null and payload_byte_length is not null and file_path is not null group by file_path",
}
