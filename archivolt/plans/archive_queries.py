"""The archive's own queries over whole tables, with their SQL. Times are given in microseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.functions import native as N
from archivolt.functions import web
from archivolt.operators import archive as A
from archivolt.operators import closure, ingest, progress, redirects, view
from archivolt.operators.archive import Archive
from archivolt.plans.runtime import micros, table

TERM, TYPE, MOMENT = "amber-drumlin", "text/html", "2024-01-10T12:00:00Z"


def _flat(df: DataFrame, *columns: str) -> DataFrame:
    """The columns, times as microseconds under ``<name>_us``."""
    return df.select(*[micros(F.col(c)).alias(f"{c}_us") if c in ("archived_date", "last_modified", "moment") else F.col(c) for c in columns])


def _searched(df: DataFrame, *more: str) -> DataFrame:
    return _flat(df, *A.SEARCH_COLUMNS, *more)


def _archive(spark: SparkSession, d: str) -> Archive:
    return Archive.read(spark, d)


def _hot_uri(a: Archive) -> str:
    """The URI with most records; of equals, the first by name."""
    top = a.rows("records", "uri_id").groupBy(F.col("uri_id").alias("id")).agg(F.count("*").alias("n")).join(a.uris.select("id", "uri"), "id")
    row = top.orderBy(F.desc("n"), "uri").select("uri").first()
    return row[0] if row else ""


def _cursor(a: Archive) -> tuple[int | None, str | None]:
    """The cursor behind the first page: its last URI."""
    page = a.next_cursor(TERM).first()
    return tuple(page) if page else (None, None)


def search_page(s, d):
    return _searched(_archive(s, d).search(TERM, 8, 16))


def search_page_typed(s, d):
    return _searched(_archive(s, d).search(TERM, 0, 16, TYPE))


def browse_page(s, d):
    return _searched(_archive(s, d).search(None, 20, 20))


def browse_page_typed(s, d):
    return _searched(_archive(s, d).search(None, 0, 20, "css"))


def search_escaped(s, d):
    return _searched(_archive(s, d).search("%_", 0, 50))


def search_after_page(s, d):
    a = _archive(s, d)
    return _searched(a.search_after(TERM, *_cursor(a)), "recursion_level")


def search_first_page(s, d):
    return _searched(_archive(s, d).search_after(TERM), "recursion_level")


def search_cursor(s, d):
    return _archive(s, d).next_cursor(TERM)


def search_count_capped(s, d):
    return _archive(s, d).search_count("example")


def search_count_small_cap(s, d):
    return _archive(s, d).search_count("example", cap=50)


def search_count_typed(s, d):
    return _archive(s, d).search_count(TERM, TYPE)


def browse_count(s, d):
    return _archive(s, d).search_count()


def search_groups(s, d):
    a = _archive(s, d)
    g = a.search_groups(a.search(TERM, 0, 16))
    return g.select("uri", "captures", F.posexplode("response_ids").alias("place", "response_id"))


def content_types(s, d):
    return _archive(s, d).base_types()


def content_type_parts(s, d):
    return table(s, d, "content_types").select("id", N.content_type_base("type").alias("base_type"), N.content_type_charset("type").alias("charset"), N.essence("type").alias("essence"), N.document_kind("type").alias("kind"))


def type_set_ids(s, d):
    return _archive(s, d).type_ids(TYPE)


def uri_levels(s, d):
    return table(s, d, "uris").select("uri", N.recursion_level("uri").alias("level"))


def uri_level_distribution(s, d):
    levels = table(s, d, "uris").groupBy(N.recursion_level("uri").alias("level")).agg(F.count("*").alias("n"))
    total = levels.agg(F.sum("n").alias("total"))
    return levels.join(F.broadcast(total)).select("level", "n", F.round(100.0 * F.col("n") / F.col("total"), 2).alias("percent"))


def uri_fragments(s, d):
    u = table(s, d, "uris")
    return u.select("uri", N.strip_fragment("uri").alias("document"), N.fragment_of("uri").alias("fragment"), N.basename(N.strip_fragment("uri")).alias("name"))


def uri_sort_position(s, d):
    a = _archive(s, d)
    return a.uri_sort_position(_hot_uri(a))


def uri_type_sets(s, d):
    return _archive(s, d).derived_type_sets().select("uri_id", F.posexplode("derived_ids").alias("place", "content_type_id"))


def uri_type_set_mismatch(s, d):
    return _archive(s, d).type_set_mismatches()


def uri_type_set_merge(s, d):
    a = _archive(s, d)
    stored = a.uris.select(F.col("id").alias("uri_id"), F.coalesce(F.filter("content_type_ids", lambda x: x.isNotNull()), F.array().cast("array<bigint>")).alias("stored"))
    merged = stored.join(a.derived_type_sets(), "uri_id").select("uri_id", F.array_sort(F.array_distinct(A.merged_type_sets(F.col("stored"), F.col("derived_ids")))).alias("ids"))
    return merged.select("uri_id", F.explode("ids").alias("content_type_id"))


LATEST = ("response_id", "status", "http_version", "last_modified", "archived_date", "warc_custom_id", "uri", "content_type")


def latest(s, d):
    return _flat(_archive(s, d).latest(), *LATEST)


def latest_typed(s, d):
    return _flat(_archive(s, d).latest("css", 20), *LATEST)


def near_single(s, d):
    a = _archive(s, d)
    return _flat(a.near(_hot_uri(a), MOMENT), "response_id", "uri", "archived_date", "gap_us")


def near_record(s, d):
    a = _archive(s, d)
    return _flat(a.near_record(_hot_uri(a), MOMENT), "id", "warc_custom_id", "record_type", "archived_date", "gap_us")


def near_bulk(s, d):
    """For every record its nearest capture of the same URI ten days later."""
    a = _archive(s, d)
    asked = a.rows("records", "uri_id", "archived_date").join(a.uris.select(F.col("id").alias("uri_id"), "uri"), "uri_id").select("uri", F.expr("archived_date + interval 10 days").alias("moment"), F.col("id").alias("request_id"))
    return A.nearest(asked, a.captures(["uri", "archived_date", "response_id"]), ["request_id"]).select("request_id", "response_id")


def near_follow_redirect(s, d):
    a = _archive(s, d)
    row = a.captures(["uri", "status", "headers", "response_id"]).where(N.is_redirect("status") & N.header("headers", "location").isNotNull()).orderBy("uri").select("uri").first()
    return a.near_following(row[0] if row else "", MOMENT)


HISTORY = ("response_id", "warc_custom_id", "uri", "archived_date", "status", "http_version", "last_modified", "content_type")


def history(s, d):
    a = _archive(s, d)
    return _flat(a.history(_hot_uri(a)), *HISTORY)


def _first_custom_id(a: Archive) -> str:
    row = a.captures(["warc_custom_id"]).agg(F.min("warc_custom_id")).first()
    return row[0] or ""


def site_responses_by_id(s, d):
    a = _archive(s, d)
    return _flat(a.site_responses(warc_custom_id=_first_custom_id(a) or "-"), *HISTORY, "file_path")


def site_responses_by_uri(s, d):
    a = _archive(s, d)
    return _flat(a.site_responses(uri=_hot_uri(a) or "-"), *HISTORY, "file_path")


def record_detail(s, d):
    a = _archive(s, d)
    return _flat(a.detail(_first_custom_id(a)), "record_id", "warc_custom_id", "record_type", "archived_date", "uri", "response_id", "status", "http_version", "is_redirect")


def response_history(s, d):
    return _flat(_archive(s, d).response_history(), *HISTORY)


def batch_lookup(s, d):
    a = _archive(s, d)
    ids = [r[0] for r in a.captures(["warc_custom_id"]).orderBy(F.desc("warc_custom_id")).limit(5).collect()]
    return a.batch([*ids, "unknown::id"]).select("ordinal", "warc_custom_id", "response_id", "status", "uri")


def redirect_edges(s, d):
    return redirects.redirect_edges(_archive(s, d).captures(["response_id", "uri", "archived_date", "last_modified", "headers"]))


def redirect_paths(s, d):
    c = _archive(s, d).captures(["response_id", "uri", "archived_date", "last_modified", "headers", "status"])
    starts = c.where(N.is_redirect("status"))
    return redirects.redirect_paths(c, starts)


def header_lookup(s, d):
    r = A.last_written(table(s, d, "responses"), "id", "created_at", "record_id")
    return r.select("id", N.header("headers", "Content-Type").alias("content_type"), N.header("headers", "location").alias("location"), N.header("headers", "server").alias("server"))


def location_targets(s, d):
    h = table(s, d, "response_history").select("uri", N.header("headers", "location").alias("location")).where("uri is not null").distinct()
    return h.select("uri", "location", N.resolve_location("location", "uri").alias("target"), N.non_fetchable("location").alias("non_fetchable"))


# -- ingest ------------------------------------------------------------------------


def _bulk(s, d):
    return table(s, d, "warc_response_bulk_input")


def ingest_invalid(s, d):
    return ingest.invalid_rows(_bulk(s, d)).select("row_id", "reason")


def ingest_duplicate_ids(s, d):
    return ingest.duplicate_ids(_bulk(s, d))


def ingest_last_wins(s, d):
    b = _bulk(s, d).where("uri is not null and trim(uri) <> ''")
    return A.last_written(b.select("uri", "row_id", "recursion_level"), "uri", "row_id").select("uri", "row_id", N.recursion_level("uri").alias("level"))


def ingest_dimensions(s, d):
    star = ingest.star(ingest.valid_rows(_bulk(s, d)))
    parts = [star[name].agg(F.lit(name).alias("table_name"), F.count("*").alias("n"), F.count_distinct("id").alias("keys")) for name in ("warc_files", "ips", "content_types", "uris", "payloads", "records", "responses")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ingest_payload_last_wins(s, d):
    p = ingest.star(ingest.valid_rows(_bulk(s, d)))["payloads"]
    return p.select("byte_offset", "byte_length", "payload_digest")


def ingest_new_uris(s, d):
    """URIs of later batches that the history batch has not."""
    b = _bulk(s, d).where("uri is not null")
    return b.where("batch_id > 1").select("uri").distinct().join(b.where("batch_id = 1").select("uri"), "uri", "left_anti")


def uuid_and_target(s, d):
    b = _bulk(s, d)
    wrapped = F.concat(F.lit("<urn:uuid:"), F.col("warc_record_id"), F.lit(">"))
    return b.select("row_id", N.record_uuid(wrapped).alias("uuid"), N.target_uri(F.concat(F.lit("<"), F.col("uri"), F.lit(">"))).alias("target"))


def table_sizes(s, d):
    parts = [table(s, d, t).agg(F.lit(t).alias("table_name"), F.count("*").alias("n")) for t in ("content_types", "uris", "warc_files", "records", "responses")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# -- progress: states and sizes by the files' numbers; a file without a warcinfo record has no progress yet ------------------------


def _progress(s, d):
    f = table(s, d, "warc_files")
    k = F.col("id") % 4
    status = F.element_at(F.array(*map(F.lit, ("pending", "parsing", "parsed", "error"))), (k + 1).cast("int"))
    size = F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") * 1000)
    offset = F.when(k == 0, 0).when((k == 1) & (F.col("id") % 8 == 1), 0).when(k == 2, F.col("id") * 1000).otherwise(F.col("id") * 300)
    return f.where("warcinfo_id is not null").select(F.col("id").alias("file_id"), status.alias("status"), offset.cast("bigint").alias("byte_offset"), size.cast("bigint").alias("file_size"), (offset / 100).cast("bigint").alias("records"), F.lit(None).cast("string").alias("error"))


def _plan(s, d):
    return progress.parse_plan(table(s, d, "warc_files"), _progress(s, d))


def parse_plan(s, d):
    return _plan(s, d).drop("error")


def progress_rollup(s, d):
    return progress.rollup(_plan(s, d))


def progress_page(s, d):
    return progress.page(_plan(s, d), None, 3, 10).drop("error")


def progress_errors(s, d):
    return progress.page(_plan(s, d), "error").drop("error")


def parse_work(s, d):
    """Files without metadata are those that have vanished."""
    f = table(s, d, "warc_files").where(F.size("metadata") > 0)
    shift = F.when(F.col("id") % 3 == 0, 500).when(F.col("id") % 3 == 1, 0).otherwise(-500)
    return progress.parse_work(_plan(s, d), f.select("file_path", (F.col("id") * 1000 + shift).alias("size")))


def checkpoint_advance(s, d):
    p = _progress(s, d)
    return progress.advance(p, p.select("file_id", (F.col("file_id") * 500).alias("byte_offset"), (F.col("file_id") * 7).alias("records")))


# -- bodies --------------------------------------------------------------------------------


def range_requests(s, d):
    v = table(s, d, "view_record").where("payload_size is not null").select("view_id", "payload_size")
    forms = F.array(*map(F.lit, ("bytes=0-99", "bytes=500-", "bytes=-200", "bytes=5-2", "bytes=1-2,4-5", "bytes=999999999-", "bytes=-0", "chunks=1-2", "bytes=100-999999999")))
    asked = v.select("view_id", "payload_size", F.explode(forms).alias("range_header"))
    return asked.withColumn("r", N.byte_range("range_header", "payload_size")).select("view_id", "range_header", "r.status", F.col("r.start").alias("first_byte"), F.col("r.end").alias("last_byte"))


def chunk_ranges(s, d):
    b = _bulk(s, d).where(F.size("payload_chunks") > 0)
    return b.select("row_id", F.posexplode(N.chunk_ranges("payload_chunks")).alias("place", "r")).select("row_id", "place", F.col("r.start").alias("first_byte"), F.col("r.length").alias("n_bytes"))


def chunk_size_literals(s, d):
    b = _bulk(s, d).where(F.size("payload_chunks") > 0)
    literal = F.concat(F.lit("{0,"), F.array_join(F.transform("payload_chunks", lambda x: x.cast("string")), ", "), F.lit(",x}"))
    return b.select("row_id", F.posexplode(N.chunk_sizes(literal)).alias("place", "n_bytes"))


def short_reads(s, d):
    """Ledger of stored slices against each file's extent, taken as the end of its last slice less 20,000 bytes."""
    b = _bulk(s, d).where("payload_byte_offset is not null and payload_byte_length is not null")
    ends = b.groupBy("file_path").agg((F.max(F.col("payload_byte_offset") + F.col("payload_byte_length")) - 20000).alias("extent"))
    there = F.greatest(F.lit(0), F.least(F.col("payload_byte_length"), F.col("extent") - F.col("payload_byte_offset")))
    return b.join(ends, "file_path").select("row_id", there.cast("bigint").alias("available"), (there != F.col("payload_byte_length")).alias("short_read"))


def ledger_summary(s, d):
    b = _bulk(s, d)
    stored = F.col("payload_byte_offset").isNotNull() & F.col("payload_byte_length").isNotNull()
    return b.groupBy("batch_id").agg(F.count("*").alias("requested"), F.count_if(stored).alias("stored"), F.count_if(~stored).alias("missing"), F.coalesce(F.sum(F.when(stored, F.col("payload_byte_length"))), F.lit(0)).alias("payload_bytes"))


def budget_prefix(s, d):
    """Per batch the entries that fit a budget of 30 entries and 400,000 bytes, in request order."""
    from archivolt.operators.export import within_budget

    b = _bulk(s, d).where("payload_byte_length is not null")
    return within_budget(b, "batch_id", "row_id", "payload_byte_length", 30, 400_000).select("batch_id", "row_id")


def digest_merge(s, d):
    """Payloads of one digest and type are one entry; the others are its aliases."""
    b = _bulk(s, d).where("payload_digest is not null and uri is not null")
    return b.groupBy("payload_digest", "http_content_type").agg(F.min("row_id").alias("entry_id"), (F.count("*") - 1).alias("aliases"))


def zip_size(s, d):
    """The exact size of a stored archive with one entry per page, computed from names and sizes."""
    from archivolt.operators.export import stored_zip_size

    v = table(s, d, "view_record").where("payload is not null")
    return stored_zip_size(v.select(F.concat(F.lit("pages/"), F.col("view_id").cast("string"), F.lit(".html")).alias("name"), F.octet_length("payload").alias("size")))


def page_links(s, d):
    v = table(s, d, "view_record").where("payload is not null")
    return v.select("view_id", F.explode(F.regexp_extract_all("payload", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href")).groupBy("view_id", "href").agg(F.count("*").alias("n"))


_NAMES = """search_page search_page_typed browse_page browse_page_typed search_escaped search_after_page search_first_page search_cursor
search_count_capped search_count_small_cap search_count_typed browse_count search_groups content_types content_type_parts type_set_ids uri_levels
uri_level_distribution uri_fragments uri_sort_position uri_type_sets uri_type_set_mismatch uri_type_set_merge latest latest_typed near_single near_record
near_bulk near_follow_redirect history site_responses_by_id site_responses_by_uri record_detail response_history batch_lookup redirect_edges redirect_paths
header_lookup location_targets ingest_invalid ingest_duplicate_ids ingest_last_wins ingest_dimensions ingest_payload_last_wins ingest_new_uris
uuid_and_target table_sizes parse_plan progress_rollup progress_page progress_errors parse_work checkpoint_advance range_requests chunk_ranges
chunk_size_literals short_reads ledger_summary budget_prefix digest_merge zip_size page_links"""
QUERIES = {name: globals()[name] for name in _NAMES.split()}

# -- the same in SQL ------------------------------------------------------------------------------

_STAR = """with rec as (select * from records qualify row_number() over (partition by id order by created_at desc, warc_custom_id desc) = 1),
res as (select * from responses qualify row_number() over (partition by id order by created_at desc, record_id desc) = 1),
cap as (select s.id response_id, s.record_id, s.status, s.http_version, s.content_type_id, s.headers, s.last_modified, c.warc_file_id, c.warc_custom_id, c.record_type,
  c.archived_date, c.uri_id, u.uri, u.recursion_level, t.type content_type, f.file_path
  from res s join rec c on s.record_id = c.id join uris u on u.id = c.uri_id left join content_types t on t.id = s.content_type_id left join warc_files f on f.id = c.warc_file_id),
hot as (select u.uri from rec c join uris u on u.id = c.uri_id group by u.uri order by count(*) desc, u.uri limit 1)
"""
_TIMES = "epoch_us(last_modified) last_modified_us, epoch_us(archived_date) archived_date_us"
_ROW = f"response_id, status, {_TIMES}, warc_custom_id, uri"
_HIST = f"response_id, warc_custom_id, uri, epoch_us(archived_date) archived_date_us, status, http_version, epoch_us(last_modified) last_modified_us, content_type"
_TERM = f"contains(lower(uri), '{TERM}')"


def _types(p: str) -> str:
    return f"(select list(id) from content_types where base_type = '{p}' or contains(lower(type), '{p}'))"


def _page(where: str, offset: int, limit: int, typed: str = "", more: str = "") -> str:
    captures = f" and list_contains({typed}, content_type_id)" if typed else ""
    return _STAR + f", page as (select id from uris where {where} order by recursion_level, uri limit {limit} offset {offset}) select {_ROW}{more} from cap where uri_id in (select id from page){captures}"


_CURSOR = f"(select recursion_level, uri from uris where {_TERM} order by recursion_level, uri limit 1 offset 15)"
_LOCATION = "coalesce(headers['location'], headers['Location'])"
_TARGET = r"""case when location is null then null when starts_with(location, '//') then regexp_extract(uri, '^([A-Za-z][A-Za-z0-9+.\-]*:)', 1) || location
  when starts_with(location, '/') then regexp_extract(uri, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)', 1) || location
  when regexp_matches(location, '^[A-Za-z][A-Za-z0-9+.\-]*:') then location else regexp_extract(uri, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)', 1) || '/' || location end"""
_LEVEL = r"len(list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(uri, '^(?i)[a-z][a-z0-9+.\-]*://', ''), '^[^/?#]*', ''), '(?s)[?#].*$', ''), '/'), lambda x: x <> ''))"
_EDGES = f"""located as (select response_id, uri, {_LOCATION} location, epoch_us(coalesce(last_modified, archived_date)) t from cap where {_LOCATION} is not null),
aimed as (select response_id, t, {_TARGET} target from located),
edges as (select a.response_id, any_value(a.target) target, arg_min(c.response_id, (abs(epoch_us(coalesce(c.last_modified, c.archived_date)) - a.t), epoch_us(coalesce(c.last_modified, c.archived_date)), c.response_id)) next_id
  from aimed a left join cap c on c.uri = a.target group by a.response_id)"""
_VALID = """bulk as (select * from warc_response_bulk_input),
twice as (select batch_id, warc_custom_id from bulk where warc_custom_id is not null group by all having count(*) > 1),
bad as (select row_id, case when uri is null or trim(uri, ' ') = '' then 'blank uri' when b.warc_custom_id is null or trim(b.warc_custom_id, ' ') = '' then 'blank id' when t.warc_custom_id is not null then 'repeated id' end reason
  from bulk b left join twice t on b.batch_id = t.batch_id and b.warc_custom_id = t.warc_custom_id),
good as (select * from bulk where row_id not in (select row_id from bad where reason is not null))"""
_PROGRESS = """prog as (select id file_id, ['pending','parsing','parsed','error'][(id % 4) + 1] status,
  cast(case when id % 4 = 0 then 0 when id % 4 = 1 and id % 8 = 1 then 0 when id % 4 = 2 then id * 1000 else id * 300 end as bigint) byte_offset,
  cast(case when id % 7 = 0 then null else id * 1000 end as bigint) file_size from warc_files where warcinfo_id is not null),
progress as (select *, byte_offset // 100 records from prog),
plan as (select f.id file_id, f.file_path, coalesce(p.status, 'pending') status, coalesce(byte_offset, 0) byte_offset, file_size, coalesce(records, 0) records from warc_files f left join progress p on p.file_id = f.id)"""
_RANK = "list_position(['parsing','error','pending','parsed'], status)"
_PCT = "case when file_size > 0 then round(100.0 * byte_offset / file_size, 2) end percent"

SQL = {
    "search_page": _page(_TERM, 8, 16),
    "search_page_typed": _page(f"{_TERM} and list_has_any(content_type_ids, {_types(TYPE)})", 0, 16, _types(TYPE)),
    "browse_page": _page("true", 20, 20),
    "browse_page_typed": _page(f"list_has_any(content_type_ids, {_types('css')})", 0, 20, _types("css")),
    "search_escaped": _page("contains(uri, '%_')", 0, 50),
    "search_after_page": _page(f"{_TERM} and row(recursion_level, uri) > (select row(recursion_level, uri) from {_CURSOR})", 0, 16, "", ", recursion_level"),
    "search_first_page": _page(_TERM, 0, 16, "", ", recursion_level"),
    "search_cursor": f"select * from {_CURSOR}",
    "search_count_capped": "select count(*) n from (select 1 from uris where contains(lower(uri), 'example') limit 10001)",
    "search_count_small_cap": "select count(*) n from (select 1 from uris where contains(lower(uri), 'example') limit 50)",
    "search_count_typed": f"select count(*) n from (select 1 from uris where {_TERM} and list_has_any(content_type_ids, {_types(TYPE)}) limit 10001)",
    "browse_count": "select count(*) n from uris",
    "search_groups": _STAR + f""", page as (select id from uris where {_TERM} order by recursion_level, uri limit 16)
select uri, count(*) over (partition by uri) captures, cast(row_number() over (partition by uri order by archived_date desc, response_id desc) - 1 as integer) place, response_id from cap where uri_id in (select id from page)""",
    "content_types": "select distinct nullif(lower(trim(split_part(type, ';', 1), ' ')), '') content_type from content_types where trim(type, ' ') <> '' and nullif(lower(trim(split_part(type, ';', 1), ' ')), '') is not null",
    "content_type_parts": """select id, nullif(e, '') base_type, nullif(regexp_replace(regexp_extract(lower(type), 'charset\\s*=\\s*([^;]+)', 1), '[ "]', '', 'g'), '') charset, e essence,
  case when e in ('text/html', 'application/xhtml+xml') then 'html' when e = 'text/css' then 'css' when e in ('text/javascript', 'application/javascript', 'application/x-javascript', 'application/ecmascript') then 'js' else 'other' end kind
  from (select *, lower(trim(split_part(type, ';', 1), ' ')) e from content_types)""",
    "type_set_ids": f"select unnest({_types(TYPE)}) content_type_id",
    "uri_levels": f"select uri, cast({_LEVEL} as integer) \"level\" from uris",
    "uri_level_distribution": f"select cast({_LEVEL} as integer) \"level\", count(*) n, round(100.0 * count(*) / sum(count(*)) over (), 2) percent from uris group by 1",
    "uri_fragments": "select uri, split_part(uri, '#', 1) document, case when strpos(uri, '#') = 0 or substr(uri, strpos(uri, '#')) = '#' then '' else substr(uri, strpos(uri, '#')) end fragment, split_part(split_part(uri, '#', 1), '/', -1) \"name\" from uris",
    "uri_sort_position": _STAR + "select recursion_level from uris where uri = (select uri from hot)",
    "uri_type_sets": _STAR + "select uri_id, cast(row_number() over (partition by uri_id order by content_type_id) - 1 as integer) place, content_type_id from (select distinct uri_id, content_type_id from cap where content_type_id is not null)",
    "uri_type_set_mismatch": _STAR + ", d as (select distinct uri_id, content_type_id from cap where content_type_id is not null) select uri_id, cast(count(*) as integer) missing_types from d join uris u on u.id = d.uri_id where not coalesce(list_contains(u.content_type_ids, d.content_type_id), false) group by uri_id",
    "uri_type_set_merge": _STAR + ", d as (select distinct uri_id, content_type_id from cap where content_type_id is not null) select * from d union select id, content_type_id from (select id, unnest(content_type_ids) content_type_id from uris) where content_type_id is not null and id in (select uri_id from d)",
    "latest": _STAR + f"select {_ROW}, http_version, content_type from cap order by archived_date desc, record_id desc, response_id desc limit 12",
    "latest_typed": _STAR + f"select {_ROW}, http_version, content_type from cap where list_contains({_types('css')}, content_type_id) order by archived_date desc, record_id desc, response_id desc limit 20",
    "near_single": _STAR + f"select response_id, uri, epoch_us(archived_date) archived_date_us, abs(epoch_us(archived_date) - epoch_us(timestamptz '{MOMENT}')) gap_us from cap where uri = (select uri from hot) order by gap_us, archived_date, response_id limit 1",
    "near_record": _STAR + f"select c.id, warc_custom_id, record_type, epoch_us(archived_date) archived_date_us, abs(epoch_us(archived_date) - epoch_us(timestamptz '{MOMENT}')) gap_us from rec c join uris u on u.id = c.uri_id where uri = (select uri from hot) order by gap_us, archived_date, c.id limit 1",
    "near_bulk": _STAR + """, asked as (select c.id request_id, uri_id, epoch_us(archived_date) + 864000000000 t from rec c join uris u on u.id = c.uri_id)
select request_id, arg_min(response_id, (abs(epoch_us(archived_date) - t), epoch_us(archived_date), response_id)) response_id from asked join cap using (uri_id) group by request_id""",
    "near_follow_redirect": _STAR + f""", first as (select * from cap where uri = (select min(uri) from cap where status between 300 and 399 and {_LOCATION} is not null) order by abs(epoch_us(archived_date) - epoch_us(timestamptz '{MOMENT}')), archived_date, response_id limit 1),
aimed as (select response_id, {_TARGET} target from (select response_id, uri, case when status between 300 and 399 then {_LOCATION} end location from first)),
second as (select response_id from cap where uri = (select target from aimed) order by abs(epoch_us(archived_date) - epoch_us(timestamptz '{MOMENT}')), archived_date, response_id limit 1)
select coalesce((select response_id from second), response_id) response_id, (select response_id from second) is not null followed from first""",
    "history": _STAR + f"select {_HIST} from cap where uri = (select uri from hot)",
    "site_responses_by_id": _STAR + f"select {_HIST}, file_path from cap where uri_id = (select uri_id from cap where warc_custom_id = (select min(warc_custom_id) from cap) limit 1)",
    "site_responses_by_uri": _STAR + f"select {_HIST}, file_path from cap where uri = (select uri from hot)",
    "record_detail": _STAR + "select c.id record_id, c.warc_custom_id, c.record_type, epoch_us(c.archived_date) archived_date_us, u.uri, s.id response_id, s.status, s.http_version, coalesce(s.status between 300 and 399, false) is_redirect from rec c left join res s on s.record_id = c.id left join uris u on u.id = c.uri_id where c.warc_custom_id = (select min(warc_custom_id) from cap)",
    "response_history": _STAR + f"select {_HIST} from cap",
    "batch_lookup": _STAR + ", ids as (select warc_custom_id, row_number() over (order by warc_custom_id desc) - 1 ordinal from cap order by warc_custom_id desc limit 5) select cast(ordinal as integer) ordinal, warc_custom_id, response_id, status, uri from ids join cap using (warc_custom_id) union all select 5, 'unknown::id', null, null, null",
    "redirect_edges": _STAR + ", " + _EDGES + " select * from edges",
    "redirect_paths": _STAR.replace("with rec", "with recursive rec", 1) + ", " + _EDGES + """, path as (
  select response_id start_id, 1 hop, response_id, uri, cast(null as varchar) resolved_location, [uri] seen from cap where status between 300 and 399
  union all select p.start_id, p.hop + 1, c.response_id, c.uri, e.target, list_append(p.seen, c.uri) from path p join edges e on e.response_id = p.response_id join cap c on c.response_id = e.next_id where p.hop < 20 and not list_contains(p.seen, c.uri))
select start_id, hop, response_id, uri, resolved_location from path""",
    "header_lookup": _STAR + f"select id, coalesce(headers['Content-Type'], headers['content-type']) content_type, {_LOCATION} \"location\", headers['server'] server from res",
    "location_targets": f"select uri, location, {_TARGET} target, regexp_matches(lower(trim(location)), '^(?:#|(?:data|blob|javascript|mailto|tel|about):)') non_fetchable from (select distinct uri, {_LOCATION} location from response_history where uri is not null)",
    "ingest_invalid": "with " + _VALID + " select * from bad where reason is not null",
    "ingest_duplicate_ids": "select batch_id, warc_custom_id, count(*) n from warc_response_bulk_input where warc_custom_id is not null group by all having count(*) > 1",
    "ingest_last_wins": f"select uri, row_id, cast({_LEVEL} as integer) \"level\" from (select uri, max(row_id) row_id from warc_response_bulk_input where uri is not null and trim(uri, ' ') <> '' group by uri)",
    "ingest_dimensions": "with " + _VALID + """, counts as (select 'warc_files' table_name, count(distinct file_path) n from good union all select 'ips', count(distinct ip) from good
  union all select 'content_types', count(distinct nullif(trim(http_content_type, ' '), '')) from good union all select 'uris', count(distinct uri) from good
  union all select 'payloads', count(*) from (select distinct file_path, payload_byte_offset, payload_byte_length from good where file_path is not null and payload_byte_offset is not null and payload_byte_length is not null)
  union all select 'records', count(distinct warc_custom_id) from good union all select 'responses', count(distinct warc_custom_id) from good) select table_name, n, n "keys" from counts""",
    "ingest_payload_last_wins": "with " + _VALID + " select payload_byte_offset byte_offset, payload_byte_length byte_length, payload_digest from good where file_path is not null and payload_byte_offset is not null and payload_byte_length is not null qualify row_number() over (partition by file_path, payload_byte_offset, payload_byte_length order by row_id desc) = 1",
    "ingest_new_uris": "select distinct uri from warc_response_bulk_input where batch_id > 1 and uri is not null and uri not in (select uri from warc_response_bulk_input where batch_id = 1 and uri is not null)",
    "uuid_and_target": "select row_id, nullif(lower(regexp_extract('<urn:uuid:' || warc_record_id || '>', '(?i)urn:uuid:([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})', 1)), '') uuid, nullif(trim(regexp_replace(trim('<' || uri || '>', ' '), '(?s)^<(.*)>$', '\\1'), ' '), '') target from warc_response_bulk_input",
    "table_sizes": " union all ".join(f"select '{t}' table_name, count(*) n from {t}" for t in ("content_types", "uris", "warc_files", "records", "responses")),
    "parse_plan": "with " + _PROGRESS + " select * from plan",
    "progress_rollup": "with " + _PROGRESS + """ select *, case when bytes_total > 0 then round(100.0 * bytes_done / bytes_total, 2) end percent from (
  select count(*) files, count(*) filter (status = 'parsing') parsing, count(*) filter (status = 'error') error, count(*) filter (status = 'pending') pending, count(*) filter (status = 'parsed') parsed,
  cast(sum(records) as bigint) records, cast(sum(byte_offset) as bigint) bytes_done, cast(sum(file_size) as bigint) bytes_total, count(*) filter (file_size is null) unknown_sizes from plan)""",
    "progress_page": "with " + _PROGRESS + f" select *, {_PCT} from plan order by {_RANK}, file_path limit 10 offset 3",
    "progress_errors": "with " + _PROGRESS + f" select *, {_PCT} from plan where status = 'error'",
    "parse_work": "with " + _PROGRESS + """, sized as (select *, (select f.id * 1000 + case f.id % 3 when 0 then 500 when 1 then 0 else -500 end from warc_files f where f.id = file_id) size from plan where file_id in (select id from warc_files where cardinality(metadata) > 0)),
reasoned as (select *, case when status = 'error' then 'retry' when status = 'pending' then 'new' when status = 'parsing' and byte_offset > 0 then 'resume' when status = 'parsing' then 'new' when file_size is null or size = file_size then 'done' when size > file_size then 'grew' else 'replaced' end reason from sized)
select file_id, file_path, case when reason in ('new', 'replaced') then 0 else byte_offset end "start", case when reason in ('new', 'replaced') then 0 else records end records, size, reason from reasoned""",
    "checkpoint_advance": "with " + _PROGRESS + " select file_id, greatest(byte_offset, file_id * 500) byte_offset, greatest(records, file_id * 7) records from progress",
    "range_requests": r"""with asked as (select view_id, payload_size n, unnest(['bytes=0-99', 'bytes=500-', 'bytes=-200', 'bytes=5-2', 'bytes=1-2,4-5', 'bytes=999999999-', 'bytes=-0', 'chunks=1-2', 'bytes=100-999999999']) h from view_record where payload_size is not null),
parts as (select *, regexp_extract(h, '^bytes=(\d*)-(\d*)$', 1) a, regexp_extract(h, '^bytes=(\d*)-(\d*)$', 2) b, regexp_matches(h, '^bytes=\d*-\d*$') formed from asked),
bounds as (select *, case when a = '' then greatest(0, n - try_cast(b as bigint)) else try_cast(a as bigint) end s, case when a = '' or b = '' then n - 1 else least(try_cast(b as bigint), n - 1) end e from parts),
judged as (select *, formed and not (a = '' and b = '') ok, s >= n or s > e or (a = '' and try_cast(b as bigint) = 0) bad from bounds)
select view_id, h range_header, case when not ok then 200 when bad then 416 else 206 end status, case when not ok then 0 when bad then null else s end first_byte, case when not ok then n - 1 when bad then null else e end last_byte from judged""",
    "chunk_ranges": """with each as (select row_id, unnest(payload_chunks) n, generate_subscripts(payload_chunks, 1) - 1 place from warc_response_bulk_input where len(payload_chunks) > 0),
widths as (select *, length(printf('%x', n)) w from each)
select row_id, cast(place as integer) place, cast(coalesce(sum(n + w + 4) over (partition by row_id order by place rows between unbounded preceding and 1 preceding), 0) + w + 2 as bigint) first_byte, n n_bytes from widths""",
    "chunk_size_literals": "select row_id, cast(row_number() over (partition by row_id order by place) - 1 as integer) place, n n_bytes from (select row_id, unnest(payload_chunks) n, generate_subscripts(payload_chunks, 1) place from warc_response_bulk_input where len(payload_chunks) > 0) where n > 0",
    "short_reads": """with b as (select * from warc_response_bulk_input where payload_byte_offset is not null and payload_byte_length is not null), ends as (select file_path, max(payload_byte_offset + payload_byte_length) - 20000 extent from b group by file_path),
j as (select row_id, payload_byte_length n, greatest(0, least(payload_byte_length, extent - payload_byte_offset)) available from b join ends using (file_path)) select row_id, available, available <> n short_read from j""",
    "ledger_summary": "with b as (select *, payload_byte_offset is not null and payload_byte_length is not null stored_ from warc_response_bulk_input) select batch_id, count(*) requested, count(*) filter (stored_) stored, count(*) filter (not stored_) missing, cast(coalesce(sum(payload_byte_length) filter (stored_), 0) as bigint) payload_bytes from b group by batch_id",
    "budget_prefix": "select batch_id, row_id from (select batch_id, row_id, row_number() over w k, sum(payload_byte_length) over w total from warc_response_bulk_input where payload_byte_length is not null window w as (partition by batch_id order by row_id rows unbounded preceding)) where k <= 30 and total <= 400000",
    "digest_merge": "select min(row_id) entry_id, count(*) - 1 aliases, payload_digest, http_content_type from warc_response_bulk_input where payload_digest is not null and uri is not null group by payload_digest, http_content_type",
    "zip_size": "with e as (select length('pages/' || view_id || '.html') name_size, octet_length(encode(payload)) size from view_record where payload is not null) select count(*) entries, cast(sum(30 + name_size + size + 16 + 46 + name_size) + 22 as bigint) archive_size from e",
    "page_links": "select view_id, href, count(*) n from (select view_id, unnest(regexp_extract_all(payload, '<a href=\"([^\"]*)\"', 1)) href from view_record where payload is not null) group by all",
}


# -- documents: rewriting, references, closure (checked by tests, not by SQL) --------------------------

API = "https://archive.test/view"


def _pages(s, d):
    v = table(s, d, "view_record")
    return v.select(F.col("view_id").alias("id"), F.col("url").alias("uri"), F.col("date_archived").alias("archived_date"), "content_type", "status", F.col("payload").alias("body"), "warc_file", "uuid")


def html_rewrite(s, d):
    pages = _pages(s, d).where(N.document_kind("content_type") == "html")
    return pages.where("body is not null").select("id", web.html_rewritten(API)("body", "uri", F.date_format("archived_date", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("document"))


def css_rewrite(s, d):
    pages = _pages(s, d).where(N.document_kind("content_type") == "css")
    return pages.where("body is not null").select("id", web.css_rewritten(API)("body", "uri", F.date_format("archived_date", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("document"))


def page_references(s, d):
    return closure.reference_edges(_pages(s, d))


def dependency_closure(s, d):
    pages = _pages(s, d)
    return closure.dependency_closure(pages, pages.where(N.document_kind("content_type") == "html"))


def download_ledger(s, d):
    """Every bulk row requested in its batch's export, and every tenth id a second time under an unknown id."""
    b = _bulk(s, d)
    ends = b.where("payload_byte_offset is not null").groupBy("file_path").agg((F.max(F.col("payload_byte_offset") + F.col("payload_byte_length")) - 20000).alias("file_size"))
    held = b.join(ends, "file_path", "left").select(F.col("row_id").alias("id"), F.col("payload_byte_offset").alias("byte_offset"), F.col("payload_byte_length").alias("byte_length"), "file_size")
    asked = b.select(F.col("batch_id").alias("export_id"), F.col("row_id").alias("ordinal"), F.col("row_id").alias("id"))
    unknown = asked.where("id % 10 = 0").select("export_id", "ordinal", (-F.col("id")).alias("id"))
    return view.ledger(asked.where("id % 10 <> 0").unionByName(unknown), held, 25, 300_000)


def view_documents(s, d):
    pages = _pages(s, d).withColumn("body", F.col("body").cast("binary"))
    return view.viewed(pages, API).select("id", "content_type", F.octet_length("body").alias("n_bytes"))


def view_ranges(s, d):
    pages = _pages(s, d).where("body is not null").withColumn("body", F.col("body").cast("binary"))
    return view.ranged(pages, "bytes=100-299").select("id", "status", F.octet_length("part").alias("n_bytes"))


for _name in ("download_ledger", "view_documents", "view_ranges", "html_rewrite", "css_rewrite", "page_references", "dependency_closure"):
    QUERIES[_name] = globals()[_name]
SQL["download_ledger"] = """with b as (select * from warc_response_bulk_input), ends as (select file_path, max(payload_byte_offset + payload_byte_length) - 20000 file_size from b where payload_byte_offset is not null group by file_path),
asked as (select batch_id export_id, row_id ordinal, case when row_id % 10 = 0 then -row_id else row_id end id, row_id from b),
judged as (select a.*, payload_byte_length n, case when a.id < 0 then 'not-found' when payload_byte_offset is null or payload_byte_length is null then 'no-payload'
  when greatest(0, least(payload_byte_length, coalesce(file_size, 0) - payload_byte_offset)) <> payload_byte_length then 'short-read' else 'stored' end status from asked a join b on b.row_id = a.row_id left join ends e on e.file_path = b.file_path),
counted as (select *, sum(case when status = 'stored' then 1 else 0 end) over w k, sum(case when status = 'stored' then n else 0 end) over w total from judged window w as (partition by export_id order by ordinal rows unbounded preceding))
select export_id, ordinal, id, case when status = 'stored' and (k > 25 or total > 300000) then 'over-budget' else status end status from counted"""
SQL["view_ranges"] = "select view_id id, case when octet_length(encode(payload)) > 100 then 206 else 416 end status, case when octet_length(encode(payload)) > 100 then least(200, octet_length(encode(payload)) - 100) end n_bytes from view_record where payload is not null"

# the pages of the tables load style sheets at absolute paths and nothing else; whoever changes that sees it here
_PAGE = r"""page as (select view_id id, url uri, date_archived t, payload, status, lower(trim(split_part(coalesce(content_type, ''), ';', 1), ' ')) e from view_record),
loads as (select distinct id, regexp_replace(lower(regexp_extract(regexp_replace(uri, '[\t\r\n]', '', 'g'), '(?i)^\s*(https?://[^/?#]*)', 1)), '^(http://.*):80$|^(https://.*):443$', '\1\2') || unnest(regexp_extract_all(payload, '(?i)<link rel="stylesheet" href="(/[^"]*)"', 1)) url
  from page where e in ('text/html', 'application/xhtml+xml') and payload is not null and coalesce(status, 200) < 400 and regexp_matches(regexp_replace(uri, '[\t\r\n]', '', 'g'), '(?i)^\s*https?://[^/?#]'))"""
SQL["page_references"] = f"with {_PAGE} select id, 'link' how, url from loads"
SQL["dependency_closure"] = f"""with {_PAGE}, roots as (select * from page where e in ('text/html', 'application/xhtml+xml')),
wanted as (select distinct r.id root_id, r.t, l.url from loads l join roots r using (id) where l.url is distinct from r.uri),
found as (select w.root_id, w.url, arg_min(p.id, (abs(epoch_us(p.t) - epoch_us(w.t)), epoch_us(p.t), p.id)) id from wanted w join page p on p.uri = w.url group by all)
select id root_id, uri url, 0 depth, id, null reason from roots
union all select w.root_id, w.url, 1, f.id, case when f.id is null then 'not-archived' when p.status >= 400 then 'error-status' when p.status >= 300 then 'redirect' when p.payload is null then 'no-payload' end
from wanted w left join found f on f.root_id = w.root_id and f.url = w.url left join page p on p.id = f.id"""
