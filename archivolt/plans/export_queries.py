"""The queries of exported archives: checksums, paths, bundles; with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.functions import native as N
from archivolt.functions import paths
from archivolt.operators import closure, export, view
from archivolt.plans.runtime import checkpoint_dir, cut, table


def _pages(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "view_record")
    return v.select(F.col("view_id").alias("id"), "url", "content_type", "status", F.col("warc_file").alias("archive"), "uuid", F.col("payload").alias("body"), "payload_digest", "date_archived")


def payload_crc(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).where("body is not null").select(F.col("id").alias("view_id"), F.crc32(F.col("body").cast("binary")).alias("crc"))


def entry_paths(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).where("url is not null").select("id", paths.entry_path("url", "uuid").alias("path"))


def path_hashes(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "uris")
    return u.select("id", paths.short_hash("uri").alias("hash"), paths.safe_segment("uri").alias("segment"))


def path_assignment(spark: SparkSession, d: str) -> DataFrame:
    return closure.assigned_paths(_pages(spark, d).where("url is not null"))


def path_collisions(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "uris")
    return export.colliding_paths(u.select("id", F.regexp_replace("uri", r"[?#][\s\S]*$", "").alias("path")))


def merged_entries(spark: SparkSession, d: str) -> DataFrame:
    """Pages of one digest and content type as one entry."""
    held = _pages(spark, d).where("url is not null").withColumnRenamed("payload_digest", "digest")
    return closure.merged_entries(held).select("entry_id", "digest", "content_type", F.size("urls").alias("n_urls"), F.array_join("urls", " ").alias("urls"))


def json_headers(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "view_record").where(N.document_kind("content_type") == "other")
    return v.select("view_id", F.size(N.json_object("payload")).alias("members"))


def offline_bundle(spark: SparkSession, d: str) -> DataFrame:
    return view.bundle(_pages(spark, d).where("url is not null")).select("path", F.octet_length("body").alias("n_bytes"))


def written_bundles(spark: SparkSession, d: str) -> DataFrame:
    """One archive for each content type, written by the executors: its entries, and what a reader finds in it."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/bundles-{uuid.uuid4().hex}"
    entries = _pages(spark, d).where("url is not null").withColumn("export_id", F.coalesce("content_type", F.lit("none")))
    written = cut(view.write_bundles(view.bundle(entries), folder))
    return written.select("export_id", F.col("entries").alias("n"), "duplicates", (F.col("bytes") > 0).alias("sound"))


def merged_bundle(spark: SparkSession, d: str) -> DataFrame:
    """Entries of a bundle that stores equal digests once, per content type."""
    entries = _pages(spark, d).where("url is not null").withColumnRenamed("payload_digest", "digest")
    return view.bundle(entries.withColumn("export_id", F.coalesce("content_type", F.lit("none")))).groupBy("export_id").agg(F.count("*").alias("entries"), F.count("body").alias("bodies"))


_NAMES = "payload_crc entry_paths path_hashes path_assignment path_collisions merged_entries json_headers offline_bundle written_bundles merged_bundle"
QUERIES = {name: globals()[name] for name in _NAMES.split()}

_CRC_TABLE = "(select list(v order by n) from (select n, list_reduce(list_prepend(n, range(8)), lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end) v from range(256) t(n)))"
_FNV = "printf('%08x', list_reduce(list_prepend(2166136261, list_transform(list_filter(string_split({0}, ''), lambda c: c <> ''), lambda c: cast(unicode(c) as bigint))), lambda h, u: xor(h, u) * 16777619 % 4294967296))"
_EXT = r"regexp_extract({0}, '(?s)^.+(\.[^.]*)$', 1)"


def _stem(name: str) -> str:
    return f"left({name}, length({name}) - length({_EXT.format(name)}))"


def _segment(raw: str) -> str:
    plain = rf"regexp_replace(regexp_replace({raw}, '[<>:\"|?*\\/\x00-\x1f\x7f]', '_', 'g'), '[. ]+$', '')"
    named = rf"list_transform([{plain}], lambda q: case when q = '' then '_' when regexp_matches(q, '(?i)^(?:con|prn|aux|nul|com[1-9]|lpt[1-9])(?:\.[^.]*)?$') then '_' || q else q end)[1]"
    return f"list_transform([{named}], lambda m: case when length(m) <= 96 then m else left({_stem('m')}, greatest(8, 96 - 9 - length({_EXT.format('m')}))) || '~' || {_FNV.format(raw)} || {_EXT.format('m')} end)[1]"


_URL = r"(?is)^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)(?::\d*)?([^?#]*)(?:\?([^#]*))?"
_CLEAN = r"left(regexp_replace(regexp_replace({0}, '[^A-Za-z0-9._~@\-]+', '-', 'g'), '^\.+', ''), 80)"
_TYPES = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in paths.EXTENSIONS.items()) + "}"
_SPELT = " or ".join(f"x = '{k}' and regexp_matches(lower(l), '(?:{'|'.join(s[1:] for s in v)})$') and regexp_matches(lower(l), '\\.[a-z]+$')" for k, v in paths.SPELLINGS.items())
_ZIP = f"""parsed as (select *, regexp_extract(url, '{_URL}', 1) host, regexp_extract(url, '{_URL}', 2) raw_path, regexp_extract(url, '{_URL}', 3) query,
  coalesce(({_TYPES})[lower(trim(split_part(coalesce(content_type, ''), ';', 1), ' '))], '') x from pages),
walked as (select *, try(url_decode(replace(raw_path, '+', '%2B'))) decoded from parsed),
stepped as (select *, coalesce(decoded, raw_path) p, list_reduce(list_prepend(cast([] as varchar[]), list_transform(string_split(coalesce(decoded, raw_path), '/'), lambda s: [s])),
  lambda acc, s: case when s[1] = '..' then acc[1:greatest(len(acc) - 1, 0)] when s[1] in ('', '.') then acc else acc || s end) steps from walked),
named as (select *, list_transform(steps, lambda s: {_segment('s')}) segs, len(steps) = 0 or ends_with(p, '/') folder from stepped),
filed as (select *, segs[len(segs)] l from named),
suffixed as (select *, case when folder then 'index' || case when x = '' then '.html' else x end when ends_with(lower(l), x) or {_SPELT} then l else l || x end f from filed),
asked as (select *, case when query = '' then f else {_stem('f')} || '__q' || {_FNV.format('query')} || {_EXT.format('f')} end file from suffixed),
rooted as (select *, {_segment('lower(host)')} root, case when folder then segs else segs[1:len(segs) - 1] end above from asked),
whole as (select *, array_to_string([root] || above || [file], '/') w from rooted),
pathed as (select *, case when host = '' then '_unparsed/' || {_segment('url')} when length(w) <= 180 then w else root || '/_deep/' || {_FNV.format('w')} || '/' || file end path from whole)"""
_RECORD = rf"""peers as (select *, count(*) over (partition by lower(path)) n, count(*) filter (status between 200 and 299) over (partition by lower(path)) sound from pathed),
split as (select *, split_part(path, '/', -1) base, {_segment(r"regexp_replace(coalesce(archive, ''), '(?i)\.w?arc(?:\.gz)?$', '')")} source, regexp_replace(coalesce(uuid, ''), '(?i)^<?urn:uuid:|>$', '', 'g') bare from peers),
tailed as (select *, left(path, length(path) - length(base)) dir, '.' || source || '.' || case when bare = '' then 'unknown' else {_segment('bare')} end || {_EXT.format('base')} tail from split),
cut_down as (select *, dir || {_stem('base')} || tail long, left({_stem('base')}, greatest(8, 96 - length(tail))) || tail short from tailed)"""
_PAGES = "with pages as (select view_id id, url, content_type, status, warc_file archive, uuid from view_record where url is not null)"

SQL = {
    "payload_crc": f"""with t as (select {_CRC_TABLE} tab), b as (select view_id, hex(encode(payload)) h from view_record where payload is not null)
select view_id, cast(xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, length(h) // 2), lambda i: cast('0x' || substr(h, 2 * i + 1, 2) as bigint))),
  lambda c, v: xor(c >> 8, tab[(xor(c, v) & 255) + 1]))) as bigint) crc from b, t""",
    "entry_paths": rf"""with u as (select view_id id, coalesce(uuid, '') uuid, regexp_extract(url, '(?is)^[a-z][a-z0-9+.\-]*://([^/?#]+)', 1) host, regexp_extract(url, '{_URL}', 2) p, regexp_extract(url, '{_URL}', 3) q from view_record where url is not null),
s as (select *, list_filter(list_transform(string_split(case when host = '' then '' else p end, '/'), lambda x: {_CLEAN.format('x')}), lambda x: x <> '') segs from u),
f as (select *, coalesce(segs[len(segs)], 'index') file, coalesce(nullif({_CLEAN.format('lower(host)')}, ''), 'unknown-host') root from s)
select id, array_to_string([root] || segs[1:len(segs) - 1] || [{_stem('file')} || case when host = '' or q = '' then '' else '-' || {_CLEAN.format("'?' || q")} end || '.' || {_CLEAN.format('uuid')} || coalesce(nullif({_EXT.format('file')}, ''), '.html')], '/') path from f""",
    "path_hashes": f"select id, {_FNV.format('uri')} hash, {_segment('uri')} segment from uris",
    "path_assignment": f"{_PAGES}, {_ZIP}, {_RECORD} select id, case when n = 1 or status between 200 and 299 and sound = 1 then path when length(long) <= 180 then long when length(dir || short) <= 180 then dir || short else coalesce(nullif(split_part(dir, '/', 1), ''), '_nohost') || '/_deep/' || {_FNV.format('path')} || '/' || short end path from cut_down",
    "path_collisions": "select id, path, count(*) over (partition by lower(path)) > 1 collides from (select id, regexp_replace(uri, '(?s)[?#].*$', '') path from uris)",
    "merged_entries": "select min(view_id) entry_id, any_value(payload_digest) digest, content_type, cast(count(distinct url) as integer) n_urls, array_to_string(list_sort(list(distinct url)), ' ') urls from view_record where url is not null group by coalesce(payload_digest, 'id:' || view_id), content_type",
    "written_bundles": "select coalesce(content_type, 'none') export_id, count(payload) n, 0 duplicates, true sound from view_record where url is not null group by 1",
    "merged_bundle": "select coalesce(content_type, 'none') export_id, count(*) entries, count(payload) bodies from (select * from view_record where url is not null qualify row_number() over (partition by coalesce(payload_digest, 'id:' || view_id), content_type order by view_id) = 1) group by 1",
    "json_headers": """select view_id, cast(case when payload is null then 0 when not json_valid(payload) or json_type(payload) <> 'OBJECT' then 1 else len(json_keys(payload)) end as integer) members from view_record
where lower(trim(split_part(coalesce(content_type, ''), ';', 1), ' ')) not in ('text/html', 'application/xhtml+xml', 'text/css', 'text/javascript', 'application/javascript', 'application/x-javascript', 'application/ecmascript')""",
}
