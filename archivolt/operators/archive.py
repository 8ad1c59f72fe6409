"""The archive's star schema as DataFrames, and the lookups over it. Everything is lazy; nothing is collected."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archivolt.functions import native as N
from archivolt.plans.runtime import bounded, cut, small, table

SEARCH_COLUMNS = ["response_id", "status", "last_modified", "archived_date", "warc_custom_id", "uri"]
#: Counts stop here when a query is given.
COUNT_CAP = 10_001


def last_written(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per key, the last by ``order``; an aggregation with map-side combining, not a window."""
    row = F.max_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(key).agg(row.alias("row")).select("row.*")


#: The fact tables, and what orders the versions of one id.
VERSIONS = {"records": ("created_at", "warc_custom_id"), "responses": ("created_at", "record_id")}
RECORD_COLUMNS = ("warc_file_id", "warc_custom_id", "record_type", "archived_date", "uri_id", "ip_id", "payload_id", "payload_digest")
RESPONSE_COLUMNS = ("record_id", "status", "http_version", "content_type_id", "headers", "last_modified")


@dataclass
class Archive:
    """``records`` and ``responses`` hold one row per id, the one written last.

    Tables as they were delivered repeat rows (``delivered``), so :meth:`rows` aggregates them by id, always over the
    columns asked for only, and a lookup of one URI or record over the ids that some version of it has (:meth:`of`).
    Tables written by :func:`compact` need neither (``unique=True``): the filter goes straight to their row groups.
    """

    content_types: DataFrame
    uris: DataFrame
    warc_files: DataFrame
    records: DataFrame
    responses: DataFrame
    spark: SparkSession
    delivered: dict[str, DataFrame] | None = None
    among: tuple[str, list] | None = None

    @classmethod
    def read(cls, spark: SparkSession, folder: str, unique: bool = False) -> Archive:
        facts = {name: table(spark, folder, name) for name in VERSIONS}
        whole = facts if unique else {name: last_written(df, "id", *VERSIONS[name]) for name, df in facts.items()}
        return cls(table(spark, folder, "content_types"), table(spark, folder, "uris"), table(spark, folder, "warc_files"), whole["records"], whole["responses"], spark, None if unique else facts)

    def rows(self, name: str, *columns: str) -> DataFrame:
        """``id`` and ``columns`` of a fact table, one row per id."""
        wanted = dict.fromkeys(("id", *columns))
        if self.delivered is None:
            return getattr(self, name).select(*wanted)
        among = self.among if name == "records" else None
        last = last_written(self.delivered[name].select(*(wanted | dict.fromkeys((*VERSIONS[name], *([among[0]] if among else []))))), "id", *VERSIONS[name])
        return (last.where(F.col(among[0]).isin(among[1])) if among else last).select(*wanted)

    def uri_ids(self, uri: str) -> list[int]:
        """The id of an exact URI, looked up first so that it reaches the scan of the records as a literal; a URI is
        unique, so there is one at most."""
        return [r["id"] for r in self.uris.where(F.col("uri") == uri.split("#", 1)[0]).select("id").collect()]

    def of(self, values: list, column: str = "uri_id") -> Archive:
        """The archive with the records that have one of these few ``values`` only, and their responses.

        Of delivered tables these are first the ids of which *any* version has the value, by a filter in the scan; only
        those are aggregated, and the last version is asked again.
        """
        mine = F.col(column).isin(values)
        if self.delivered is None:
            return replace(self, records=self.records.where(mine))
        records, responses = self.delivered["records"], self.delivered["responses"]
        ids = bounded(records.where(mine).select("id").distinct())
        answers = bounded(responses.join(ids.select(F.col("id").alias("record_id")), "record_id", "left_semi").select("id").distinct())
        few = {"records": records.join(ids, "id", "left_semi"), "responses": responses.join(answers, "id", "left_semi")}
        return replace(self, records=self.records.where(mine), delivered=few, among=(column, values))

    # -- views ------------------------------------------------------------------

    def captures(self, columns: list[str] | None = None) -> DataFrame:
        """Responses with their records and URIs: the join every lookup starts from."""
        asked = set(columns or (*RECORD_COLUMNS, *RESPONSE_COLUMNS))
        r = self.rows("responses", "record_id", *(c for c in RESPONSE_COLUMNS if c in asked)).withColumnRenamed("id", "response_id")
        c = self.rows("records", "uri_id", *(c for c in RECORD_COLUMNS if c in asked)).withColumnRenamed("id", "record_id")
        joined = r.join(c, "record_id").join(self.uris.select(F.col("id").alias("uri_id"), "uri", "recursion_level"), "uri_id")
        return joined.select(*columns) if columns else joined

    def response_history(self) -> DataFrame:
        types = small(self.content_types.select(F.col("id").alias("content_type_id"), F.col("type").alias("content_type")))
        return self.captures().join(types, "content_type_id", "left")

    def response_payloads(self) -> DataFrame:
        files = small(self.warc_files.select(F.col("id").alias("warc_file_id"), "file_path"))
        return self.response_history().join(files, "warc_file_id", "left")

    # -- search -----------------------------------------------------------------

    def type_ids(self, content_type: str) -> DataFrame:
        """Ids whose base type is the given one's, or whose type contains the given text (case-insensitive)."""
        base = N.content_type_base(F.lit(content_type))
        has = F.lower("type").contains(content_type.lower())
        return self.content_types.where((F.col("base_type") == base) | has).select(F.col("id").alias("content_type_id"))

    def _matching_uris(self, query: str | None, content_type: str | None) -> DataFrame:
        out = self.uris
        if query and query.strip():
            out = out.where(F.lower("uri").contains(query.lower()))
        if content_type and content_type.strip():
            # the overlap of two sets as a semi join, so that neither the type ids nor a URI's set has to be bounded
            pairs = out.select("id", F.explode(F.array_distinct("content_type_ids")).alias("content_type_id"))
            hit = pairs.join(small(self.type_ids(content_type)), "content_type_id", "left_semi").select("id")
            out = out.join(small(hit), "id", "left_semi")
        return out

    def _captures_of(self, page: DataFrame, content_type: str | None = None) -> DataFrame:
        """All captures of a page's URIs. The page is at most its limit, so it is broadcast to the fact tables."""
        records = self.rows("records", "archived_date", "warc_custom_id", "uri_id").join(F.broadcast(page.select(F.col("id").alias("uri_id"), "uri", "recursion_level")), "uri_id")
        responses = self.rows("responses", "record_id", "status", "last_modified", *(["content_type_id"] if content_type else []))
        if content_type and content_type.strip():
            responses = responses.join(small(self.type_ids(content_type)), "content_type_id", "left_semi")
        found = records.select(F.col("id").alias("record_id"), "archived_date", "warc_custom_id", "uri", "recursion_level")
        return responses.select(F.col("id").alias("response_id"), "record_id", "status", "last_modified").join(found, "record_id")

    def search(self, query: str | None = None, offset: int = 0, limit: int = 100, content_type: str | None = None) -> DataFrame:
        """All captures of a page of URIs; the page is cut by (recursion_level, uri) before any join."""
        page = self._matching_uris(query, content_type).orderBy("recursion_level", "uri").offset(offset).limit(limit)
        found = self._captures_of(page, content_type)
        return found.orderBy("recursion_level", "uri", F.desc("archived_date"), "response_id").select(*SEARCH_COLUMNS)

    def search_after(self, query: str, after_level: int | None = None, after_uri: str | None = None, limit: int = 16) -> DataFrame:
        """The keyset page behind (level, uri); without a cursor, the first page."""
        level, uri = (-1, "") if after_level is None or after_uri is None else (after_level, after_uri)
        behind = (F.col("recursion_level") > level) | ((F.col("recursion_level") == level) & (F.col("uri") > uri))
        page = self._matching_uris(query, None).where(behind).orderBy("recursion_level", "uri").limit(limit)
        return self._captures_of(page).select(*SEARCH_COLUMNS, "recursion_level").orderBy("recursion_level", "uri", F.desc("archived_date"), "response_id")

    def next_cursor(self, query: str, after_level: int | None = None, after_uri: str | None = None, limit: int = 16) -> DataFrame:
        """``recursion_level`` and ``uri`` of the last URI of a keyset page, the cursor behind it; none if the page is
        not full, for then there is no other."""
        level, uri = (-1, "") if after_level is None or after_uri is None else (after_level, after_uri)
        behind = (F.col("recursion_level") > level) | ((F.col("recursion_level") == level) & (F.col("uri") > uri))
        return self._matching_uris(query, None).where(behind).orderBy("recursion_level", "uri").offset(limit - 1).limit(1).select("recursion_level", "uri")

    def search_count(self, query: str | None = None, content_type: str | None = None, cap: int = COUNT_CAP) -> DataFrame:
        """The number of matching URIs: with a query, counting stops at ``cap``; else it is exact."""
        matching = self._matching_uris(query, content_type).select("id")
        return (matching.limit(cap) if query and query.strip() else matching).agg(F.count("*").alias("n"))

    def search_groups(self, rows: DataFrame) -> DataFrame:
        """Search rows grouped by URI: their number and the ids, newest first."""
        newest = F.reverse(F.array_sort(F.collect_list(F.struct("archived_date", "response_id"))))
        return rows.groupBy("uri").agg(F.count("*").alias("captures"), F.transform(newest, lambda x: x["response_id"]).alias("response_ids"))

    def uri_sort_position(self, uri: str) -> DataFrame:
        return self.uris.where(F.col("uri") == uri).select("recursion_level")

    def base_types(self) -> DataFrame:
        """Distinct base types, A to Z."""
        named = self.content_types.where(F.col("type").isNotNull() & (F.trim("type") != ""))
        return named.select(N.content_type_base("type").alias("content_type")).where("content_type is not null").distinct().orderBy("content_type")

    # -- lookups in time -----------------------------------------------------------

    def latest(self, content_type: str | None = None, limit: int = 12) -> DataFrame:
        """The newest responses: first narrow rows to the limit, then the wide columns."""
        narrow = self.rows("responses", "record_id", "content_type_id").withColumnRenamed("id", "response_id")
        if content_type and content_type.strip():
            narrow = narrow.join(small(self.type_ids(content_type)), "content_type_id", "left_semi")
        dated = narrow.join(self.rows("records", "archived_date", "warc_custom_id", "uri_id").withColumnRenamed("id", "record_id"), "record_id")
        top = dated.orderBy(F.desc("archived_date"), F.desc("record_id"), F.desc("response_id")).limit(limit)
        top = cut(top)  # a page; the wide columns are read and aggregated for its ids only
        found = F.broadcast(top.select(F.col("response_id").alias("id")))
        page = self if self.delivered is None else replace(self, delivered=self.delivered | {"responses": self.delivered["responses"].join(found, "id", "left_semi")})
        wide = page.rows("responses", "status", "headers", "http_version", "last_modified").withColumnRenamed("id", "response_id")
        names = self.content_types.select(F.col("id").alias("content_type_id"), F.col("type").alias("content_type"))
        return (
            wide.join(F.broadcast(top), "response_id").join(small(self.uris.select(F.col("id").alias("uri_id"), "uri")), "uri_id", "left").join(small(names), "content_type_id", "left")
            .select("response_id", "status", "headers", "http_version", "last_modified", "archived_date", "warc_custom_id", "uri", "content_type")
        )

    def near(self, uri: str, moment: str) -> DataFrame:
        """The capture of a URI nearest in time, either way; ties go to the older, then the smaller id."""
        exact = self.of(self.uri_ids(uri)).captures()
        gap = F.abs(F.unix_micros("archived_date") - F.unix_micros(F.to_timestamp(F.lit(moment))))
        return exact.withColumn("gap_us", gap).orderBy("gap_us", "archived_date", "response_id").limit(1)

    def near_record(self, uri: str, moment: str) -> DataFrame:
        """The record of any type nearest in time."""
        ids = self.uri_ids(uri)
        wanted = self.uris.where(F.col("id").isin(ids)).select(F.col("id").alias("uri_id"), "uri")
        gap = F.abs(F.unix_micros("archived_date") - F.unix_micros(F.to_timestamp(F.lit(moment))))
        found = self.of(ids).rows("records", *RECORD_COLUMNS).join(F.broadcast(wanted), "uri_id").withColumn("gap_us", gap)
        return found.orderBy("gap_us", "archived_date", "id").limit(1)

    def near_following(self, uri: str, moment: str) -> DataFrame:
        """:meth:`near`; a redirect is followed one hop, to the capture of its target nearest to the same moment."""
        first = self.near(uri, moment).withColumn("target", F.when(N.is_redirect("status"), N.resolve_location(N.header("headers", "location"), "uri")))
        second = nearest(first.select(F.col("target").alias("uri"), F.to_timestamp(F.lit(moment)).alias("moment"), "response_id"), self.captures().select("uri", "archived_date", F.col("response_id").alias("found_id")), ["response_id"])
        return first.join(second.select("response_id", "found_id"), "response_id", "left").select(F.coalesce("found_id", "response_id").alias("response_id"), F.col("found_id").isNotNull().alias("followed"))

    def history(self, uri: str | None) -> DataFrame:
        """Every capture of a URI, newest first; a blank URI has none."""
        wanted = (uri or "").strip().split("#", 1)[0]
        rows = self.of(self.uri_ids(wanted) if wanted else []).response_history()
        return rows.orderBy(F.desc("archived_date"), F.desc("response_id"))

    def site_responses(self, uri: str | None = None, warc_custom_id: str | None = None) -> DataFrame:
        """All captures of a URI, or of the URI of a capture; the capture's id wins."""
        if not warc_custom_id and not uri:
            raise ValueError("site_responses needs a uri or a warc_custom_id")
        if warc_custom_id:
            one = self.of([warc_custom_id], "warc_custom_id").rows("records", "uri_id").where("uri_id is not null").select("uri_id")
            return self.of([r["uri_id"] for r in one.limit(1).collect()]).response_payloads()  # an id is unique
        return self.of(self.uri_ids(uri)).response_payloads()

    def detail(self, warc_custom_id: str, requests: DataFrame | None = None) -> DataFrame:
        """A record with its response, and its request by ``concurrent_to`` or else by record."""
        mine = self.of([warc_custom_id], "warc_custom_id")
        record = mine.rows("records", "warc_custom_id", "record_type", "archived_date", "uri_id").where(F.col("warc_custom_id") == warc_custom_id).withColumnRenamed("id", "record_id")
        response = mine.rows("responses", "record_id", "status", "http_version", "concurrent_to", "headers").withColumnRenamed("id", "response_id")
        out = record.join(response, "record_id", "left").join(self.uris.select(F.col("id").alias("uri_id"), "uri"), "uri_id", "left")
        out = out.withColumn("is_redirect", F.coalesce(N.is_redirect("status"), F.lit(False)))
        if requests is None:
            return out.drop("concurrent_to")
        a = requests.select(F.col("id").alias("concurrent_to"), F.col("method").alias("m1"))
        b = requests.select("record_id", F.col("method").alias("m2"))
        return out.join(a, "concurrent_to", "left").join(b, "record_id", "left").withColumn("method", F.coalesce("m1", "m2")).drop("m1", "m2", "concurrent_to")

    def get(self, table_name: str, **natural) -> DataFrame:
        """The rows of a table with a natural key, such as ``get("uris", uri="https://a.test/")``."""
        rows = getattr(self, table_name)
        for column, value in natural.items():
            rows = rows.where(F.col(column).eqNullSafe(F.lit(value)))
        return rows

    def detail_chain(self, warc_custom_id: str, max_hops: int = 20) -> DataFrame:
        """The redirect chain of a record whose response is a 3xx; none for any other."""
        from archivolt.operators.redirects import redirect_paths

        all_captures = self.captures(["response_id", "uri", "archived_date", "last_modified", "headers", "status", "warc_custom_id"])
        start = all_captures.where((F.col("warc_custom_id") == warc_custom_id) & N.is_redirect("status"))
        return redirect_paths(all_captures, start, max_hops)

    def batch(self, warc_custom_ids: list[str]) -> DataFrame:
        """Captures of a list of ids with each id's place in the list; unknown ids have nulls, an empty list none."""
        wanted = self.spark.createDataFrame(list(enumerate(warc_custom_ids)), "ordinal int, warc_custom_id string")
        found = self.of(warc_custom_ids, "warc_custom_id").captures(["warc_custom_id", "response_id", "status", "uri"])
        return found.join(F.broadcast(wanted), "warc_custom_id", "right")

    # -- type sets ------------------------------------------------------------------

    def derived_type_sets(self) -> DataFrame:
        """Each URI's sorted set of content-type ids, from its captures."""
        return self.captures(["uri_id", "content_type_id"]).where("content_type_id is not null").groupBy("uri_id").agg(F.array_sort(F.collect_set("content_type_id")).alias("derived_ids"))

    def type_set_mismatches(self) -> DataFrame:
        """URIs whose stored set lacks a type that their captures have."""
        stored = self.uris.select(F.col("id").alias("uri_id"), F.coalesce("content_type_ids", F.array().cast("array<bigint>")).alias("stored_ids"))
        missing = F.array_except("derived_ids", "stored_ids")
        return stored.join(self.derived_type_sets(), "uri_id").where(F.size(missing) > 0).select("uri_id", F.size(missing).alias("missing_types"))


def compact(spark: SparkSession, source: str, target: str) -> None:
    """Delivered tables written once more with one row per id and in the order of the lookups: URIs by (recursion
    level, URI), records by (URI, time), responses by record. Range partitioning keeps a hot URI in several files, and
    each file's statistics let a scan skip it."""
    raw = Archive.read(spark, source)
    for name in ("content_types", "warc_files"):
        table(spark, source, name).write.mode("overwrite").parquet(f"{target}/{name}.parquet")
    for name, df, order in (("uris", raw.uris, ["recursion_level", "uri"]), ("records", raw.records, ["uri_id", "archived_date", "id"]), ("responses", raw.responses, ["record_id", "id"])):
        df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{target}/{name}.parquet")


def merged_type_sets(stored: Column, derived: Column) -> Column:
    """The sorted union of two sets; the stored one stays where it already holds the other."""
    union = F.array_sort(F.array_distinct(F.concat(stored, derived)))
    return F.when(F.size(F.array_except(derived, stored)) > 0, union).otherwise(stored)


def nearest(requests: DataFrame, captures: DataFrame, keys: list[str], tie: str | None = None, bucket: str = "day") -> DataFrame:
    """For each request (``uri``, ``moment``, the ``keys``) the capture of its URI nearest in time: ``captures`` has
    ``uri``, ``archived_date`` and further columns, of which ``tie`` (by default the first) is a number that orders
    captures of one time. Requests without a capture, with a null URI or a null moment are left out. Of two captures
    equally near the older one is taken, of two of one time the smaller ``tie``.

    Requests and captures are merged by time within (URI, ``bucket`` of time); each request looks at its last neighbour
    before and its first behind. Neighbours beyond the bucket come from one row per URI and bucket, of which twenty
    years have some 7,300. So a URI with a third of all rows is neither a product nor one task, but as many as it has
    days; where it has most of them within one, an ``hour`` divides that further.
    """
    extra = [c for c in captures.columns if c not in ("uri", "archived_date")]
    tie = tie or extra[0]
    held = captures.where("uri is not null and archived_date is not null").select("uri", F.col("archived_date").alias("t"), F.struct("archived_date", *extra).alias("capture"))
    asked = requests.where("uri is not null and moment is not null").select("uri", F.col("moment").alias("t"), F.struct(*keys).alias("request"))
    shape = {c: df.schema[c].dataType for df, c in ((held, "capture"), (asked, "request"))}
    merged = held.withColumn("request", F.lit(None).cast(shape["request"])).unionByName(asked.withColumn("capture", F.lit(None).cast(shape["capture"])))
    merged = merged.withColumn("slot", F.date_trunc(bucket, "t"))
    number = F.col(f"capture.{tie}")
    ahead = Window.partitionBy("uri", "slot").orderBy(F.col("t"), number.desc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy("uri", "slot").orderBy(F.col("t"), number.asc_nulls_first()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    near = merged.withColumn("before", F.last("capture", ignorenulls=True).over(ahead)).withColumn("behind", F.first("capture", ignorenulls=True).over(after)).where("request is not null")
    slots = held.withColumn("slot", F.date_trunc(bucket, "t")).groupBy("uri", "slot").agg(
        F.max_by("capture", F.struct(F.col("t"), -number)).alias("latest"), F.min_by("capture", F.struct(F.col("t"), number)).alias("earliest")
    )
    # a time in which a URI is asked for but not captured still needs its neighbours
    spans = slots.unionByName(near.select("uri", "slot").distinct(), allowMissingColumns=True).groupBy("uri", "slot").agg(F.first("latest", True).alias("latest"), F.first("earliest", True).alias("earliest"))
    by_slot = Window.partitionBy("uri").orderBy("slot")
    spans = spans.select(
        "uri", "slot",
        F.last("latest", ignorenulls=True).over(by_slot.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"),
        F.first("earliest", ignorenulls=True).over(by_slot.rowsBetween(1, Window.unboundedFollowing)).alias("later"),
    )
    both = near.join(spans, ["uri", "slot"]).withColumn("before", F.coalesce("before", "earlier")).withColumn("behind", F.coalesce("behind", "later"))
    gap = lambda c: F.abs(F.unix_micros(F.col(c)["archived_date"]) - F.unix_micros("t"))
    pick = F.when(F.col("behind").isNull() | (gap("before") <= gap("behind")), F.col("before")).otherwise(F.col("behind"))
    return both.withColumn("pick", pick).where("pick is not null").select("request.*", "uri", F.col("t").alias("moment"), "pick.*")


def record_payloads(star: dict[str, DataFrame]) -> DataFrame:
    """The flat view of records over the tables that :func:`ingest.star` makes: each record with its URI, file,
    address and payload place; what a record has not is null."""
    named = lambda name, own, *columns: small(star[name].select(F.col("id").alias(own), *columns))
    places = star["payloads"].select(F.col("id").alias("payload_id"), "byte_offset", "byte_length", "chunks")
    rows = star["records"].join(star["uris"].select(F.col("id").alias("uri_id"), "uri", "recursion_level"), "uri_id", "left").join(places, "payload_id", "left")
    return rows.join(named("warc_files", "warc_file_id", "file_path"), "warc_file_id", "left").join(named("ips", "ip_id", "ip"), "ip_id", "left")


def payloads_of(star: dict[str, DataFrame], warc_custom_ids: list[str]) -> DataFrame:
    """:func:`record_payloads` of a list of ids with each id's place in the list as ``ordinal``; unknown ids have
    nulls, an empty list nothing."""
    records = star["records"]
    wanted = records.sparkSession.createDataFrame(list(enumerate(warc_custom_ids)), "ordinal int, warc_custom_id string")
    few = records.where(F.col("warc_custom_id").isin(warc_custom_ids))
    return record_payloads(star | {"records": few}).join(F.broadcast(wanted), "warc_custom_id", "right")
