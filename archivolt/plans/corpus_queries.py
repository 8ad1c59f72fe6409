"""The queries of the general training-data operators (problems 2, 5 and 6) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.operators import heavy_keys as heavy
from archivolt.operators import orphans, packed
from archivolt.plans.runtime import table


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_references(
        orphans.archive_references(table(spark, d, "uris"), table(spark, d, "responses")),
        orphans.archive_parents(table(spark, d, "content_types"), table(spark, d, "records")),
        orphans.archive_removals(table(spark, d, "removed_keys")),
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.distinct_cases(_orphans(spark, d))


def p2_by_month(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphans_by_period(_orphans(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return packed.split_packed(table(spark, d, "content_types"), "id", "type").withColumnRenamed("id", "content_type_id")


def _captures(spark: SparkSession, d: str) -> list[tuple[str, DataFrame, int]]:
    records, history = table(spark, d, "records"), table(spark, d, "response_history")
    return [
        ("records", heavy.per_key_captures(records, "uri_id", "archived_date", "id"), records.count()),
        ("response_history", heavy.per_key_captures(history, "uri", "archived_date", "id"), history.count()),
    ]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    first, second = (
        heavy.heavy_keys(states, total).select(F.lit(name).alias("table_name"), F.col("k").cast("string").alias("key_text"))
        for name, states, total in _captures(spark, d)
    )
    return first.unionByName(second)


def p6_captures(spark: SparkSession, d: str) -> DataFrame:
    first, second = (
        states.select(F.lit(name).alias("table_name"), F.col("k").cast("string").alias("key_text"), "n", "first_us", "last_us", "max_gap_us")
        for name, states, _ in _captures(spark, d)
    )
    return first.unionByName(second)


QUERIES = {"p2_found": p2_found, "p2_by_month": p2_by_month, "p5_found": p5_found, "p6_found": p6_found, "p6_captures": p6_captures}

_ORPHANS = """
with refs as (
  select 'uris' ref_table, id ref_id, 'content_types' parent_table, unnest(list_distinct(content_type_ids)) target_id, created_at at_ from uris
  union all select 'responses', id, 'records', record_id, created_at from responses),
parents as (
  select 'content_types' parent_table, id target_id, created_at at_ from content_types
  union all select 'records', id, created_at from records),
alive as (
  select p.parent_table, p.target_id, p.at_ written, min(r.removed_at) gone
  from (select distinct * from parents) p left join removed_keys r
    on r.table_name = p.parent_table and r.key_id = p.target_id and r.removed_at >= p.at_
  group by all),
orphans as (
  select * from refs where target_id is not null and not exists (
    select 1 from alive a where a.parent_table = refs.parent_table and a.target_id = refs.target_id
      and a.written <= refs.at_ and (a.gone is null or a.gone > refs.at_)))
"""

_RUNS = """
select '{name}' table_name, cast({key} as varchar) key_text, count(*) n, min(us) first_us, max(us) last_us, max(coalesce(us - before, 0)) max_gap_us
from (select {key}, epoch_us(archived_date) us, lag(epoch_us(archived_date)) over (partition by {key} order by archived_date) before from {name} where {key} is not null)
group by {key}
"""

SQL = {
    "p2_found": _ORPHANS + "select distinct ref_table, ref_id, target_id from orphans",
    "p2_by_month": _ORPHANS
    + """select ref_table, parent_table, strftime(at_ at time zone 'UTC', '%Y-%m') "month", count(*) orphan_references, count(distinct target_id) missing_keys
from (select distinct ref_table, parent_table, ref_id, target_id, at_ from orphans) group by all""",
    "p5_found": r"""
with pieces as (
  select id, regexp_extract_all("type", '(?:[^;,|\t\r\n"]|"(?:\\.|[^"\\])*")+') parts from content_types where "type" is not null),
kept as (select id, list_filter(list_transform(parts, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') parts from pieces),
numbered as (select id, unnest(parts) piece, generate_subscripts(parts, 1) pos from kept)
select id content_type_id, cast(pos as integer) pos,
  regexp_replace(regexp_replace(piece, '(^|[^\\])"', '\1', 'g'), '\\(.)', '\1', 'g') val
from numbered""",
    "p6_found": """
select 'records' table_name, cast(uri_id as varchar) key_text from records where uri_id is not null group by uri_id
having count(*) >= 0.02 * (select count(*) from records)
union all
select 'response_history', uri from response_history where uri is not null group by uri
having count(*) >= 0.02 * (select count(*) from response_history)""",
    "p6_captures": _RUNS.format(name="records", key="uri_id") + " union all " + _RUNS.format(name="response_history", key="uri"),
}
