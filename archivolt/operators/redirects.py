"""Redirect chains: static edges, one per response, then repeated joins along them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.functions import native as N
from archivolt.operators.archive import Archive, nearest
from archivolt.plans.runtime import cut

MAX_HOPS = 20


def redirect_edges(captures: DataFrame) -> DataFrame:
    """``response_id``, ``target`` and ``next_id``: for each capture with a Location header, the capture of exactly
    its target nearest to the capture's own time (``last_modified``, else ``archived_date``). The status is not asked.
    ``next_id`` is null where the target was never captured."""
    return _edges(captures.select("response_id", "uri", "archived_date", "last_modified", N.header("headers", "location").alias("location"))).drop("uri")


def _edges(captures: DataFrame) -> DataFrame:
    located = captures.select("response_id", "uri", "location", F.coalesce("last_modified", "archived_date").alias("moment"))
    located = located.where("location is not null and uri is not null").withColumn("target", N.resolve_location("location", "uri"))
    found = nearest(
        located.select(F.col("target").alias("uri"), "moment", "response_id"),
        captures.select("uri", F.coalesce("last_modified", "archived_date").alias("archived_date"), F.col("response_id").alias("next_id")),
        ["response_id"],
    )
    return located.select("response_id", "uri", "target").join(found.select("response_id", "next_id"), "response_id", "left")


def path_from(archive: Archive, uri: str, moment: str, max_hops: int = MAX_HOPS) -> DataFrame:
    """:func:`redirect_paths` from the capture of ``uri`` nearest to ``moment``, each hop with its capture's columns."""
    found = archive.captures(["response_id", "uri", "archived_date", "last_modified", "headers", "status", "warc_custom_id", "http_version", "content_type_id"])
    path = redirect_paths(found, archive.near(uri, moment).select("response_id"), max_hops)
    return path.join(found.drop("uri", "headers"), "response_id")


def redirect_paths(captures: DataFrame, starts: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """``start_id``, ``hop`` (from 1), ``response_id``, ``uri``, ``resolved_location`` (how the row was reached; null
    for the start). ``starts`` has ``response_id``. A path ends without a location, at a target that was never
    captured, at a URI already on the path, or after ``max_hops`` rows. A repeated start gives one path."""
    captures = cut(captures.select("response_id", "uri", "archived_date", "last_modified", N.header("headers", "location").alias("location")))
    edges = _edges(captures).where("next_id is not null")
    uris = captures.select(F.col("response_id").alias("next_id"), F.col("uri").alias("next_uri"))
    hops = cut(edges.join(uris, "next_id").where("uri <> next_uri").drop("uri"))
    frontier = captures.join(starts.select("response_id").distinct(), "response_id", "left_semi").select(
        F.col("response_id").alias("start_id"), F.lit(1).alias("hop"), "response_id", "uri", F.lit(None).cast("string").alias("resolved_location"), F.array("uri").alias("seen")
    )
    frontier = cut(frontier)
    parts = [frontier]
    for hop in range(2, max_hops + 1):
        frontier = cut(
            frontier.join(hops, "response_id").where(~F.array_contains("seen", F.col("next_uri")))
            .select("start_id", F.lit(hop).alias("hop"), F.col("next_id").alias("response_id"), F.col("next_uri").alias("uri"), F.col("target").alias("resolved_location"), F.concat("seen", F.array("next_uri")).alias("seen"))
        )
        if not frontier.head(1):
            break
        parts.append(frontier)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.drop("seen")
