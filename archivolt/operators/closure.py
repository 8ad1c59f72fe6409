"""The dependency closure of pages: breadth-first rounds of joins over references, each to its nearest capture."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.functions import native as N
from archivolt.functions import paths, web
from archivolt.operators.archive import nearest
from archivolt.plans.runtime import cut

MAX_DEPTH = 5


def reference_edges(captures: DataFrame) -> DataFrame:
    """``id``, ``how``, ``url`` for captures with ``id``, ``uri``, ``content_type``, ``body`` (text): what each HTML or
    CSS capture loads. Error captures are not descended into; a null body has no references."""
    kind = N.document_kind("content_type")
    sound = captures.where(kind.isin("html", "css") & F.col("body").isNotNull() & (F.coalesce("status", F.lit(200)) < 400))
    return sound.select("id", F.explode(web.extracted_references("body", kind, "uri")).alias("r")).select("id", "r.how", "r.url")


def dependency_closure(captures: DataFrame, roots: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """What the pages of ``roots`` (``id``) need: ``root_id``, ``url``, ``depth``, ``id`` of the capture nearest to the
    root's time, and ``reason`` if it cannot be had: not-archived, no-payload, unreadable, error-status, redirect,
    depth-limit.

    ``captures``: id, uri, archived_date, content_type, status, body, and optionally the ``error`` with which a body
    could not be read. Each URL comes once per root, at its least
    depth, so a cycle ends by itself. A repeated root is one root.
    """
    edges = cut(reference_edges(captures))
    about = cut(captures.select("id", "status", F.col("body").isNotNull().alias("has_body"), (F.col("error").isNotNull() if "error" in captures.columns else F.lit(False)).alias("broken"), "uri", "archived_date"))
    start = about.join(roots.select("id").distinct(), "id", "left_semi")
    frontier = start.select(F.col("id").alias("root_id"), F.col("archived_date").alias("moment"), F.col("uri").alias("url"), F.lit(0).alias("depth"), "id", F.lit(None).cast("string").alias("reason"))
    frontier = cut(frontier)
    parts = [frontier]
    seen = frontier.select("root_id", "url")
    for depth in range(1, max_depth + 2):
        loads = frontier.where("reason is null").join(edges.select("id", F.col("url").alias("wanted")), "id").select("root_id", "moment", F.col("wanted").alias("url")).distinct()
        loads = cut(loads.join(seen, ["root_id", "url"], "left_anti"))
        seen = seen.unionByName(loads.select("root_id", "url"))
        if not loads.head(1):
            break
        if depth > max_depth:
            parts.append(loads.select("root_id", "moment", "url", F.lit(depth).alias("depth"), F.lit(None).cast("bigint").alias("id"), F.lit("depth-limit").alias("reason")))
            break
        found = nearest(loads.select(F.col("url").alias("uri"), "moment", "root_id"), about.select("uri", "archived_date", F.col("id").alias("found_id"), "status", "has_body", "broken"), ["root_id"], "found_id")
        found = found.select("root_id", F.col("uri").alias("url"), F.col("found_id").alias("id"), "status", "has_body", "broken")
        reason = F.when(F.col("id").isNull(), "not-archived").when(F.col("status") >= 400, "error-status").when(F.col("status") >= 300, "redirect").when(F.col("broken"), "unreadable").when(~F.col("has_body"), "no-payload")
        frontier = cut(loads.join(found, ["root_id", "url"], "left").select("root_id", "moment", "url", F.lit(depth).alias("depth"), "id", reason.alias("reason")))
        parts.append(frontier)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.drop("moment")


def cyclic_references(captures: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``id``, ``url`` and the reason ``cycle`` for references of style sheets that lead back to where they stand, at
    once or over at most ``max_depth`` others. Sheets meet by their exact URLs; each round is a join along references
    between sheets, of which there are few."""
    sheets = captures.where(N.document_kind("content_type") == "css")
    edges = reference_edges(sheets).join(sheets.select("id", F.substring_index("uri", "#", 1).alias("own")), "id").select("id", "own", "url").distinct()
    held = edges.select("own").distinct()
    links = cut(edges.join(held.withColumnRenamed("own", "url"), "url", "left_semi"))
    onward = links.select(F.col("own").alias("at"), F.col("url").alias("next")).distinct()
    walk = links.select("id", "own", "url", F.col("url").alias("at"))
    closed = walk.where("at = own").select("id", "url")
    for _ in range(max_depth):
        walk = cut(walk.where("at <> own").join(onward, "at").select("id", "own", "url", F.col("next").alias("at")).distinct())
        if not walk.head(1):
            break
        closed = closed.unionByName(walk.where("at = own").select("id", "url"))
    return closed.distinct().withColumn("reason", F.lit("cycle"))


def merged_entries(entries: DataFrame) -> DataFrame:
    """One entry per digest and content type, the others its aliases: ``entry_id``, ``digest``, ``content_type``,
    ``aliases``. Entries without a digest stay alone."""
    named = entries.withColumn("_digest", F.coalesce("digest", F.concat(F.lit("id:"), F.col("id").cast("string"))))
    return named.groupBy("_digest", "content_type").agg(F.min("id").alias("entry_id"), F.first("digest").alias("digest"), F.array_sort(F.collect_set("url")).alias("urls")).select("entry_id", "digest", "content_type", "urls")


def assigned_paths(entries: DataFrame) -> DataFrame:
    """``id`` and ``path`` for entries (id, url, content_type, status, archive, uuid; optional: export_id): paths that
    meet in any letter case within an export are all told apart by archive and record, but a single 2xx capture keeps
    its name over redirects. Peers are the entries of one path, so the window is as small as they are few."""
    from pyspark.sql import Window

    named = entries.withColumn("_path", paths.zip_path("url", "content_type"))
    peers = Window.partitionBy(*(["export_id"] if "export_id" in entries.columns else []), F.lower("_path"))
    sound = F.col("status").between(200, 299)
    marked = named.withColumn("_n", F.count("*").over(peers)).withColumn("_sound", F.sum(sound.cast("int")).over(peers))
    keeps = (F.col("_n") == 1) | (sound & (F.col("_sound") == 1))
    return marked.select("id", F.when(keeps, F.col("_path")).otherwise(paths.with_record("_path", "archive", "uuid")).alias("path"))


def manifest(entries: DataFrame, missing: DataFrame) -> DataFrame:
    """One JSON text per entry and per missing reference, entries first: what the export's manifest lists."""
    stored = entries.select(F.lit("entry").alias("kind"), F.to_json(F.struct("id", "path")).alias("line"))
    lost = missing.select(F.lit("missing").alias("kind"), F.to_json(F.struct("url", "reason")).alias("line"))
    return stored.unionByName(lost)
