"""Bodies as they are served and bundled: views of captures, download ledgers, offline bundles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from archivolt.functions import native as N
from archivolt.functions import web
from archivolt.operators import closure, export


def viewed(captures: DataFrame, api: str) -> DataFrame:
    """``id``, ``content_type``, ``body`` (binary) as a viewer's frame shows them: HTML with the navigation guard, HTML
    and CSS with their links led into the archive, scripts that cannot leave the frame, anything else as it is.
    ``captures``: id, uri, archived_date, content_type, body (binary). A null body stays null."""
    kind = N.document_kind("content_type")
    text, date = F.decode("body", "UTF-8"), F.date_format("archived_date", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    served = (
        F.when(kind == "html", F.encode(web.html_viewed(api)(text, "uri", date), "UTF-8")).when(kind == "css", F.encode(web.css_rewritten(api)(text, "uri", date), "UTF-8"))
        .when(kind == "js", F.encode(web.navigation_rewritten(text), "UTF-8")).otherwise(F.col("body"))
    )
    documents = captures.where(kind.isin("html", "css", "js")).select("id", "content_type", served.alias("body"))
    others = captures.where(~kind.isin("html", "css", "js")).select("id", "content_type", "body")
    return documents.unionByName(others)


def ranged(bodies: DataFrame, range_header: str) -> DataFrame:
    """``id``, ``status``, ``part``: what a Range header gets of each body (``id``, ``body``); null for 416."""
    asked = bodies.withColumn("r", N.byte_range(F.lit(range_header), F.octet_length("body")))
    part = F.when(F.col("r.status") != 416, F.substring("body", (F.col("r.start") + 1).cast("int"), (F.col("r.end") - F.col("r.start") + 1).cast("int")))
    return asked.select("id", F.col("r.status").alias("status"), part.alias("part"))


def ledger(requests: DataFrame, captures: DataFrame, entries: int = 5_000, total: int = 2 << 30) -> DataFrame:
    """One row per request, in order: ``stored``, ``not-found``, ``no-payload``, ``short-read`` or ``over-budget``.

    ``requests``: export_id, ordinal, id. ``captures``: id (unique), byte_offset, byte_length, file_size (null if the
    file is gone). Entries count against the budget of their export in order until the first that exceeds it; from
    there on nothing is stored. A repeated request is a row of its own.
    """
    rows = requests.join(captures.withColumn("_found", F.lit(True)), "id", "left")
    there = F.greatest(F.lit(0), F.least("byte_length", F.coalesce("file_size", F.lit(0)) - F.col("byte_offset")))
    plain = (
        F.when(F.col("_found").isNull(), "not-found").when(F.col("byte_offset").isNull() | F.col("byte_length").isNull(), "no-payload")
        .when(there != F.col("byte_length"), "short-read").otherwise("stored")
    )
    marked = rows.withColumn("status", plain)
    ahead = Window.partitionBy("export_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stored = F.col("status") == "stored"
    counted = marked.withColumn("_n", F.sum(stored.cast("int")).over(ahead)).withColumn("_bytes", F.sum(F.when(stored, F.col("byte_length")).otherwise(0)).over(ahead))
    over = stored & ((F.col("_n") > entries) | (F.col("_bytes") > total))
    return counted.select("export_id", "ordinal", "id", F.when(over, "over-budget").otherwise(F.col("status")).alias("status"))


@F.pandas_udf(StringType())
def _localised(text: pd.Series, kind: pd.Series, uri: pd.Series, path: pd.Series, targets: pd.Series) -> pd.Series:
    out = []
    for body, k, base, own, pairs in zip(text, kind, uri, path, targets, strict=True):
        known = {p["url"]: p["target"] for p in pairs} if pairs is not None else {}

        def resolve(raw: str, base=base, own=own, known=known) -> str | None:
            url = web.absolute(raw, base)
            document, mark, fragment = (url or "").partition("#")
            return web.relative_path(own, known[document]) + mark + fragment if document in known else url

        out.append(None if body is None else web.rewrite_css(body, resolve) if k == "css" else web.rewrite_html(body, resolve) if k == "html" else body)
    return pd.Series(out, dtype=object)


_stubbed = web._strings(lambda target, path: web.redirect_stub(web.relative_path(path, target)))


def bundle(entries: DataFrame) -> DataFrame:
    """``path`` and ``body`` of an offline bundle of entries (id, url, content_type, status, archive, uuid, body as
    text; optional: export_id, location, digest). Every document's references to other entries lead to their paths,
    all others to their absolute URLs.

    Entries of one ``digest`` and content type are stored once, under the path of the smallest id, to which the
    references to all of them lead; a null digest is shared with none. An entry with a 3xx status whose ``location`` is
    in the bundle becomes a page that leads on to it, whatever its body. ``export_id`` keeps several bundles apart and
    is carried along.
    """
    given = {c: F.lit(None).cast(t) for c, t in (("export_id", "string"), ("location", "string"), ("digest", "string")) if c not in entries.columns}
    entries = entries.withColumns(given) if given else entries
    entries = entries.withColumn("target", F.substring_index(F.when(F.col("status").between(300, 399), N.resolve_location("location", "url")), "#", 1))
    leads = F.col("target").isNotNull()
    kept = entries.groupBy("export_id", F.when(leads, None).otherwise(F.col("digest")).alias("digest"), "content_type").agg(F.min("id").alias("kept_id")).where("digest is not null")
    merged = entries.alias("e").join(kept.alias("k"), F.col("e.export_id").eqNullSafe(F.col("k.export_id")) & (F.col("e.digest") == F.col("k.digest")) & F.col("e.content_type").eqNullSafe(F.col("k.content_type")) & F.col("e.target").isNull(), "left")
    merged = merged.select("e.*", F.coalesce("k.kept_id", "e.id").alias("kept_id"))
    placed = closure.assigned_paths(merged.where("id = kept_id"))
    named = merged.join(placed.withColumnRenamed("id", "kept_id"), "kept_id")
    whereabouts = named.select(F.col("export_id").alias("x"), F.col("url").alias("there"), F.col("path").alias("target_path")).distinct()
    own = named.where("id = kept_id").join(whereabouts, F.col("export_id").eqNullSafe(F.col("x")) & (F.col("target") == F.col("there")), "left").drop("x", "there")
    own = own.withColumn("stub", F.when(F.col("target_path").isNotNull(), _stubbed("target_path", "path")))
    kind = N.document_kind("content_type")
    documents = own.where(F.col("stub").isNull() & F.col("body").isNotNull())
    refs = documents.where(kind.isin("html", "css")).select("id", "export_id", F.explode(web.extracted_references("body", kind, "url")).alias("r")).select("id", "export_id", F.col("r.url").alias("url"))
    anchors = documents.where(kind == "html").select("id", "export_id", F.col("url").alias("base"), F.explode(F.regexp_extract_all("body", F.lit(r"(?i)<a\b[^>]*?href\s*=\s*[\"']?([^\"'\s>]+)"), F.lit(1))).alias("raw"))
    anchors = anchors.select("id", "export_id", F.substring_index(web.absolute_url("raw", "base"), "#", 1).alias("url"))
    wanted = refs.unionByName(anchors).distinct().join(whereabouts, F.col("export_id").eqNullSafe(F.col("x")) & (F.col("url") == F.col("there")))
    targets = wanted.groupBy("id").agg(F.collect_set(F.struct(F.col("there").alias("url"), F.col("target_path").alias("target"))).alias("targets"))
    body = F.when(F.col("stub").isNotNull(), F.col("stub")).otherwise(_localised("body", kind, "url", "path", "targets"))
    return own.join(targets, "id", "left").select("export_id", "path", body.alias("body"))


#: Fixed value: the name of the last entry of a bundle, which lists the others.
MANIFEST = "manifest.json"
WRITTEN = "export_id string, file string, entries bigint, duplicates bigint, bytes bigint"


def write_bundles(bundled: DataFrame, folder: str) -> DataFrame:
    """One stored zip archive for each ``export_id`` (null: ``bundle``) below ``folder``, written by the executors where
    it is to lie, and one ledger row for each: ``export_id``, ``file``, ``entries``, ``duplicates``, ``bytes``.

    An archive is one file and so one task's work; its entries come sorted, spilled if need be, and pass one by one.
    Of entries of one path the first is stored. Null bodies are left out, but listed. The manifest comes last. A task
    that breaks off leaves only a ``.part`` file, and one that is run again writes it anew.
    """
    rows = bundled.select(F.coalesce("export_id", F.lit("bundle")).alias("export_id"), "path", F.encode("body", "UTF-8").alias("body"))

    def run(batches):
        from archivolt.operators.export import ArchiveFile

        open_, name = None, None
        for batch in batches:
            for export_id, path, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if export_id != name:
                    if open_ is not None:
                        yield open_.finished()
                    open_, name = ArchiveFile(folder, export_id), export_id
                open_.add(path, body)
        if open_ is not None:
            yield open_.finished()

    return rows.repartition("export_id").sortWithinPartitions("export_id", "path", F.col("body").asc_nulls_last()).mapInArrow(run, WRITTEN)
