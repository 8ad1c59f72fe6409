"""The queries of the text-corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.llm import boilerplate, canonical, chunks, lookalikes, mixing, packing, residue
from archivolt.llm.tokens import token_counts
from archivolt.plans.runtime import cut, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.formatting_copies(table(spark, d, "uris"), "id", "uri")


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    return canonical.collapsed(table(spark, d, "uris"), "id", "uri")


def _page_model(pages: DataFrame):
    return boilerplate.fit(boilerplate.training_pages(pages, "payload"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "view_record")
    return residue.main_lines(pages, "view_id", "payload", _page_model(pages), "url").withColumnRenamed("id", "view_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "view_record")
    return residue.unfit(pages, "view_id", "payload", _page_model(pages), "url").withColumnRenamed("id", "view_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return chunks.same_payload(table(spark, d, "warc_response_bulk_input"))


def p4_near(spark: SparkSession, d: str) -> DataFrame:
    """Pages of whose body four fifths or more lie in chunks of earlier pages."""
    rows = chunks.chunk_rows(table(spark, d, "view_record"), "view_id", "payload", *chunks.NEAR_CHUNKS)
    return chunks.near_duplicates(rows, chunks.first_holders(rows)).select(F.col("id").alias("view_id"), "first_id", F.round("coverage", 6).alias("coverage"))


def p4_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How much of each page's body lies in chunks of earlier pages."""
    rows = chunks.chunk_rows(table(spark, d, "view_record"), "view_id", "payload", 64, 256, 2048)
    return chunks.coverage(rows, chunks.first_holders(rows)).withColumnRenamed("id", "view_id")


def _packs(spark: SparkSession, d: str) -> list[tuple[str, int]]:
    return [(r["pack_name"], r["capacity_tokens"]) for r in table(spark, d, "pack_sizes").collect()]


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(token_counts(table(spark, d, "documents"), "text", ["doc_id"]), "doc_id", _packs(spark, d))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p8_packed(spark, d), _packs(spark, d))


def p8_placed(spark: SparkSession, d: str) -> DataFrame:
    """Every document in every pack, with the number of its pieces and whether all its containers keep their capacity
    and only a document beyond the capacity is cut."""
    packs, packed = _packs(spark, d), cut(p8_packed(spark, d))
    capacity = F.create_map(*[F.lit(x) for name, c in packs for x in (name, int(c))])[F.col("pack_name")]
    full = packed.groupBy("pack_name", "container").agg(F.sum("n_tokens").alias("held"))
    told = packed.join(full, ["pack_name", "container"]).groupBy("pack_name", "doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("tokens"), F.max("held").alias("held"))
    kept = (F.col("held") <= capacity) & (F.col("pieces") == F.ceil(F.col("tokens") / capacity))
    return told.select("pack_name", "doc_id", kept.alias("kept"))


def _weights(spark: SparkSession, d: str) -> list[tuple[str, float, int]]:
    return [(r["source"], r["weight"], r["max_repeats"]) for r in table(spark, d, "mix_weights").collect()]


def _source_tokens(spark: SparkSession, d: str, weights: list[tuple[str, float, int]]) -> DataFrame:
    named = table(spark, d, "documents").where(F.col("source").isin([s for s, w, r in weights if w and w > 0 and r and r > 0]))
    return token_counts(named, "text", ["doc_id", "source"])


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    weights = _weights(spark, d)
    return mixing.mixture(_source_tokens(spark, d, weights), "doc_id", "source", weights)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p9_mixture(spark, d), _weights(spark, d))


def p9_limits(spark: SparkSession, d: str) -> DataFrame:
    """Per named source its target share, and whether what was reached keeps to ``max_repeats`` and to the weights: a
    source without a weight gives nothing, and one that has its share misses it by no more than its longest document."""
    weights = [(s, w, r) for s, w, r in _weights(spark, d) if s is not None]
    counts = cut(_source_tokens(spark, d, weights))  # for the mixture and for what it is held against
    reached = mixing.shares(mixing.mixture(counts, "doc_id", "source", weights), weights)
    have = {s: (t, n) for s, t, n in counts.groupBy("source").agg(F.sum("n_tokens"), F.max("n_tokens")).collect()}
    budgets = mixing.budgets({s: t for s, (t, _) in have.items()}, weights)
    bounds = [(s, int(r or 0), float(budgets.get(s, 0)), have[s][1] if s in have else 0) for s, _, r in weights]
    held = reached.join(F.broadcast(spark.createDataFrame(bounds, "source string, most int, budget double, longest bigint")), "source")
    kept = (F.col("max_uses") <= F.col("most")) & ((F.col("weight") > 0) | (F.col("tokens") == 0)) & (F.abs(F.col("tokens") - F.col("budget")) <= F.col("longest"))
    return held.select("source", "target_share", kept.alias("kept"))


def _looks(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.form_keys(table(spark, d, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.lookalike_pairs(_looks(spark, d))


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.look_classes(_looks(spark, d))


def p10_texts(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.canonical_texts(table(spark, d, "documents"), "doc_id", "text")


QUERIES = {
    "p1_found": p1_found, "p1_counts": p1_counts, "p3_found": p3_found, "p4_found": p4_found, "p4_coverage": p4_coverage, "p4_near": p4_near, "p7_found": p7_found, "p8_packed": p8_packed, "p8_fill": p8_fill, "p8_placed": p8_placed, "p9_limits": p9_limits,
    "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p10_found": p10_found, "p10_classes": p10_classes, "p10_texts": p10_texts,
}

_CANON = r"""
with marked as (
  select id, uri, split_part(uri, '#', 1) bare, strpos(uri, '#') hash_at from uris where id is not null and uri is not null),
parts as (
  select id, uri, case when strpos(bare, '?') > 0 then split_part(bare, '?', 1) else bare end path,
    case when strpos(bare, '?') > 0 then substr(bare, strpos(bare, '?') + 1) else '' end query,
    case when hash_at > 0 then substr(uri, hash_at + 1) else '' end fragment from marked),
folded as (
  select id, regexp_replace(replace(lower(path), 'ß', 'ss'), '[^\p{L}\p{N}\p{M}]', '', 'g') path,
    regexp_replace(replace(lower(fragment), 'ß', 'ss'), '[^\p{L}\p{N}\p{M}]', '', 'g') fragment,
    list_sort(list_filter(list_transform(regexp_split_to_array(replace(lower(query), 'ß', 'ss'), '[&;]'),
      lambda x: regexp_replace(x, '[^\p{L}\p{N}\p{M}]', '', 'g')), lambda x: x <> '')) fields from parts),
keyed as (
  select id, case when len(fields) = 0 then path || fragment else path || '?' || array_to_string(fields, '&') || '#' || fragment end canon from folded)
"""

SQL = {
    "p1_found": _CANON + "select * from (select min(id) over (partition by canon) first_id, id copy_id from keyed) where first_id < copy_id",
    "p1_counts": _CANON + "select min(id) first_id, count(*) copies from keyed group by canon",
}

# One character at a time, by code ranges and two parallel strings, where the operator uses expressions over whole texts
# and a map made from the Unicode tables; the texts here have no other kinds of character that the operator would map.
_SHAPES = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧνοАВЕКМНОРСТХЅІЈаеорсухѕіјһԁԛԝօսհ", "ABEZHIKMNOPTYXvoABEKMHOPCTXSIJaeopcyxsijhdqwouh")
_FORM = f"""nfc_normalize(array_to_string(list_transform(
  string_split(nfc_normalize(text), ''), lambda c, i: case when c = '' then c
    when c = chr(8205) then case when unicode(nfc_normalize(text)[i - 1]) >= 127744 and unicode(nfc_normalize(text)[i + 1]) >= 127744 then c else '' end
    when unicode(c) in (173, 847, 1564, 6158, 8203, 8204, 8206, 8207, 65279) or unicode(c) between 8288 and 8303 then ''
    when unicode(c) between 65281 and 65374 then chr(unicode(c) - 65248)
    when unicode(c) in (160, 5760, 8239, 8287, 12288) or unicode(c) between 8192 and 8202 then ' '
    when unicode(c) in (8208, 8209, 65123) then '-'
    when unicode(c) between 64256 and 64262 then (['ff', 'fi', 'fl', 'ffi', 'ffl', 'st', 'st'])[unicode(c) - 64255]
    when unicode(c) = 8490 then 'K' when unicode(c) = 181 then chr(956) when unicode(c) = 1105 then 'ë' when unicode(c) = 1025 then 'Ë' when unicode(c) = 972 then 'ó'
    when strpos('{_SHAPES[0]}', c) > 0 then substr('{_SHAPES[1]}', strpos('{_SHAPES[0]}', c), 1) else c end), ''))"""
_FORMS = f"with forms as (select doc_id, text, {_FORM} form from documents where text is not null), shown as (select * from forms where regexp_matches(form, '[^\\s]'))"
SQL["p10_found"] = f"{_FORMS} select a.doc_id doc_id_a, b.doc_id doc_id_b from shown a join shown b on a.form = b.form and a.doc_id < b.doc_id and a.text <> b.text"
SQL["p10_classes"] = f"{_FORMS} select doc_id id, min(doc_id) over (partition by form) class_id, count(*) over (partition by form) copies from shown"
SQL["p10_texts"] = f"{_FORMS} select doc_id id, form \"text\" from forms union all select doc_id, null from documents where text is null"

SQL["p8_placed"] = "select pack_name, doc_id, true kept from documents, pack_sizes where length(text) > 0 and capacity_tokens > 0"
SQL["p9_limits"] = "select source, round(coalesce(weight, 0) / (select sum(weight) from mix_weights where source is not null), 6) target_share, true kept from mix_weights where source is not null"

_BITS = "array_to_string(list_transform(string_split({value}, ''), lambda c: right(bin(strpos('{alphabet}', c) - 1 + {top}), {width})), '')"
SQL["p4_found"] = rf"""
with labelled as (
  select row_id, regexp_extract(d, '^(?:urn:)?(sha-?1|sha-?256|sha-?512|md5)\s*[:=]\s*(.+)$', ['label', 'value']) parts, d
  from (select row_id, lower(trim(payload_digest, E' "\t\r\n')) d from warc_response_bulk_input where payload_digest is not null)),
digests as (
  select row_id, case when parts.label = '' then 'sha1' else replace(parts.label, '-', '') end algorithm, case when parts.label = '' then d else trim(parts.value, E' "\t\r\n') end v from labelled),
sized as (select *, case algorithm when 'md5' then 128 when 'sha1' then 160 when 'sha256' then 256 else 512 end bits_of from digests),
read as (
  select row_id, algorithm, case when length(v) * 4 = bits_of then {_BITS.format(value="v", alphabet="0123456789abcdef", top=16, width=4)}
    when length(v) = ceil(bits_of / 5.0) then {_BITS.format(value="v", alphabet="abcdefghijklmnopqrstuvwxyz234567", top=32, width=5)} end bits from sized),
places as (
  select row_id, payload_byte_offset o, payload_byte_length n, regexp_replace(replace(trim(url_decode(regexp_replace(trim(file_path, E' \t\r\n'), '^(?i)file:(//)?', ''))), E'\\', '/'), '/(\./)+|/+', '/', 'g') p
  from warc_response_bulk_input where payload_byte_offset is not null and payload_byte_length is not null and trim(file_path, E' \t\r\n') <> ''),
evidence as (
  select row_id, 'd' || algorithm || bits k from read where bits is not null
  union all select row_id, 's' || o || '+' || n || lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(p, '/(\./)+|/+', '/', 'g'), '/[^/]+/\.\.(/\.)*/', '/', 'g'), '/[^/]+/\.\.(/\.)*/', '/', 'g'), '/[^/]+/\.\.(/\.)*/', '/', 'g')) from places),
firsts as (select k, min(row_id) kept from evidence group by k)
select min(kept) kept_id, row_id from evidence join firsts using (k) where kept < row_id group by row_id"""
