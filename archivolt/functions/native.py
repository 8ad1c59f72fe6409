"""Scalar functions over columns that stay inside code generation: content types, URIs, headers, ranges, chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(column) -> Column:
    return F.col(column) if isinstance(column, str) else column


# -- content types -----------------------------------------------------------


def content_type_base(content_type) -> Column:
    """``type/subtype`` in lower case; null if blank."""
    return F.nullif(F.lower(F.trim(F.split_part(_c(content_type), F.lit(";"), F.lit(1)))), F.lit(""))


def content_type_charset(content_type) -> Column:
    """The charset parameter in lower case without blanks and quotes; null if there is none."""
    found = F.regexp_extract(F.lower(_c(content_type)), r"charset\s*=\s*([^;]+)", 1)
    return F.nullif(F.regexp_replace(found, r'[ "]', ""), F.lit(""))


def essence(content_type) -> Column:
    return F.lower(F.trim(F.split_part(F.coalesce(_c(content_type), F.lit("")), F.lit(";"), F.lit(1))))


def document_kind(content_type) -> Column:
    """``html``, ``css``, ``js`` or ``other``."""
    e = essence(content_type)
    return (
        F.when(e.isin("text/html", "application/xhtml+xml"), "html").when(e == "text/css", "css")
        .when(e.isin("text/javascript", "application/javascript", "application/x-javascript", "application/ecmascript"), "js").otherwise("other")
    )


def blob_type(http_header, stored) -> Column:
    """The full HTTP header if there is one, else the stored type, else a stream of bytes."""
    return F.coalesce(F.nullif(F.trim(_c(http_header)), F.lit("")), F.nullif(F.trim(_c(stored)), F.lit("")), F.lit("application/octet-stream"))


def joined_content_type(content_type) -> Column:
    """Parameters trimmed and joined by ``"; "``."""
    return F.array_join(F.transform(F.split(_c(content_type), ";"), lambda x: F.trim(x)), "; ")


# -- URIs --------------------------------------------------------------------


def recursion_level(uri) -> Column:
    """The number of non-empty path segments; 0 for null."""
    bare = F.regexp_replace(F.coalesce(_c(uri), F.lit("")), r"^(?i)[a-z][a-z0-9+.\-]*://", "")
    path = F.regexp_replace(F.regexp_replace(bare, r"^[^/?#]*", ""), r"[?#][\s\S]*$", "")
    return F.size(F.array_remove(F.split(path, "/"), ""))


def strip_fragment(uri) -> Column:
    return F.substring_index(_c(uri), "#", 1)


def fragment_of(uri) -> Column:
    """The fragment with its ``#``; empty if there is none or it is a bare ``#``."""
    rest = F.substring(_c(uri), F.length(strip_fragment(uri)) + 1, F.length(_c(uri)))
    return F.when(rest == "#", F.lit("")).otherwise(rest)


def same_document(a, b) -> Column:
    return strip_fragment(a) == strip_fragment(b)


def resolve_location(location, uri) -> Column:
    """A redirect's target: ``//x`` takes the scheme, ``/x`` the origin, an absolute one stands, any other hangs on
    the origin's root; null without a location."""
    at, base = _c(location), _c(uri)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    return (
        F.when(at.isNull(), F.lit(None).cast("string")).when(at.startswith("//"), F.concat(scheme, at))
        .when(at.startswith("/"), F.concat(origin, at)).when(at.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), at).otherwise(F.concat(origin, F.lit("/"), at))
    )


def non_fetchable(reference) -> Column:
    return F.lower(F.trim(_c(reference))).rlike(r"^(?:#|(?:data|blob|javascript|mailto|tel|about):)")


def basename(path) -> Column:
    return F.substring_index(_c(path), "/", -1)


def record_uuid(text) -> Column:
    """The UUID of ``<urn:uuid:…>``; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(_c(text), r"(?i)urn:uuid:([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})", 1)), F.lit(""))


def target_uri(text) -> Column:
    """``<…>`` unwrapped and trimmed; null if blank."""
    return F.nullif(F.trim(F.regexp_replace(F.trim(_c(text)), r"^<([\s\S]*)>$", "$1")), F.lit(""))


# -- headers, status, numbers --------------------------------------------------


def header(headers, name: str) -> Column:
    """A header's value: the exact spelling, else the first in any letter case."""
    exact = F.try_element_at(_c(headers), F.lit(name))
    folded = F.map_values(F.map_filter(_c(headers), lambda k, v: F.lower(k) == name.lower()))
    return F.coalesce(exact, F.try_element_at(folded, F.lit(1)))


def is_chunked(transfer_encoding) -> Column:
    """Whether ``chunked`` is among the codings of a list such as ``gzip, chunked``."""
    codings = F.transform(F.split(F.lower(_c(transfer_encoding)), ","), lambda x: F.trim(x))
    return F.coalesce(F.array_contains(codings, "chunked"), F.lit(False))


def is_redirect(status) -> Column:
    return _c(status).between(300, 399)


def percent(part, whole) -> Column:
    """Two decimals; null without a whole."""
    return F.when(_c(whole) > 0, F.round(100.0 * _c(part) / _c(whole), 2))


def chunk_sizes(literal) -> Column:
    """The positive sizes of ``{1,2}`` or ``[1,2]``."""
    numbers = F.transform(F.split(F.regexp_replace(_c(literal), r"[{}\[\]\s]", ""), ","), lambda x: x.try_cast("bigint"))
    return F.filter(numbers, lambda n: n > 0)


def chunk_ranges(sizes) -> Column:
    """For the sizes of a chunked body, where each chunk's data begins and its length, given canonical size lines
    (lower-case hexadecimal, no extensions): array of ``(start, length)``."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("out"))

    def step(acc, n):
        begin = acc["at"] + F.length(F.hex(n)) + 2
        one = F.struct(begin.cast("bigint").alias("start"), n.cast("bigint").alias("length"))
        return F.struct((begin + n + 2).cast("bigint").alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    return F.aggregate(_c(sizes), start, step, lambda acc: acc["out"])


def byte_range(range_header, size) -> Column:
    """What a Range header asks of a body: ``status`` 200, 206 or 416 with ``start`` and ``end`` (inclusive; null for
    416). Malformed and multiple ranges give the whole body; ends are clamped."""
    text, n = F.trim(_c(range_header)), _c(size).cast("bigint")
    parts = F.regexp_extract(text, r"^bytes=(\d*)-(\d*)$", 1), F.regexp_extract(text, r"^bytes=(\d*)-(\d*)$", 2)
    formed = F.coalesce(text.rlike(r"^bytes=\d*-\d*$"), F.lit(False)) & ~((parts[0] == "") & (parts[1] == ""))
    first, last = (p.try_cast("bigint") for p in parts)
    start = F.when(parts[0] == "", F.greatest(F.lit(0), n - last)).otherwise(first)
    end = F.when((parts[0] == "") | (parts[1] == ""), n - 1).otherwise(F.least(last, n - 1))
    bad = (start >= n) | (start > end) | ((parts[0] == "") & (last == 0))
    answer = lambda s, a, b: F.struct(F.lit(s).alias("status"), a.cast("bigint").alias("start"), b.cast("bigint").alias("end"))
    whole = answer(200, F.lit(0), n - 1)
    return F.when(~formed, whole).when(bad, answer(416, F.lit(None), F.lit(None))).otherwise(answer(206, start, end))


def json_object(text) -> Column:
    """A JSON object's members as text; what is no object is kept whole under ``raw``; null gives an empty map."""
    held = F.from_json(_c(text), "map<string,string>")
    whole = F.create_map(F.lit("raw"), _c(text))
    return F.when(_c(text).isNull(), F.create_map().cast("map<string,string>")).when(held.isNull(), whole).otherwise(held)
