"""Paths of captures in an exported archive, as column expressions.

A path is a list of segments; every rule is an expression over that list or over its last segment, the file, which is
kept as (stem, suffix). Nothing leaves code generation but the higher-order functions themselves.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The extension of each content type, other spellings of it, and names that may not be files.
EXTENSIONS = {
    "text/html": ".html", "application/xhtml+xml": ".html", "text/css": ".css", "text/javascript": ".js", "application/javascript": ".js",
    "application/x-javascript": ".js", "application/json": ".json", "application/manifest+json": ".json", "image/png": ".png", "image/jpeg": ".jpg",
    "image/gif": ".gif", "image/webp": ".webp", "image/avif": ".avif", "image/svg+xml": ".svg", "image/x-icon": ".ico", "image/vnd.microsoft.icon": ".ico",
    "font/woff2": ".woff2", "font/woff": ".woff", "font/ttf": ".ttf", "application/font-woff": ".woff", "application/vnd.ms-fontobject": ".eot",
    "audio/mpeg": ".mp3", "audio/ogg": ".ogg", "video/mp4": ".mp4", "video/webm": ".webm", "text/plain": ".txt", "application/pdf": ".pdf",
    "application/xml": ".xml", "text/xml": ".xml", "application/rss+xml": ".xml",
}
SPELLINGS = {".html": (".html", ".htm", ".xhtml"), ".jpg": (".jpg", ".jpeg"), ".js": (".js", ".mjs"), ".xml": (".xml", ".rss"), ".json": (".json", ".webmanifest")}
RESERVED = "(?i)^(?:con|prn|aux|nul|com[1-9]|lpt[1-9])(?:\\.[^.]*)?$"
#: The longest segment and path, the longest cleaned name, and the least that is left of a stem.
SEGMENT_MAX, PATH_MAX, NAME_MAX, STEM_MIN = 96, 180, 80, 8

_URL = r"(?is)^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)(?::\d*)?([^?#]*)(?:\?([^#]*))?"
_AUTHORITY = r"(?is)^[a-z][a-z0-9+.\-]*://([^/?#]+)"
_SUFFIX = r"(?s)^.+(\.[^.]*)$"


def _text(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _let(value: Column, body) -> Column:
    """``body`` of a value that is used more than once and evaluated once."""
    return F.transform(F.array(value), body)[0]


def short_hash(text: Column | str) -> Column:
    """32-bit FNV-1a over UTF-16 code units, in hexadecimal."""
    step = lambda h, unit: h.bitwiseXOR(unit) * F.lit(0x01000193).cast("bigint") % F.lit(1 << 32)

    def character(h: Column, c: Column) -> Column:
        code = F.ascii(c).cast("bigint")
        astral = code - 0x10000
        pair = step(step(h, F.lit(0xD800) + F.shiftright(astral, 10)), F.lit(0xDC00) + astral % 0x400)
        return F.when(code < 0x10000, step(h, code)).otherwise(pair)

    characters = F.filter(F.split(_text(text), ""), lambda c: c != "")
    return F.lpad(F.lower(F.hex(F.aggregate(characters, F.lit(0x811C9DC5).cast("bigint"), character))), 8, "0")


def suffix_of(name: Column) -> Column:
    """The extension with its dot, or nothing; a leading dot begins no extension."""
    return F.regexp_extract(name, _SUFFIX, 1)


def stem_of(name: Column) -> Column:
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix_of(name)))


def _shortened(name: Column, tail: Column) -> Column:
    """The beginning of ``name`` that leaves room for ``tail`` in a segment."""
    return F.concat(F.substring(name, F.lit(1), F.greatest(F.lit(STEM_MIN), F.lit(SEGMENT_MAX) - F.length(tail))), tail)


def safe_segment(raw: Column | str) -> Column:
    """A segment that any system accepts: no special characters, no trailing dots or blanks, not a reserved name, and
    if it is too long, short with a hash of what it was."""
    raw = _text(raw)
    plain = F.regexp_replace(F.regexp_replace(raw, r"[<>:\"|?*\\/\x00-\x1f\x7f]", "_"), r"[. ]+$", "")
    allowed = _let(plain, lambda p: F.when(p == "", "_").when(p.rlike(RESERVED), F.concat(F.lit("_"), p)).otherwise(p))
    return _let(allowed, lambda n: F.when(F.length(n) <= SEGMENT_MAX, n).otherwise(_shortened(stem_of(n), F.concat(F.lit("~"), short_hash(raw), suffix_of(n)))))


def _decoded(path: Column) -> Column:
    """Percent signs resolved; as it is where they are none."""
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)


def _walked(path: Column) -> Column:
    """The segments that are left when ``..`` takes one back, never beyond the root."""
    step = lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(s.isin("", "."), done).otherwise(F.concat(done, F.array(s)))
    return F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)


def extension_for(content_type: Column | str) -> Column:
    """The extension that a content type asks for; nothing for an unknown one."""
    known = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))
    return F.coalesce(F.element_at(known, F.lower(F.trim(F.substring_index(F.coalesce(_text(content_type), F.lit("")), ";", 1)))), F.lit(""))


def _has_spelling(name: Column, extension: Column) -> Column:
    other = F.lit(False)
    for kind, spellings in SPELLINGS.items():
        other = other | (extension == kind) & F.lower(name).rlike("(?:" + "|".join(s.replace(".", "\\.") for s in spellings) + ")$")
    return other | F.endswith(F.lower(name), extension)


def zip_path(url: Column | str, content_type: Column | str) -> Column:
    """Where a captured URL lies in an exported archive: host, path, a hash of the query, the type's extension. A text
    that is no URL with a host lies under ``_unparsed``; null gives null."""
    url = _text(url)
    host, path, query = (F.regexp_extract(url, _URL, k) for k in (1, 2, 3))
    parts = F.struct(_decoded(path).alias("path"), F.transform(_walked(_decoded(path)), safe_segment).alias("segments"), extension_for(content_type).alias("extension"), query.alias("query"))
    placed = _let(safe_segment(F.lower(host)), lambda root: _let(parts, lambda p: _placed(root, p["path"], p["segments"], p["extension"], p["query"])))
    return F.when(url.isNull(), None).when(host == "", F.concat(F.lit("_unparsed/"), safe_segment(url))).otherwise(placed)


def _placed(root: Column, path: Column, segments: Column, extension: Column, query: Column) -> Column:
    folder = (F.size(segments) == 0) | F.endswith(path, F.lit("/"))
    last = F.try_element_at(segments, F.lit(-1))
    file = F.when(folder, F.concat(F.lit("index"), F.when(extension == "", ".html").otherwise(extension))).when(_has_spelling(last, extension), last).otherwise(F.concat(last, extension))
    asked = _let(file, lambda f: F.when(query == "", f).otherwise(F.concat(stem_of(f), F.lit("__q"), short_hash(query), suffix_of(f))))
    above = F.when(folder, segments).otherwise(F.slice(segments, F.lit(1), F.greatest(F.size(segments) - 1, F.lit(0))))
    deep = lambda whole, name: F.concat_ws("/", root, F.lit("_deep"), short_hash(whole), name)
    return _let(asked, lambda name: _let(F.array_join(F.concat(F.array(root), above, F.array(name)), "/"), lambda whole: F.when(F.length(whole) <= PATH_MAX, whole).otherwise(deep(whole, name))))


def _cleaned(text: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._~@\-]+", "-"), r"^\.+", ""), 1, NAME_MAX)


def entry_path(uri: Column | str, capture_id: Column | str) -> Column:
    """host/segments/stem[-query].id.extension with a narrow set of characters; the id is cleaned like the rest."""
    uri, identity = _text(uri), F.coalesce(_text(capture_id), F.lit(""))
    host = F.regexp_extract(uri, _AUTHORITY, 1)
    known = host != ""
    path, query = (F.when(known, F.regexp_extract(uri, _URL, k)).otherwise("") for k in (2, 3))
    segments = F.filter(F.transform(F.split(path, "/"), _cleaned), lambda s: s != "")
    file = F.coalesce(F.try_element_at(segments, F.lit(-1)), F.lit("index"))
    suffix = F.coalesce(F.nullif(suffix_of(file), F.lit("")), F.lit(".html"))
    name = F.concat(stem_of(file), F.when(query == "", "").otherwise(F.concat(F.lit("-"), _cleaned(F.concat(F.lit("?"), query)))), F.lit("."), _cleaned(identity), suffix)
    above = F.slice(segments, F.lit(1), F.greatest(F.size(segments) - 1, F.lit(0)))
    root = F.coalesce(F.nullif(_cleaned(F.lower(host)), F.lit("")), F.lit("unknown-host"))
    return F.when(uri.isNotNull(), F.array_join(F.concat(F.array(root), above, F.array(name)), "/"))


def with_record(path: Column | str, archive: Column | str, record_id: Column | str) -> Column:
    """``path`` told apart from others of its name by archive and record: stem.archive.id.extension. The archive loses
    its file ending, the id its ``urn:uuid:`` wrapping, and both are safe segments; what gets too long loses first
    the end of its stem, then its folders."""
    path = _text(path)
    file = F.substring_index(path, "/", -1)
    folder = F.substring(path, F.lit(1), F.length(path) - F.length(file))
    source = safe_segment(F.regexp_replace(F.coalesce(_text(archive), F.lit("")), r"(?i)\.w?arc(?:\.gz)?$", ""))
    identity = F.regexp_replace(F.coalesce(_text(record_id), F.lit("")), r"(?i)^<?urn:uuid:|>$", "")
    tail = F.concat(F.lit("."), source, F.lit("."), F.when(identity == "", "unknown").otherwise(safe_segment(identity)), suffix_of(file))
    parts = F.struct(folder.alias("folder"), stem_of(file).alias("stem"), tail.alias("tail"))

    def fitted(p: Column) -> Column:
        full, short = F.concat(p["folder"], p["stem"], p["tail"]), _shortened(p["stem"], p["tail"])
        deep = F.concat_ws("/", F.when(p["folder"] == "", "_nohost").otherwise(F.substring_index(p["folder"], "/", 1)), F.lit("_deep"), short_hash(path), short)
        return F.when(F.length(full) <= PATH_MAX, full).when(F.length(p["folder"]) + F.length(short) <= PATH_MAX, F.concat(p["folder"], short)).otherwise(deep)

    return _let(parts, fitted)
