"""URLs, entities, links and rewriting of archived documents.

Rewriting replaces the values it must and leaves every other byte of a document as it is.
"""

from __future__ import annotations

import html
import posixpath
import re
from collections.abc import Callable
from urllib.parse import parse_qsl, quote, unquote, urlencode, urlsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

#: Schemes whose URLs have a host and a path, with their usual ports.
SPECIAL = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21}
#: The named entities of attribute values.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}
NON_FETCHABLE = re.compile(r"^\s*(?:#|(?:data|blob|javascript|mailto|tel|about):)", re.IGNORECASE)


def _named_character(name: str) -> str | None:
    """What stands for ``&name;``: one of the named entities, or a number that is a character."""
    if not name.startswith("#"):
        return ENTITIES.get(name.lower())
    digits, base = (name[2:], 16) if name[1:2] in "xX" else (name[1:], 10)
    if not digits or not digits.isascii() or not digits.isalnum():
        return None
    try:
        character = chr(int(digits, base))
    except (ValueError, OverflowError):
        return None
    return None if character == "\0" or "\ud800" <= character <= "\udfff" else character


def decode_entities(text: str) -> str:
    """Numeric and the six named entities, once, from left to right; what is none, or names no character, stays as
    it is."""
    before, *behind = text.split("&")
    for piece in behind:
        name, end, rest = piece.partition(";")
        character = _named_character(name) if end else None
        before += "&" + piece if character is None else character + rest
    return before


# -- URLs -----------------------------------------------------------------------


def _host(netloc: str, scheme: str) -> str | None:
    at = netloc.rpartition("@")
    host, port = at[2], ""
    if m := re.fullmatch(r"(.*?)(?::(\d*))?", host, re.DOTALL):
        host, port = m[1], m[2] or ""
    host = unquote(host).lower()
    if not host or re.search(r"[\s#/<>?@\\^|%]", host):
        return None
    if not host.isascii():
        try:
            host = host.encode("idna").decode()
        except UnicodeError:
            return None
    if port and int(port) == SPECIAL[scheme]:
        port = ""
    return f"{at[0]}{at[1]}{host}" + (f":{int(port)}" if port else "")


def _dotless(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")[1:]
    for i, p in enumerate(parts):
        dots = p.lower().replace("%2e", ".")
        if dots == "..":
            if out:
                out.pop()
            if i == len(parts) - 1:
                out.append("")
        elif dots != ".":
            out.append(p)
        elif i == len(parts) - 1:
            out.append("")
    return "/" + "/".join(out)


def absolute(raw: str | None, base: str | None) -> str | None:
    """The absolute URL that ``raw`` means on the page ``base``, normalised as browsers do; None if it means none."""
    if raw is None:
        return None
    text = re.sub(r"[\t\r\n]", "", decode_entities(raw).strip("".join(map(chr, range(33)))))
    m = re.match(r"([a-zA-Z][a-zA-Z0-9+.\-]*):", text)
    scheme = m[1].lower() if m else None
    if scheme and scheme not in SPECIAL:
        return scheme + text[m.end() - 1 :]
    parent = urlsplit(base) if base else None
    if not scheme and (parent is None or parent.scheme.lower() not in SPECIAL or not parent.netloc):
        return None
    try:
        rest = text[m.end() :] if m else text
        body, hash_mark, fragment = rest.partition("#")
        body, query_mark, query = body.partition("?")
        body = body.replace("\\", "/")
        relative_scheme = scheme is not None and parent is not None and parent.scheme.lower() == scheme and not body.startswith("/")
        if scheme and not relative_scheme:
            netloc, _, path = body.lstrip("/").partition("/")
            path = "/" + path
        else:
            scheme = scheme or parent.scheme.lower()
            if body.startswith("//"):
                netloc, _, path = body[2:].lstrip("/").partition("/")
                path = "/" + path
            else:
                netloc = parent.netloc
                if body.startswith("/"):
                    path = body
                elif body:
                    path = (parent.path or "/").rpartition("/")[0] + "/" + body
                else:
                    path = parent.path or "/"
                    if not query_mark:
                        query, query_mark = parent.query, "?" * bool(parent.query)
        host = _host(netloc, scheme)
    except ValueError:
        return None
    if host is None:
        return None
    path = quote(_dotless(path), safe="/%:@!$&'()*+,;=-._~[]|^\\")
    query = quote(query, safe="/%:@!$&()*+,;=-._~?[]{}|^`\\'").replace("'", "%27")
    fragment = quote(fragment, safe="/%:@!$&'()*+,;=-._~?[]{}|^\\#")
    return f"{scheme}://{host}{path}" + (f"?{query}" if query_mark and query else "?" if query_mark else "") + (f"#{fragment}" if hash_mark and fragment else "")


def archived_href(raw: str | None, page_uri: str, date: str, api: str, redirect_action: str | None = None, prevent_default: str = "") -> str | None:
    """The archive's address of a link: itself if it is one already or nothing an archive holds, a bare fragment if it
    stays on the page; None for no link."""
    if not raw:
        return None
    decoded = decode_entities(raw)
    if decoded.startswith(api):
        return raw
    url = absolute(raw, page_uri)
    if url is None or not url.startswith(("http://", "https://")):
        return raw
    document, mark, fragment = url.partition("#")
    if mark and fragment and document == page_uri.split("#", 1)[0]:
        return f"#{fragment}"
    fields = {"uri": document, "dateNear": date, "apiUri": api, "preventDefault": prevent_default}
    if redirect_action:
        fields["redirectAction"] = redirect_action
    base, _, query = api.partition("?")
    joined = dict(parse_qsl(query, keep_blank_values=True)) | fields
    return f"{base}?{urlencode(joined)}" + (f"#{fragment}" if fragment else "")


# -- rewriting --------------------------------------------------------------------

Resolve = Callable[[str], str | None]
_CSS_URL = re.compile(r"url\(\s*(\"[^\"]*\"|'[^']*'|[^)\"'\s]+)\s*\)|(@import\s+)(\"[^\"]*\"|'[^']*')", re.IGNORECASE)


def rewrite_css(text: str, resolve: Resolve) -> str:
    """``url(…)`` and ``@import "…"``; quotes are kept, data is left alone."""

    def one(m: re.Match) -> str:
        token = m[1] or m[3]
        mark = token[0] if token[0] in "\"'" else ""
        inner = token[1:-1] if mark else token
        if not inner.strip() or NON_FETCHABLE.match(inner):
            return m[0]
        new = resolve(inner)
        if new is None or new == inner:
            return m[0]
        return f"{m[2]}{mark}{new}{mark}" if m[2] else f"url({mark}{new}{mark})"

    return _CSS_URL.sub(one, text)


def rewrite_srcset(value: str, resolve: Resolve) -> str:
    out = []
    for part in value.split(","):
        url, *descriptor = part.split()[:1] + part.split()[1:] if part.strip() else ("",)
        if url:
            out.append(" ".join([resolve(url) or url, *descriptor]))
    return ", ".join(out)


#: Attributes that load or lead somewhere, and link relations that load.
LINK_ATTRIBUTES = frozenset(["src", "href", "poster", "data-src", "data-lazy-src", "action", "background"])
LOADING = frozenset(["src", "poster", "data-src", "data-lazy-src", "background"])
LOADED_RELS = frozenset("stylesheet icon apple-touch-icon mask-icon preload modulepreload manifest".split()) | {"shortcut icon"}

_TAG = re.compile(r"<([a-zA-Z][\w:-]*)([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)>|<!--.*?-->", re.DOTALL)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:@][\w:.@-]*)(\s*=\s*)(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.DOTALL)
_RAW_TEXT = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in ("script", "style", "textarea", "title", "xmp")}
_REFRESH = re.compile(r"^(\s*\d[\d.]*\s*[;,]\s*(?:url\s*=\s*)?)([\"']?)(.*?)\2\s*$", re.IGNORECASE | re.DOTALL)


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[3][1:-1] if m[3][0] in "\"'" else m[3] for m in _ATTRIBUTE.finditer(text)}


def rewrite_html(document: str, resolve: Resolve, guard: str = "", base: bool = True, scripts: bool = False) -> str:
    """Links, sources, srcsets, inline styles, style sheets and refreshes of a document go through ``resolve``, which
    gets each URL as it is written. ``guard`` is put behind the head tag, else behind the html tag, else in front.
    A ``base`` element is dropped, since the addresses no longer hang on it. ``scripts``: navigation inside scripts is
    led to the archive, too."""

    def tag(name: str, text: str) -> str:
        held = _attributes(text)
        refresh = name == "meta" and held.get("http-equiv", "").lower() == "refresh"

        def one(m: re.Match) -> str:
            key, value = m[1].lower(), m[3]
            mark = value[0] if value[0] in "\"'" else ""
            inner = value[1:-1] if mark else value
            if key in ("srcset", "data-srcset", "imagesrcset"):
                new = rewrite_srcset(inner, resolve)
            elif key == "style":
                new = rewrite_css(inner, resolve)
            elif key == "content" and refresh and (r := _REFRESH.match(inner)):
                new = r[1] + (resolve(r[3]) or r[3])
            elif key in LINK_ATTRIBUTES and inner and not (NON_FETCHABLE.match(inner)):
                new = resolve(inner) or inner
            else:
                return m[0]
            return m[0] if new == inner else f'{m[1]}{m[2]}{mark or chr(34)}{new}{mark or chr(34)}'

        return _ATTRIBUTE.sub(one, text)

    out, at, placed = [], 0, not guard
    while m := _TAG.search(document, at):
        out.append(document[at : m.start()])
        at = m.end()
        if not m[1]:
            out.append(m[0])
            continue
        name = m[1].lower()
        if name == "base" and base:
            continue
        out.append(f"<{m[1]}{tag(name, m[2])}>" if m[2] else m[0])
        if not placed and name == "head":
            out.append(guard)
            placed = True
        if name in _RAW_TEXT and not m[2].rstrip().endswith("/"):
            end = _RAW_TEXT[name].search(document, at)
            stop = end.start() if end else len(document)
            inner = document[at:stop]
            out.append(rewrite_css(inner, resolve) if name == "style" else rewrite_navigation(inner) if name == "script" and scripts else inner)
            at = stop
    out.append(document[at:])
    text = "".join(out)
    if not placed:
        spot = re.search(r"<html\b[^>]*>", text, re.IGNORECASE)
        text = text[: spot.end()] + guard + text[spot.end() :] if spot else guard + text
    return text


#: Objects whose ``location`` is a page's own.
_WINDOWS = r"(?:(?:window|document|self|top|parent|globalThis)\s*\.\s*)"
_LOCATION_CALL = re.compile(rf"(?<![\w$.]){_WINDOWS}*location\s*\.\s*(assign|replace|reload)\s*\(")
_LOCATION_SET = re.compile(rf"(?<![\w$.])(?:{_WINDOWS}+location|{_WINDOWS}*location\s*\.\s*href)\s*=(?!=)\s*([^;\n]+)")


def rewrite_navigation(script: str) -> str:
    """Assignments to and calls on the page's location are turned into calls of the archive's own navigation; a reload
    leads nowhere."""
    script = _LOCATION_CALL.sub(lambda m: "void (" if m[1] == "reload" else "window.__archiveNavigate(", script)
    return _LOCATION_SET.sub(r"window.__archiveNavigate(\1)", script)


#: A script that keeps clicks and submissions of an archived page inside the archive's frame.
NAVIGATION_GUARD = (
    "<script>(function(){if(window.__archiveGuarded)return;window.__archiveGuarded=true;"
    "window.__archiveNavigate=function(u){parent.postMessage({type:'archive-navigate',url:String(u)},'*')};"
    "addEventListener('click',function(e){var a=e.target&&e.target.closest?e.target.closest('a[href]'):null;"
    "if(a&&a.getAttribute('href').charAt(0)!=='#'){e.preventDefault();window.__archiveNavigate(a.href)}},true);"
    "addEventListener('submit',function(e){e.preventDefault();window.__archiveNavigate(e.target.action)},true)})()</script>"
)


# -- references ---------------------------------------------------------------------


def references(document: str, kind: str, base: str) -> list[tuple[str, str]]:
    """What a document (``html`` or ``css``) loads: (attribute, absolute URL without fragment), each once, in order."""
    found: dict[tuple[str, str], None] = {}

    def add(how: str, raw: str) -> None:
        if raw.strip() and not NON_FETCHABLE.match(raw) and (url := absolute(raw, base)) and url.startswith(("http://", "https://")):
            found.setdefault((how, url.split("#", 1)[0]))

    def css(text: str) -> None:
        for m in _CSS_URL.finditer(text):
            add("import" if m[2] else "url", (m[1] or m[3]).strip("\"'"))

    if kind == "css":
        css(document)
        return list(found)
    at = 0
    while m := _TAG.search(document, at):
        at = m.end()
        if not m[1]:
            continue
        name, held = m[1].lower(), _attributes(m[2])
        if name == "base" and held.get("href"):
            base = absolute(held["href"], base) or base
        if name == "link" and held.get("href") and held.get("rel", "").lower().strip() and (held["rel"].lower().strip() in LOADED_RELS or LOADED_RELS & set(held["rel"].lower().split())):
            add("link", held["href"])
        for key, value in held.items():
            if key in LOADING:
                add(key, value)
            elif key in ("srcset", "data-srcset", "imagesrcset"):
                for part in value.split(","):
                    if part.split():
                        add("srcset", part.split()[0])
            elif key == "style":
                css(html.unescape(value))
        if name in _RAW_TEXT and not m[2].rstrip().endswith("/"):
            end = _RAW_TEXT[name].search(document, at)
            stop = end.start() if end else len(document)
            if name == "style":
                css(document[at:stop])
            at = stop
    return list(found)


# -- entries of an exported archive (their paths: functions.paths) -------------------------


def relative_path(origin: str, target: str) -> str:
    """The reference from one entry to another; a document's own name to itself."""
    out = posixpath.relpath(target, posixpath.dirname(origin) or ".")
    return out


def redirect_stub(path: str) -> str:
    """A page that leads on to another entry."""
    at = html.escape(quote(path, safe="/._~@-"), quote=True)
    return f'<!doctype html><meta charset="utf-8"><title>Redirect</title><meta http-equiv="refresh" content="0; url={at}"><a href="{at}">{at}</a>\n'


# -- as column functions ----------------------------------------------------------------


def _strings(function, nulls: bool = False):
    @F.pandas_udf(StringType())
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if values[0] is None and not nulls else function(*values) for values in zip(*columns, strict=True)], dtype=object)

    return run


absolute_url = _strings(lambda raw, base: absolute(raw, base))
entities_decoded = _strings(lambda text: decode_entities(text))

def html_rewritten(api: str):
    """A column function (document, page URI, date) to the document with every link into the archive at ``api``."""
    return _strings(lambda text, uri, date: rewrite_html(text, lambda raw: archived_href(raw, uri, date, api)))


def html_viewed(api: str):
    """:func:`html_rewritten` for a viewer's frame: with the navigation guard, and scripts that cannot leave it."""
    return _strings(lambda text, uri, date: rewrite_html(text, lambda raw: archived_href(raw, uri, date, api), NAVIGATION_GUARD, scripts=True))


navigation_rewritten = _strings(lambda text: rewrite_navigation(text))


def css_rewritten(api: str):
    return _strings(lambda text, uri, date: rewrite_css(text, lambda raw: archived_href(raw, uri, date, api)))


@F.pandas_udf(ArrayType(StructType([StructField("how", StringType()), StructField("url", StringType())])))
def extracted_references(document: pd.Series, kind: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([[] if d is None or b is None else [{"how": h, "url": u} for h, u in references(d, k, b)] for d, k, b in zip(document, kind, base, strict=True)])
