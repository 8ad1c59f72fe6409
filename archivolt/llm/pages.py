"""Pages as sequences of leaf blocks: the stretches of text between block-level tags, or the lines of plain text."""

from __future__ import annotations

import html
import json
import re
from dataclasses import dataclass
from itertools import islice

#: Tags that do not end a stretch of text.
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em i img ins kbd mark q s samp small span strike strong sub sup time tt u var button label input svg path wbr".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr path".split())
#: Tags whose elements group blocks.
GROUPING = frozenset("body div section main article aside footer header nav ul ol table td form".split())
#: Tags whose content is not text of the page.
RAW = frozenset(["script", "style", "template"])
#: Tags that an opening tag of the same group closes if it is still open.
CLOSES = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}

_ATTRIBUTES = r"[^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*"
_TOKEN = re.compile(
    rf"(?P<text>[^<]+)|<!--.*?(?:-->|\Z)|<(?P<raw>script|style|template)(?![\w:-]){_ATTRIBUTES}>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<shut>/?)(?P<name>[a-z][\w:-]*){_ATTRIBUTES}>|<[!?][^>]*>|(?P<stray><)",
    re.DOTALL | re.IGNORECASE,
)
_TAGGED = re.compile(r"<!doctype html|<(?:html|head|body|title|div|p|main|article|section|header|nav|h[1-6]|ul|ol|li|table|tr|td|a|span|footer|aside|blockquote|pre|br)\b[^>]*>", re.IGNORECASE)
#: What may precede the first element of a document: blanks, instructions, comments, the document type.
_PROLOG = re.compile(r"(?:\s|<\?.*?\?>|<!--.*?-->|<!DOCTYPE(?:[^\[>\"']|\"[^\"]*\"|'[^']*'|\[.*?\]\s*(?=>))*>)*+", re.IGNORECASE | re.DOTALL)
_UNSEEN = re.compile(r"<(script|style)\b.*?</\1\s*>", re.IGNORECASE | re.DOTALL)


@dataclass(slots=True)
class Block:
    """A leaf block: its text, its lines, its own tag, the open tags from the root, and what the text consists of."""

    text: str
    lines: list[int]
    tag: str
    path: tuple[str, ...]
    linked: int = 0  # characters within links
    buttons: int = 0
    bold: int = 0
    links: int = 0
    chain: tuple[int, ...] = ()  # numbers of the open grouping elements, from the root


def kind_of(payload: str | None) -> str:
    """``none`` (null or blank), ``html``, ``text``, or one of ``json``, ``xml``, ``css``, ``script``."""
    if payload is None or not (body := payload.strip("﻿ \t\r\n")):
        return "none"
    if body[:5].lower() == "<?xml" and not re.match(r"<html\b", body[_PROLOG.match(body).end() :][:6], re.IGNORECASE):
        return "xml"
    if body[0] in "{[" and body[-1] in "}]":
        try:
            json.loads(body)
            return "json"
        except ValueError:
            if re.match(r"[{\[]\s*\"[^\"]*\"\s*:", body):
                return "json"
    if body[0] == "<":
        return "html"
    tagged = "<" in body and len(list(islice(_TAGGED.finditer(body), 3))) == 3  # a script or stylesheet may name tags, too
    lines = [x.strip() for x in (_UNSEEN.sub("", body) if tagged else body).splitlines() if x.strip()]
    css = sum(bool(re.match(r"[^{}]*\{[^{}]*:[^{}]*\}$|[.#@]?[\w\-.#: ,>*]+\{$|[\w-]+\s*:\s*[^;]+;$|\}$|/\*|\*/", x)) for x in lines)
    if 2 * css > len(lines) and "{" in body and ":" in body:
        return "css"
    code = sum(bool(re.match(r"(?:export |async )?function\b.*[({]|(?:var|let|const)\s+[\w{\[].*[=;]|(?:if|for|while|return|import|export|window|document|module)\b.*[;{(]|[})\];]+$|//|/\*|\*", x)) for x in lines)
    return "script" if 2 * code > len(lines) else "html" if tagged else "text"


def blocks_of(payload: str, kind: str) -> list[Block]:
    """The page's leaf blocks in order; pages without tags give one block a line. Data gives none."""
    if kind == "text":
        return [Block(t, [i], "line", ()) for i, x in enumerate(payload.split("\n")) if (t := x.strip("﻿ \t\r"))]
    return _html_blocks(payload.replace("\ufeff", "")) if kind == "html" else []


class _Open:
    """An open element: its tag, and what a block inside it needs to know of its place."""

    __slots__ = ("tag", "path", "chain", "own")

    def __init__(self, tag: str, within: _Open | None, number: int) -> None:
        path, chain, own = (within.path, within.chain, within.own) if within else ((), (), "root")
        self.tag, self.path = tag, (*path, tag)
        self.chain = (*chain, number) if tag in GROUPING else chain
        self.own = own if tag in INLINE else tag


_ROOT = _Open("root", None, 0)
_ROOT.path, _ROOT.chain = (), ()


def _html_blocks(payload: str) -> list[Block]:
    out: list[Block] = []
    stack: list[_Open] = []
    number = line = counted = 0  # ``line``: of the place up to which line ends are counted
    parts: list[str] = []
    lines: list[int] = []
    linked = buttons = bold = links = 0
    in_link = in_button = in_bold = 0
    text_group, stray_group, shut_group, name_group = (_TOKEN.groupindex[g] for g in ("text", "stray", "shut", "name"))

    def flush() -> None:
        raw = "".join(parts)
        if text := " ".join((html.unescape(raw) if "&" in raw else raw).split()):
            place = stack[-1] if stack else _ROOT
            out.append(Block(text, lines, place.own, place.path, linked, buttons, bold, links, place.chain))

    for m in _TOKEN.finditer(payload):
        kind = m.lastindex
        if kind == text_group or kind == stray_group:
            token = m[0]
            if token.isspace():
                if parts:
                    parts.append(" ")
                continue
            start = m.start()
            line += payload.count("\n", counted, start)
            counted = start
            if "\n" in token:
                weight = 0
                for k, piece in enumerate(token.split("\n")):
                    line += k > 0
                    if shown := piece.strip():
                        if not lines or lines[-1] != line:
                            lines.append(line)
                        weight += len(shown)
                counted = m.end()
            else:
                if not lines or lines[-1] != line:
                    lines.append(line)
                weight = len(token.strip())
            if in_link:
                linked += weight
            if in_button:
                buttons += weight
            if in_bold:
                bold += weight
            parts.append(token)
            continue
        if kind != name_group:
            continue  # comments, instructions, and elements whose content is not text
        name, closing = m[name_group].lower(), m[shut_group]
        if name in INLINE:
            step = -1 if closing else 1
            if name == "a":
                in_link = max(0, in_link + step)
                links += not closing
            elif name == "button":
                in_button = max(0, in_button + step)
            elif name == "b" or name == "strong":
                in_bold = max(0, in_bold + step)
            if name in ("button", "input", "img"):
                parts.append(" ")
            continue
        if lines:
            flush()
            lines = []
        if parts:
            parts = []
        linked = buttons = bold = links = 0
        if name == "br":
            continue
        if closing:
            at = len(stack) - 1
            while at >= 0 and stack[at].tag != name:
                at -= 1
            if at >= 0:
                del stack[at:]
        elif name in VOID:
            continue
        else:
            if stack and stack[-1].tag == "p":
                stack.pop()
            shut = CLOSES.get(name)
            while shut and stack and stack[-1].tag in shut:
                stack.pop()
            number += 1
            stack.append(_Open(name, stack[-1] if stack else None, number))
        in_link = in_button = in_bold = 0
    if lines:
        flush()
    return out
