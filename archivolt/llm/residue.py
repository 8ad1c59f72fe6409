"""Template residue and error-page text (problem 7), and the page analysis it shares with problem 3.

Pages of one site are aligned by position, the path of tags that leads to a block. What stands at one position of most
of a site's addresses is the template itself; what is left of a page's main blocks (problem 3's field) are the values
of its slots. A value is residue

* by form: it keeps variable names, blanks or dummy text;
* by repetition: it recurs as a *default*, on several different main texts of which nearly all hold nothing else of
  their own, whereas a sentence that articles share by chance has rare text beside it. So error messages, demands for
  scripts and shipped samples are found whatever their wording or language; no list of phrases is used.

A page is unfit if its slots hold residue and fewer than :data:`OWN_WORDS` other words, or if its whole main text,
numbers masked, stands at several addresses of its site: then it is a whole-page template that no address fills.
Captures of one address are one page, equal main texts of a site are one text, and numbers never tell texts apart.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.llm import boilerplate, crf
from archivolt.llm.pages import Block
from archivolt.plans.runtime import bounded, cut, spread

#: Different main texts (for a value), or addresses of a site (for a whole main text or a constant), from which on
#: something is repeated.
SHARED = 3
#: Part of the main texts with a repeated value that must have nothing of their own for the value to be a default.
BARE_PART = 0.8
#: Part of a site's addresses that must have a value at a position for it to be the template's own text.
CONSTANT_PART = 0.5
#: Words outside residue, headings and constants from which on a page has content of its own.
OWN_WORDS = 5
#: Words of label that each variable or blank may have beside it and still be what its slot is about, and how many a
#: stretch may have at any rate ("Read more about {{ title }}").
LABEL_WORDS, LABEL_LEAST = 3, 4

#: The ways in which templates mark their variables, print missing ones, and leave blanks.
VARIABLE = re.compile(
    r"<!--.*?-->|\{\{\{?[^{}]*\}?\}\}|\{%.*?%\}|<[%?].*?[%?]>|\[%.*?%\]|\$\{[^}]*\}|#\{[^}]*\}|%%\w+%%|%[A-Z][A-Z_]*%|\[\[[^\]]*\]\]|##\w+##|\$\$\w+\$\$"
    r"|@[A-Z]\w*\.\w+|__[A-Z]\w*__|\b[A-Z]+_PLACEHOLDER\b|\{\d+\} (?:of|de|von|sur) \{\d+\}|\{\w*\}|\[[A-Z][A-Z_ ]+\]|\[insert [^\]]*\]|«(?:name|titre|titel|nombre|texte?)\b[^»]*»"
    r"|\[object Object\]|\bInvalid Date\b|\bundefined\b|\bNaN\b|^null$|_{3,}|(?:\.{4,}|…{2,})\s*$",
    re.IGNORECASE,
)
_MARKS, _PRINTED = re.compile(r"[{}%<\[#$@_«…]"), ("....", "undefined", "invalid date", "nan", "null")
_CASE_BOUND = re.compile(r"%\w+%|\[(?!insert |object)[\w ]+\]|\w+_placeholder|__[^\W_]\w*__", re.IGNORECASE)
_UPPER_ONLY = re.compile(r"%[A-Z][A-Z_]*%|\[[A-Z][A-Z_ ]+\]|\b[A-Z]+_PLACEHOLDER\b|__[A-Z]\w*__")
#: Stems of the usual dummy Latin, and what is typed to fill a field.
LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum mauris vivamus vestibulum curabitur pellentesque phasellus fusce praesent maecenas aenean donec nullam quisque cras proin integer morbi suspendisse nam augue sodales ligula tempus rutrum porta sagittis massa pharetra congue viverra quam lectus fringilla tetur sagit vestib fringil felis erat ornare blandit consec sem nibh eget nec vel ante arcu diam dui eros facilisis faucibus hendrerit iaculis imperdiet justo lacinia lacus leo libero lobortis luctus mattis nisl nunc odio orci placerat posuere pretium purus rhoncus risus semper sollicitudin tellus tincidunt tortor tristique turpis ullamcorper ultrices ultricies urna varius vehicula volutpat vulputate".split()
)
_DUMMY = frozenset("bla blah foo bar baz qux qwer qwerty asdf test xxx xxxx xxxxx yyy zzz abc lala dummy".split())
#: Part of a stretch's words that must be dummy Latin; of fewer than four words all must be, and one of them longer
#: than the short ones that Latin shares with living languages.
LATIN_PART = 0.6
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_DIGIT = re.compile(r"\d")
_NUMBERED = re.compile(r"\b[^\W\d]*+\d\w*")
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def masked(text: str) -> str:
    """``text`` with every word that holds a digit made one and the same."""
    return _NUMBERED.sub("0", text) if _DIGIT.search(text) else text


def residue_kind(text: str) -> str | None:
    """``placeholder`` (variables and blanks), ``filler`` (dummy text, one thing over and over) or None: what a stretch
    shows by its form alone."""
    return _form(text, _WORD.findall(text))


def _form(text: str, words: list[str]) -> str | None:
    text = (html.unescape(text) if "&" in text else text).strip().lstrip("-*• ").strip()
    small = text.lower()
    if _MARKS.search(text) or any(x in small for x in _PRINTED):
        holes = [m[0] for m in VARIABLE.finditer(text) if not _CASE_BOUND.fullmatch(m[0]) or _UPPER_ONLY.fullmatch(m[0])]
        if holes and (len(_WORD.findall(VARIABLE.sub(" ", text))) <= max(LABEL_LEAST, len(holes) * LABEL_WORDS) or sum(map(len, holes)) * 2 >= len(text)):
            return "placeholder"
    if not words:
        numbers = re.findall(r"\d+", text)
        return "filler" if len(numbers) > 2 and len(set(numbers)) == 1 and text[0].isdigit() else None
    lower = " ".join(words).lower().split(" ")
    latin = sum(map(LATIN.__contains__, lower)) if not LATIN.isdisjoint(lower) else 0
    if latin and (latin >= LATIN_PART * len(lower) if len(lower) >= 4 else latin == len(lower) and any(len(w) > 4 for w in lower)):
        return "filler"
    if len(lower) >= 3 and (lower[0] == lower[1] and len(set(lower)) == 1 or lower[0] in _DUMMY and _DUMMY.issuperset(lower)):
        return "filler"
    if text.find(text[:3], 3) < 0:
        return None  # nothing comes again
    sentences = _SENTENCE.split(text)
    return "filler" if len(sentences) > 1 and len(set(sentences)) == 1 else None


class Value(NamedTuple):
    """A slot's value: its block, its masked text, the words in it, whether it is a heading, and residue by form."""

    block: Block
    text: str
    words: int
    heading: bool
    residue: bool


#: Values remembered by text: their masked text, words, and whether they are residue by form.
_FORMS = boilerplate.Memory()


def _value(b: Block, heading: bool) -> Value:
    told = _FORMS.get(b.text)
    if told is None:
        text = masked(b.text)
        words = _WORD.findall(text)
        told = text, len(words), _form(b.text, words) is not None
        if len(text) <= boilerplate.REMEMBERED_CHARS:
            _FORMS.keep(b.text, told)
    return Value(b, told[0], told[1], heading, told[2])


def _is_heading(b: Block, first: bool, title: str) -> bool:
    """Headings promise text but are none: heading tags, what the title begins with, the first line of plain text."""
    return b.tag in _HEADINGS or first and b.tag == "line" or title.startswith(b.text) and not re.match(r"\s*[\w,;]", title[len(b.text) :])


def slot_values(own: list[Block], rest: list[Block], title: str) -> tuple[str, list[Value]]:
    """A page's verdict so far and the values of its slots.

    ``hidden``: nothing is shown but what stands in ``noscript``, a demand for scripts by place. ``empty``: no main
    block; the values are those of all its blocks outside ``noscript``. ``open``: to be judged by its values. Code
    quotes anything and is left out.
    """
    if own:
        return "open", [_value(b, _is_heading(b, i == 0, title)) for i, b in enumerate(own) if b.tag not in ("pre", "code")]
    shown = [b for b in rest if b.tag != "noscript" and "noscript" not in b.path]
    return ("hidden" if rest and not shown else "empty"), [_value(b, False) for b in shown]


def address(url: str | None) -> str | None:
    """What tells a page from others whatever way it is reached: the last part of its path, or else its host, without
    file ending and query, so that mirrors, print views and tracking fields make no other page."""
    parts = [x for x in re.split(r"[?#]", re.sub(r"^[a-z][a-z0-9+.-]*:/*", "", (url or "").strip().lower()), maxsplit=1)[0].split("/") if x]
    return (re.sub(r"\.[a-z0-9]{1,5}$", "", parts[-1]) if len(parts) > 1 else parts[0]) if parts else None


def site(url: str | None) -> str | None:
    """The host of a URL, without user, port and ``www``."""
    host = re.split(r"[/?#]", re.sub(r"^[a-z][a-z0-9+.-]*:/*", "", (url or "").strip().lower()), maxsplit=1)[0].rpartition("@")[2].partition(":")[0]
    return host.removeprefix("www.") or None


SLOTS = "array<struct<value: bigint, constant: bigint, words: int, heading: boolean, residue: boolean>>"
PAGE = "page bigint, site bigint, main bigint, text_words int, all_words int, residue boolean"


def analyse(df: DataFrame, id_col: str, payload_col: str, model: crf.Model, url_col: str | None = None) -> DataFrame:
    """One narrow pass: ``id``, ``lines`` (of the page's own text), ``verdict`` and ``slots`` (see :func:`slot_values`;
    each ``value`` as a 64-bit hash, and as ``constant`` one of site, position and value), the hashes of the ``page``
    (its address, or the whole payload), its ``site`` (0 if unknown) and its ``main`` text (masked; null without any
    main block), the words outside headings and residue (null if there are only headings) and outside residue, and
    whether there is ``residue`` by form.
    Null, blank, style, script and data payloads have no lines and no slots."""
    import xxhash

    weights = model  # a reader of its own for each task

    def hashed(text: str) -> int:
        return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)

    slot = pa.struct([("value", pa.int64()), ("constant", pa.int64()), ("words", pa.int32()), ("heading", pa.bool_()), ("residue", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = boilerplate.Reader(weights)
        position = lru_cache(maxsize=boilerplate.REMEMBERED)(lambda host, path: hashed(f"{host}\n{'/'.join(path)}"))
        for batch in batches:
            lines, verdicts, ends, flat, pages = [], [], [0], [], []
            for payload, url in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own, rest, title = boilerplate.read_page(payload, reader)
                verdict, values = slot_values(own, rest, title)
                host = site(url)
                slots = {(v.text, v.block.path): v for v in values}
                for v in slots.values():
                    value = hashed(v.text)
                    flat.append((value, value ^ position(host, v.block.path) if host else 0, v.words, v.heading, v.residue))
                ends.append(len(flat))
                lines.append(sorted({n for b in own for n in b.lines}))
                verdicts.append(verdict)
                place = address(url)
                pages.append((
                    hashed(payload if place is None else place), hashed(host) if host else 0, hashed("\n".join([v.text for v in values])) if own and values else None,
                    sum([v.words for v in slots.values() if not v.heading and not v.residue]) if any([not v.heading for v in values]) else None,
                    sum([v.words for v in slots.values() if not v.residue]), any([v.residue for v in values]),
                ))
            struct = pa.StructArray.from_arrays([pa.array([r[k] for r in flat], f.type) for k, f in enumerate(slot)], fields=list(slot))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lines, pa.list_(pa.int32())), pa.array(verdicts, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct), *(pa.array([p[k] for p in pages], t) for k, t in enumerate(types))],
                names=["id", "lines", "verdict", "slots", "page", "site", "main", "text_words", "all_words", "residue"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    url = F.col(url_col) if url_col else F.lit(None)
    given = df.select(F.col(id_col).alias("id"), F.col(payload_col).alias("payload"), url.cast("string").alias("url")).where(F.col("payload").isNotNull())
    return spread(given).mapInArrow(run, f"id {kind}, lines array<int>, verdict string, slots {SLOTS}, {PAGE}")


def recurring(analysed: DataFrame, shared: int = SHARED) -> DataFrame:
    """The slot values that can be part of a template, as ``value`` and ``alone``: those on two different main texts or
    more, and those that are a whole main text ``alone``, without a heading, on ``shared`` sites or more. All others,
    by far the most, are content and go no further."""
    rows = analysed.where("main is not null").select("main", "site", F.size("slots").alias("n"), F.explode("slots").alias("s")).select("main", "site", "n", "s.value", "s.heading")
    met = rows.groupBy("value").agg(F.min("main").alias("one"), F.max("main").alias("other"), F.min(F.when(F.col("n") == 1, F.col("site"))).alias("a"), F.max(F.when(F.col("n") == 1, F.col("site"))).alias("z"))
    several = met.where("one <> other or a <> z").select("value")
    sites = rows.where("n = 1 and not heading and site <> 0").select("value", "site").distinct().groupBy("value").agg(F.count("*").alias("sites")).where(F.col("sites") >= shared)
    return several.join(sites.select("value", F.lit(True).alias("alone")), "value", "left").fillna(False, ["alone"])


def align(analysed: DataFrame, shared: int = SHARED, part: float = CONSTANT_PART) -> DataFrame:
    """The recurring values of all main texts, one row for each (``unit``, ``value``, ``constant``), a unit being a main
    text on a site: ``words``, ``heading`` and ``residue``, whether the value is ``alone``, whether it is ``repeated``,
    on ``shared`` different main texts or more, and whether it is ``fixed``, the template's own text: on ``shared``
    addresses of its site or more and on the part ``part`` of them, at one position. Captures, and equal texts of a
    site, fall together map-side."""
    pages = analysed.where("main is not null")
    values = bounded(cut(recurring(analysed, shared)))
    rows = pages.select("main", "site", "page", F.explode("slots").alias("s")).select("main", "site", "page", "s.*").join(values, "value")
    rows = cut(rows.groupBy("main", "site", "page", "value", "constant").agg(F.max("words").alias("words"), F.max("heading").alias("heading"), F.max("residue").alias("residue"), F.max("alone").alias("alone")))
    units = rows.groupBy(F.xxhash64("main", "site").alias("unit"), "value", "constant").agg(F.max("words").alias("words"), F.max("heading").alias("heading"), F.max("residue").alias("residue"), F.max("alone").alias("alone"))
    repeated = rows.select("value", "main").distinct().groupBy("value").agg(F.count("*").alias("mains")).where(F.col("mains") >= shared).select("value", F.lit(True).alias("repeated"))
    held = rows.where("site <> 0").select("constant", "site", "page").distinct().groupBy("constant", "site").agg(F.count("*").alias("pages")).where(F.col("pages") >= shared)
    addresses = pages.select("site", "page").distinct().groupBy("site").agg(F.count("*").alias("addresses"))
    fixed = held.join(addresses, "site").where(F.col("pages") >= part * F.col("addresses")).select("constant", F.lit(True).alias("fixed"))
    return units.join(repeated, "value", "left").join(fixed, "constant", "left").fillna(False, ["repeated", "fixed"])


def texts(analysed: DataFrame) -> DataFrame:
    """One row a unit: ``unit`` with its word counts and ``residue``."""
    pages = analysed.where("main is not null").groupBy(F.xxhash64("main", "site").alias("unit"))
    return pages.agg(F.max("text_words").alias("text_words"), F.max("all_words").alias("all_words"), F.max("residue").alias("residue"))


def _content(units: DataFrame, aligned: DataFrame, covered: F.Column) -> DataFrame:
    """Each unit with ``own``, its words outside what is ``covered`` (and outside headings, if it has anything else),
    and ``hit``, whether it has residue or anything covered that is not merely fixed."""
    words = F.when(covered | F.col("fixed"), F.col("words")).otherwise(0)
    taken = aligned.where("not residue").groupBy("unit").agg(F.sum(F.when(~F.col("heading"), words).otherwise(0)).alias("text"), F.sum(words).alias("all"), F.max(covered).alias("hit"))
    own = F.coalesce(F.col("text_words") - F.coalesce("text", F.lit(0)), F.col("all_words") - F.coalesce("all", F.lit(0)))
    return units.join(taken, "unit", "left").select("unit", own.alias("own"), (F.col("residue") | F.coalesce("hit", F.lit(False))).alias("hit"))


def defaults(units: DataFrame, aligned: DataFrame, shared: int = SHARED, own_words: int = OWN_WORDS, part: float = BARE_PART) -> DataFrame:
    """``value`` of what recurs where nothing of its own stands: of the units with it, ``shared`` or more, at least
    ``part`` have fewer than ``own_words`` words in values that are not repeated; and of what is a text alone."""
    bare = _content(units, aligned, F.col("repeated") | F.col("alone")).select("unit", (F.col("own") < own_words).alias("bare"))
    met = aligned.where("repeated or alone").select("value", "alone", "unit").distinct().join(bare, "unit")
    counted = met.groupBy("value").agg(F.max("alone").alias("alone"), F.count("*").alias("texts"), F.count_if("bare").alias("bare"))
    return counted.where(F.col("alone") | (F.col("texts") >= shared) & (F.col("bare") >= part * F.col("texts"))).select("value", F.lit(True).alias("default"))


def whole_page_templates(analysed: DataFrame, shared: int = SHARED) -> DataFrame:
    """``unit`` of main texts that stand whole at ``shared`` addresses of one site or more."""
    known = analysed.where("main is not null and site <> 0").select(F.xxhash64("main", "site").alias("unit"), "page").distinct()
    return known.groupBy("unit").agg(F.count("*").alias("pages")).where(F.col("pages") >= shared).select("unit")


def unfit_pages(analysed: DataFrame, shared: int = SHARED, own_words: int = OWN_WORDS, part: float = BARE_PART) -> DataFrame:
    """``id`` of the pages without content of their own. ``analysed`` must be materialised.

    All counts cover all pages; they combine map-side, only recurring values go on, and of them one row per unit, so a
    text or value on a third of all pages is no larger than its different neighbours are many.
    """
    units, aligned = texts(analysed), cut(align(analysed, shared))
    default = bounded(cut(defaults(units, aligned, shared, own_words, part)))
    told = aligned.join(default, "value", "left").fillna(False, ["default"])
    judged = _content(units, told, F.col("default")).where((F.col("own") < own_words) & F.col("hit")).select("unit")
    found = judged.unionByName(whole_page_templates(analysed, shared)).distinct()
    with_main = analysed.where("main is not null").select("id", F.xxhash64("main", "site").alias("unit")).join(found, "unit", "left_semi").select("id")
    empty = analysed.where("verdict = 'empty'").select("id", F.explode("slots").alias("s")).select("id", "s.value", "s.residue").join(default, "value", "left")
    return with_main.unionByName(analysed.where("verdict = 'hidden'").select("id")).unionByName(empty.where("residue or default").select("id")).distinct()


def unfit(df: DataFrame, id_col: str, payload_col: str, model: crf.Model, url_col: str | None = None) -> DataFrame:
    """``id`` of the unfit pages of ``df``; null ids are left out."""
    return unfit_pages(cut(analyse(df, id_col, payload_col, model, url_col))).where(F.col("id").isNotNull())


def main_lines(df: DataFrame, id_col: str, payload_col: str, model: crf.Model, url_col: str | None = None) -> DataFrame:
    """``id``, ``line_no`` (from 0, lines split at ``\\n``): the lines that hold text of the page's own.

    Null, empty and blank payloads, stylesheets, scripts, data (JSON, XML) and unfit pages have none. A page without
    any markup is read line by line. A very long page is one sequence like any other; repeated rows give each line
    once; a null id is carried through.
    """
    analysed = cut(analyse(df, id_col, payload_col, model, url_col))
    kept = analysed.join(unfit_pages(analysed), "id", "left_anti")
    return kept.select("id", F.explode("lines").alias("line_no")).distinct()
