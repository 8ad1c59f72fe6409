"""Several values packed in one field (problem 5): dictionary-guided segmentation.

The dictionary is the column's own: whole values with delimiters that recur in quotes. An Aho-Corasick automaton finds
every known whole value in the field; unprotected delimiters give the possible cuts; dynamic programming over the cuts
picks the cheapest cover, in which a known value may span delimiters of its own and a quoted stretch is never cut. The
split is one narrow ``mapInArrow`` pass, one row in, its values out.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

DELIMITERS = ";,|\t\r\n"

#: A value with delimiters belongs to the dictionary if it is met, quoted, in this part of the rows and in two at
#: least. The share bounds the dictionary: there are at most (values a row) / share of them, whatever the table's size.
DICTIONARY_SHARE, DICTIONARY_ROWS = 1e-4, 2

_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def build_automaton(known: Iterable[str]):
    """The automaton over the ASCII-lower-cased known values; None if there are none."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for value in known:
        if value := value.strip():
            automaton.add_word(value.translate(_ASCII_LOWER), len(value))
    if not len(automaton):
        return None
    automaton.make_automaton()
    return automaton


def protected(text: str) -> list[tuple[int, int]]:
    """The closed quoted stretches ``[open, close]``; a quote that is never closed is an ordinary character."""
    spans, at = [], text.find('"')
    while at >= 0:
        end = at + 1
        while end < len(text) and text[end] != '"':
            end += 2 if text[end] == "\\" else 1
        if end >= len(text):
            at = text.find('"', at + 1)
            continue
        spans.append((at, end))
        at = text.find('"', end + 1)
    return spans


def unquote(text: str, spans: list[tuple[int, int]], start: int, end: int) -> str:
    """``text[start:end]`` without the quotes of its quoted stretches, with the escapes inside them undone."""
    out, at = [], start
    for a, b in spans:
        if a < start or b >= end:
            continue
        out.append(text[at:a])
        inner, i = text[a + 1 : b], 0
        while i < len(inner):
            i += inner[i] == "\\" and i + 1 < len(inner)
            out.append(inner[i])
            i += 1
        at = b + 1
    return "".join(out) + text[at:end]


def segment(text: str, automaton=None, delimiters: str = DELIMITERS) -> list[str]:
    """The values of one field, in order. A cover pays 1 for a known value and 2 for any other piece."""
    spans = protected(text) if '"' in text else []
    cuts, k = [-1], 0
    for i, c in enumerate(text):
        while k < len(spans) and spans[k][1] < i:
            k += 1
        if c in delimiters and not (k < len(spans) and spans[k][0] <= i):
            cuts.append(i)
    cuts.append(len(text))
    pieces = []
    for j in range(len(cuts) - 1):
        a, b = cuts[j] + 1, cuts[j + 1]
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        pieces.append((a, b))
    starts = {a: j for j, (a, b) in enumerate(pieces) if a < b}
    ends = {b: j for j, (a, b) in enumerate(pieces) if a < b}
    known: dict[int, set[int]] = {}
    if automaton is not None:
        for last, size in automaton.iter(text.translate(_ASCII_LOWER)):
            a, b = last + 1 - size, last + 1
            if a - 1 >= 0 and text[a - 1] == '"' and b < len(text) and text[b] == '"':
                a, b = a - 1, b + 1
            if a in starts and b in ends and ends[b] >= starts[a]:
                known.setdefault(starts[a], set()).add(ends[b])
    n = len(pieces)
    best: list[tuple[int, int]] = [(0, n)] * (n + 1)
    for j in range(n - 1, -1, -1):
        a, b = pieces[j]
        options = [(best[j + 1][0] + (2 if a < b else 0), j + 1)]
        options += [(best[e + 1][0] + 1, e + 1) for e in known.get(j, ())]
        best[j] = min(options, key=lambda o: (o[0], -o[1]))
    out, j = [], 0
    while j < n:
        after = best[j][1]
        a, b = pieces[j][0], pieces[after - 1][1]
        if a < b:
            out.append(unquote(text, spans, a, b))
        j = after
    return out


def learn_dictionary(df: DataFrame, packed_col: str, share: float = DICTIONARY_SHARE, rows: int = DICTIONARY_ROWS, delimiters: str = DELIMITERS) -> list[str]:
    """The column's own whole values that hold delimiters: where one is quoted, its delimiters are known to be its own,
    and if it recurs (see :data:`DICTIONARY_SHARE`) it is one value where the quotes are missing, too.

    Every row counts. Only rows with a delimiter between quotes are looked at in Python; values are counted map-side.
    Letter case (ASCII) does not tell values apart. Null, empty and blank fields teach nothing.
    """
    marks = delimiters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = []
            for text in batch.column(0).to_pylist():
                values += {v.translate(_ASCII_LOWER) for v in segment(text, None, marks) if any(c in marks for c in v)}
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.string())], names=["v"])

    inside = "[" + "".join(re.escape(c) for c in delimiters) + "]"
    quoted = df.select(F.col(packed_col).alias("t")).where(F.col("t").rlike(f'"[^"]*{inside}'))
    counted = quoted.mapInArrow(run, "v string").groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") >= rows)
    total = df.agg(F.count(packed_col)).first()[0]
    return [r["v"] for r in counted.where(F.col("n") >= share * total).select("v").orderBy("v").collect()]


def split_packed(df: DataFrame, id_col: str, packed_col: str, known: Iterable[str] | None = None, delimiters: str = DELIMITERS) -> DataFrame:
    """One row per value: the id column, ``pos`` from 1, ``val``. ``known`` is by default learnt from the column.

    Null, empty and blank fields, and fields of delimiters only, have no values. Empty pieces take no place. Quoted
    delimiters do not split; quotes are dropped and their escapes undone; a quote without a partner is kept as it is.
    Known values match in any ASCII letter case and may contain delimiters. Repeated rows give repeated values; a null
    id is carried through. Only the two named columns are read, so other columns may have any name.
    """
    words, marks = tuple(learn_dictionary(df, packed_col, delimiters=delimiters) if known is None else known), delimiters
    id_type = df.schema[id_col].dataType
    out = StructType([StructField(id_col, id_type), StructField("pos", IntegerType()), StructField("val", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = build_automaton(words)
        for batch in batches:
            rows, positions, values = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for p, value in enumerate(segment(text, automaton, marks), 1):
                    rows.append(i)
                    positions.append(p)
                    values.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(positions, pa.int32()), pa.array(values, pa.string())],
                names=[id_col, "pos", "val"],
            )

    return df.select(id_col, packed_col).where(F.col(packed_col).isNotNull()).mapInArrow(run, out)
