"""Duplicates hidden by formatting differences (problem 1).

Text is streamed through a skip-and-fold table (white space and punctuation are skipped, letter case is folded) into
polynomial hashes of its parts; no canonical string is ever built. A part is the stretch before the query, each query
field, or the fragment; fields are combined by a sum, so their order does not matter. Rows of one hash are then
compared with the first of them, two pointers skipping what does not count. Should two different texts ever share the
128-bit hash, the ones that differ from the first are hashed again with another base until every group is proven.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.plans.runtime import bounded, cut

#: Two Mersenne-like primes below 2**31, so that products of residues fit 64 bits.
PRIMES = (2147483647, 2147483629)
SKIP, FIELD, QUERY, FRAGMENT = 0, 1, 2, 3
_PLAIN = 0x3000
_SHARP = ord("ß") + 8


def _fold(code: int) -> int:
    """The folded code point plus 8, or SKIP. Codes 1 to 3 are kept for the separators of a URI's query."""
    c = chr(code)
    if unicodedata.category(c)[0] not in "LNM":
        return SKIP
    folded = c.casefold()
    return (ord(folded) if len(folded) == 1 else code) + 8


def fold_table() -> np.ndarray:
    """The table for the code points below U+3000; others are folded when met."""
    return np.array([_fold(c) for c in range(_PLAIN)], np.int64)


_TABLE: np.ndarray | None = None


def _codes(text: np.ndarray) -> np.ndarray:
    global _TABLE
    if _TABLE is None:
        _TABLE = fold_table()
    if not len(text) or text.max() < _PLAIN:
        return _TABLE[text]
    far = text >= _PLAIN
    out = _TABLE[np.where(far, 0, text)]
    values, where = np.unique(text[far], return_inverse=True)
    out[far] = np.array([_fold(int(v)) for v in values], np.int64)[where]
    return out


def stream(texts: list[str], uri: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The folded code of every character of all texts one after another, SKIP for what does not count, and each
    character's row. With ``uri``, the first ``?``, the first ``#`` and, between the two, ``&`` and ``;`` become the
    part separators QUERY, FRAGMENT and FIELD."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    text = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    rows = np.repeat(np.arange(len(texts)), lengths)
    codes = _codes(text)
    if uri and len(text):
        at = np.arange(len(text))
        first = lambda c: _first(text == c, at, rows, len(texts))
        hash_at = first(ord("#"))
        mark_at = first(ord("?"))
        mark_at = np.where(mark_at < hash_at, mark_at, len(text))
        codes[((text == ord("&")) | (text == ord(";"))) & (at > mark_at[rows]) & (at < hash_at[rows])] = FIELD
        codes[mark_at[mark_at < len(text)]] = QUERY
        codes[hash_at[hash_at < len(text)]] = FRAGMENT
    return codes, rows


def _first(hit: np.ndarray, at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, len(at), np.int64)
    found = at[hit][::-1]
    out[rows[found]] = found
    return out


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod prime by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    have = 1
    while have < n:
        step = np.uint64(pow(base, have, prime))
        more = min(have, n - have)
        out[have : have + more] = out[:more] * step % np.uint64(prime)
        have += more
    return out[:n]


def part_hashes(texts: list[str], uri: bool = True, seed: int = 0) -> np.ndarray:
    """Two 64-bit words per text: equal texts up to formatting have equal words.

    Each character that counts adds its code times the power of its place among those that count; skipped characters
    add nothing and take no place, so nothing is ever copied together. The part before the query counts in order, the
    fields as a multiset, empty fields not at all; a fragment behind a query is a part of its own, and one without a
    query is read on as part of the path.
    """
    codes, rows = stream(texts, uri)
    words = np.zeros((len(texts), 2), np.uint64)
    if not len(codes):
        return words
    symbol, separator = codes >= 8, (codes > SKIP) & (codes < 8)
    begins = np.r_[True, rows[1:] != rows[:-1]]
    # an empty query's marks are dropped, so that a bare "?" or a fragment right behind the path changes nothing
    kind = np.where(separator, codes, 0)
    has_field = np.zeros(len(texts), bool)
    last_mark = np.maximum.accumulate(np.where(separator | begins, np.arange(len(codes)), 0))
    has_field[rows[symbol & np.isin(kind[last_mark], (QUERY, FIELD))]] = True
    starts = np.flatnonzero((separator & has_field[rows]) | begins)
    kinds, part_row = np.where(has_field[rows[starts]], kind[starts], 0), rows[starts]
    kinds[kinds == QUERY] = FIELD  # the first field is a field like any other
    sharp = codes == _SHARP  # the only common letter that folds to two: it takes two places
    width = symbol.astype(np.int64) + sharp
    behind = np.cumsum(width)
    place = behind - width - np.repeat((behind - width)[starts], np.diff(np.r_[starts, len(codes)]))
    sizes = np.add.reduceat(width, starts)
    filled = sizes > 0
    values = np.where(sharp, ord("s") + 8, codes).astype(np.uint64)
    for k, prime in enumerate(PRIMES):
        p = np.uint64(prime)
        power = _powers(pow(1000003 + 2 * k, seed + 1, prime), prime, int(place.max()) + 3)
        weight = np.where(symbol, power[place] + np.where(sharp, power[place + 1], np.uint64(0)), np.uint64(0)) % p
        value = np.add.reduceat(values % p * weight % p, starts) % p
        state = (value << np.uint64(32)) ^ (sizes.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        state = _mix(state + kinds.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        np.add.at(words[:, k], part_row[filled], state[filled])
    return words


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _skip(text: str, at: int, end: int) -> int:
    while at < end and unicodedata.category(text[at])[0] not in "LNM":
        at += 1
    return at


def same_stretch(a: str, i: int, i_end: int, b: str, j: int, j_end: int) -> bool:
    """Two pointers over ``a[i:i_end]`` and ``b[j:j_end]``, each skipping what does not count."""
    held_a = held_b = ""
    while True:
        if not held_a:
            i = _skip(a, i, i_end)
            if i < i_end:
                held_a, i = a[i].casefold(), i + 1
        if not held_b:
            j = _skip(b, j, j_end)
            if j < j_end:
                held_b, j = b[j].casefold(), j + 1
        if not held_a or not held_b:
            return not held_a and not held_b
        if held_a[0] != held_b[0]:
            return False
        held_a, held_b = held_a[1:], held_b[1:]


def _parts(text: str, uri: bool) -> tuple[tuple[int, int], list[tuple[int, int]], tuple[int, int]]:
    """Bounds of the path, of the non-empty fields and of the fragment."""
    if not uri:
        return (0, len(text)), [], (0, 0)
    end = text.find("#")
    end = len(text) if end < 0 else end
    mark = text.find("?", 0, end)
    if mark < 0:
        return (0, len(text)), [], (0, 0)
    fields, a = [], mark + 1
    for b in [*(k for k in range(mark + 1, end) if text[k] in "&;"), end]:
        if _skip(text, a, b) < b:
            fields.append((a, b))
        a = b + 1
    if not fields:
        return (0, len(text)), [], (0, 0)
    return (0, mark), fields, (end, len(text))


def same_text(a: str, b: str, uri: bool = True) -> bool:
    """Whether two texts differ in formatting only. Fields are paired off one by one, each with an equal one."""
    (p, q), fields_a, (f, g) = _parts(a, uri)
    (r, s), fields_b, (t, u) = _parts(b, uri)
    if len(fields_a) != len(fields_b) or not same_stretch(a, p, q, b, r, s) or not same_stretch(a, f, g, b, t, u):
        return False
    if len(fields_a) > 64:  # long queries: pair within equal field hashes only
        count = lambda text, fields: Counter(map(tuple, part_hashes([text[x:y] for x, y in fields], uri=False).tolist()))
        if count(a, fields_a) != count(b, fields_b):
            return False
        order = lambda text, fields: [fields[k] for k in np.lexsort(part_hashes([text[x:y] for x, y in fields], uri=False).T)]
        pairs = zip(order(a, fields_a), order(b, fields_b), strict=True)
        return all(same_stretch(a, *x, b, *y) for x, y in pairs)
    left = list(fields_b)
    for x in fields_a:
        for k, y in enumerate(left):
            if same_stretch(a, *x, b, *y):
                del left[k]
                break
        else:
            return False
    return True


def hashed(df: DataFrame, uri: bool, seed: int) -> DataFrame:
    """``id``, ``t`` (64-bit hash of the text as written) and the two hash words ``h0``, ``h1``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = part_hashes(batch.column(1).to_pylist(), uri, seed).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(words[:, 0].copy()), pa.array(words[:, 1].copy())], names=["id", "t", "h0", "h1"])

    kind = df.schema["id"].dataType.simpleString()
    return df.select("id", "text", F.xxhash64("text").alias("t")).mapInArrow(run, f"id {kind}, t bigint, h0 bigint, h1 bigint")


def _verified(pairs: DataFrame, uri: bool) -> DataFrame:
    """``first_id``, ``id``, ``text`` (only where it differs) and ``same``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3).to_pylist()
            same = [a == b or same_text(a, b, uri) for a, b in zip(batch.column(2).to_pylist(), texts, strict=True)]
            kept = pa.array([None if ok else t for ok, t in zip(same, texts, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), kept, pa.array(same)], names=["first_id", "id", "text", "same"])

    kind = pairs.schema["id"].dataType.simpleString()
    return pairs.select("first_id", "id", "first_text", "text").mapInArrow(run, f"first_id {kind}, id {kind}, text string, same boolean")


def formatting_copies(df: DataFrame, id_col: str, text_col: str, uri: bool = True) -> DataFrame:
    """``first_id``, ``copy_id``: each row that repeats a row of smaller id up to formatting, with the smallest id of
    its group.

    White space, letter case and punctuation do not count, nor does the order of a URI's query fields (``uri``).
    Null texts and null ids are in no group. Texts without any letter or digit (empty, blank, punctuation only) are
    one group. Rows that repeat an id count as one row if their texts are the same; a very long text is one stream
    like any other. Only the two named columns are read.

    Every text is read and hashed once a round; what is shuffled is an id with three hashes. A group's state is its
    smallest row, combined map-side, so a group that holds a third of all rows is one row per task. Only texts of rows
    that have a partner are fetched to be compared, and texts of one hash to the letter are not compared again.
    Unproven rows (a hash collision) go round again with other bases until none is left.
    """
    found, rest, seed = [], df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null"), 0
    while True:
        keys = cut(hashed(rest, uri, seed))
        groups = keys.groupBy("h0", "h1").agg(F.min(F.struct("id", "t")).alias("first"), F.max("id").alias("last")).where("first.id < last")
        pairs = cut(keys.join(bounded(cut(groups)), ["h0", "h1"]).where("id > first.id").select(F.col("first.id").alias("first_id"), F.col("first.t").alias("first_t"), "id", "t").distinct())
        texts = rest.select("id", "text", F.xxhash64("text").alias("t"))
        wanted = lambda i, t, name: texts.join(bounded(pairs.select(F.col(i).alias("id"), F.col(t).alias("t")).distinct()), ["id", "t"], "left_semi").dropDuplicates(["id", "t"]).select(F.col("id").alias(i), F.col("t").alias(t), F.col("text").alias(name))  # noqa: E731, B023
        both = pairs.join(wanted("id", "t", "text"), ["id", "t"]).join(wanted("first_id", "first_t", "first_text"), ["first_id", "first_t"])
        checked = cut(_verified(both, uri))
        found.append(checked.where("same").select("first_id", F.col("id").alias("copy_id")))
        rest = checked.where("not same").select("id", "text")
        if not rest.head(1):
            break
        seed += 1
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def collapsed(df: DataFrame, id_col: str, text_col: str, uri: bool = True) -> DataFrame:
    """One row per group: ``first_id`` and ``copies``, the number of ids that wrote it (1 for a text of its own)."""
    copies = formatting_copies(df, id_col, text_col, uri)
    kept = df.select(F.col(id_col).alias("id")).where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).distinct()
    groups = copies.groupBy("first_id").agg(F.count("*").alias("n"))
    return (
        kept.join(copies.select(F.col("copy_id").alias("id")), "id", "left_anti")
        .join(groups, F.col("id") == F.col("first_id"), "left")
        .select(F.col("id").alias("first_id"), (F.coalesce("n", F.lit(0)) + 1).alias("copies"))
    )
