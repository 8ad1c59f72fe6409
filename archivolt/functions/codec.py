"""Payload bytes: de-chunking, content encodings, ranges of chunked bodies."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

#: Bytes a chunk's size line may take at most.
SIZE_LINE = 64


def dechunk(body: bytes, sizes: list[int] | None = None) -> bytes:
    """The data of a chunked body; a truncated body ends cleanly. Stored sizes only confirm what the size lines say:
    where they differ, the lines count."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at, at + SIZE_LINE)
        if end < 0:
            break
        try:
            n = int(body[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            break
        if n <= 0:
            break
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n
        if len(out[-1]) < n:
            break
    return b"".join(out)


def dechunk_stream(windows: Iterable[bytes]) -> Iterator[bytes]:
    """:func:`dechunk` over a body that arrives in windows of any size."""
    held, left, state = b"", 0, "size"
    for window in windows:
        held += window
        while held:
            if state == "size":
                end = held.find(b"\r\n")
                if end < 0:
                    if len(held) > SIZE_LINE:
                        return
                    break
                try:
                    left = int(held[:end].split(b";")[0].strip(), 16)
                except ValueError:
                    return
                if left <= 0:
                    return
                held, state = held[end + 2 :], "data"
            elif state == "data":
                piece, held = held[:left], held[left:]
                left -= len(piece)
                if piece:
                    yield piece
                if not left:
                    state = "gap"
            else:
                if len(held) < 2:
                    break
                held, state = held[2:], "size"


def decode_content(body: bytes, encoding: str | None) -> bytes:
    """gzip, x-gzip and deflate undone; any other or a lying encoding gives the bytes as they are."""
    name = (encoding or "").strip().lower()
    windows = {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(name, ())
    for bits in windows:
        try:
            return zlib.decompressobj(bits).decompress(body)
        except zlib.error:
            continue
    return body


def _binary(function):
    return F.pandas_udf(function, BinaryType())


@_binary
def dechunked(body: pd.Series) -> pd.Series:
    return body.map(lambda b: None if b is None else dechunk(b))


@_binary
def decoded(body: pd.Series, encoding: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else decode_content(b, e) for b, e in zip(body, encoding, strict=True)])
