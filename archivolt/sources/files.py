"""Byte access to archive files, plain or within a container, and what kind of file each is."""

from __future__ import annotations

import bisect
import glob
import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs

#: The first bytes of each kind of file.
GZIP, ZIP = b"\x1f\x8b", b"PK\x03\x04"
BLOCK = 1 << 18


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    path = local(path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def local(path: str) -> str:
    """A ``file:`` address as a plain path; any other path as it is."""
    return re.sub(r"^file:(?://)?(?=/)", "", path)


def list_files(path: str) -> list[tuple[str, int]]:
    """Path and size of a file, or of every archive file below a folder, by path; symbolic links are not followed."""
    path = local(path)
    if any(c in path for c in "*?["):
        return [(p, os.path.getsize(p)) for p in sorted(glob.glob(path, recursive=True)) if os.path.isfile(p) and not os.path.islink(p)]
    system, inner = resolve(path)
    info = system.get_file_info(inner)
    prefix = path[: -len(inner)] if "://" in path else ""
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    below = system.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True))
    names = (".warc", ".warc.gz", ".wacz")
    return sorted((prefix + i.path, i.size) for i in below if i.type == fs.FileType.File and i.path.lower().endswith(names) and not os.path.islink(i.path))


class Plain:
    """Random access to ``[start, start + size)`` of a file, in cached blocks."""

    def __init__(self, path: str, start: int = 0, size: int | None = None) -> None:
        system, inner = resolve(path)
        self.raw = system.open_input_file(inner)
        self.start = start
        self.size = self.raw.size() - start if size is None else size
        self.block_at, self.block = 0, b""

    def read(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.size - at))
        if n > BLOCK:
            return self._raw(at, n)
        if not (self.block_at <= at and at + n <= self.block_at + len(self.block)):
            self.block_at, self.block = at, self._raw(at, max(n, BLOCK))
        return self.block[at - self.block_at : at - self.block_at + n]

    def window(self, at: int) -> bytes:
        """What is in memory from ``at`` on, else the next block."""
        if not (self.block_at <= at < self.block_at + len(self.block)):
            self.block_at, self.block = at, self._raw(at, min(BLOCK, max(0, self.size - at)))
        return self.block[at - self.block_at :]

    def _raw(self, at: int, n: int) -> bytes:
        self.raw.seek(self.start + min(at, self.size))
        return self.raw.read(max(0, min(n, self.size - at)))

    def close(self) -> None:
        self.raw.close()


class PastWindow(ValueError):
    """A read behind the part of a compressed file that is still in memory."""


class Inflated:
    """Forward access to the logical bytes of a gzip file of one or many members, keeping ``history`` bytes behind.

    ``members`` lists (compressed offset, logical offset) of the members met so far.
    """

    def __init__(self, source: Plain, compressed: int = 0, logical: int = 0, history: int = 1 << 20) -> None:
        self.source, self.at, self.history = source, compressed, history
        self.begin, self.held = logical, bytearray()
        self.members: list[tuple[int, int]] = []
        self.inflater = None
        self.done = False

    def _more(self) -> None:
        while not self.done:
            if self.inflater is None:
                if self.source.read(self.at, 2) != GZIP:
                    self.done = True
                    return
                self.members.append((self.at, self.begin + len(self.held)))
                self.inflater = zlib.decompressobj(31)
            data = self.source.window(self.at)
            if not data:
                self.done = True
                return
            out = self.inflater.decompress(data)
            self.at += len(data) - len(self.inflater.unused_data)
            if self.inflater.eof:
                self.inflater = None
            if out:
                self.held += out
                return

    def read(self, at: int, n: int) -> bytes:
        if at < self.begin:
            raise PastWindow(f"offset {at} is before {self.begin}, the oldest byte in memory")
        while self.begin + len(self.held) < at + n and not self.done:
            self._more()
            spare = at - self.history - self.begin
            if spare > self.history:
                drop = min(spare, len(self.held))
                del self.held[:drop]
                self.begin += drop
        k = at - self.begin
        return bytes(self.held[k : k + n])

    def member_at(self, logical: int) -> tuple[int, int]:
        """(compressed offset, logical offset) of the member that holds a byte already read."""
        return self.members[bisect.bisect_right(self.members, logical, key=lambda m: m[1]) - 1]

    def close(self) -> None:
        self.source.close()


def member_index(source: Plain) -> Iterator[tuple[int, int, int, int]]:
    """(compressed offset, compressed length, logical offset, logical length) of each member, contiguous."""
    at = logical = 0
    while source.read(at, 2) == GZIP:
        inflater, begin, n = zlib.decompressobj(31), at, 0
        while not inflater.eof:
            data = source.window(at)
            if not data:
                raise ValueError(f"the gzip member at {begin} is cut off")
            n += len(inflater.decompress(data))
            at += len(data) - len(inflater.unused_data)
        yield begin, at - begin, logical, n
        logical += n


def member_slice(source: Plain, compressed: int, offset: int, length: int) -> bytes:
    """``length`` logical bytes from ``offset`` within the member at ``compressed``; beyond its end is an error."""
    inflater, out, at = zlib.decompressobj(31), bytearray(), compressed
    while len(out) < offset + length and not inflater.eof:
        data = source.read(at, BLOCK)
        if not data:
            break
        out += inflater.decompress(data)
        at += len(data)
    if len(out) < offset + length:
        raise ValueError(f"the gzip member at {compressed} has {len(out)} bytes, fewer than {offset + length}")
    return bytes(out[offset : offset + length])


@dataclass
class Entry:
    """A stored file within a zip container."""

    name: str
    method: int
    start: int
    size: int


def zip_entries(source: Plain) -> list[Entry]:
    """The container's entries by its central directory (zip64 included)."""
    tail_at = max(0, source.size - 65_557)
    tail = source.read(tail_at, source.size - tail_at)
    k = tail.rfind(b"PK\x05\x06")
    if k < 0:
        raise ValueError("no end of central directory: not a zip file")
    count, size, at = struct.unpack_from("<HII", tail, k + 10)
    if count == 0xFFFF or at == 0xFFFFFFFF or size == 0xFFFFFFFF:
        j = tail.rfind(b"PK\x06\x06", 0, k)
        count, size, at = struct.unpack_from("<QQQ", tail, j + 32)
    directory, out, p = source.read(at, size), [], 0
    for _ in range(count):
        method, = struct.unpack_from("<H", directory, p + 10)
        packed, full = struct.unpack_from("<II", directory, p + 20)
        n, extra, comment = struct.unpack_from("<HHH", directory, p + 28)
        local, = struct.unpack_from("<I", directory, p + 42)
        name = directory[p + 46 : p + 46 + n].decode("utf-8", "replace")
        more, q = directory[p + 46 + n : p + 46 + n + extra], 0
        while q + 4 <= len(more):
            tag, length = struct.unpack_from("<HH", more, q)
            if tag == 1:
                values = list(struct.unpack_from(f"<{length // 8}Q", more, q + 4))
                full = values.pop(0) if full == 0xFFFFFFFF else full
                packed = values.pop(0) if packed == 0xFFFFFFFF else packed
                local = values.pop(0) if local == 0xFFFFFFFF else local
            q += 4 + length
        head = source.read(local, 30)
        start = local + 30 + sum(struct.unpack_from("<HH", head, 26))
        out.append(Entry(name, method, start, packed))
        p += 46 + n + extra + comment
    return out


def archives_in(path: str) -> list[tuple[str, int, int, str]]:
    """The WARC streams of a file: (kind, start, size, entry name), ``kind`` plain or gzip. A deflated archive inside
    a container is refused: its bytes cannot be addressed."""
    source = Plain(path)
    try:
        magic = source.read(0, 4)
        if magic[:2] == GZIP:
            return [("gzip", 0, source.size, "")]
        if magic != ZIP:
            return [("plain", 0, source.size, "")]
        out = []
        for e in zip_entries(source):
            if e.name.lower().endswith((".warc.gz", ".warc")):
                if e.method:
                    raise ValueError(f"{path}: {e.name} is compressed within its container; only stored archives can be read")
                out.append(("gzip" if e.name.lower().endswith(".gz") else "plain", e.start, e.size, e.name))
        return out
    finally:
        source.close()


def cdx_ranges(path: str) -> list[tuple[str, int, int]]:
    """(name, start, size) of the stored CDX indexes of a container."""
    source = Plain(path)
    try:
        return [(e.name, e.start, e.size) for e in zip_entries(source) if e.name.startswith("indexes/") and ".cdx" in e.name and not e.method]
    finally:
        source.close()


def list_any(path: str) -> list[tuple[str, int]]:
    """Path and size of every file below a folder, whatever its name."""
    path = local(path)
    system, inner = resolve(path)
    prefix = path[: -len(inner)] if "://" in path else ""
    below = system.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True))
    return sorted((prefix + i.path, i.size) for i in below if i.type == fs.FileType.File)


def _per_file(spark, path: str, rows, schema: str):
    """One row or more for each archive file below ``path``, read on the executors, a file a task."""
    import pyarrow as pa

    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                found = [(file, *r) for r in rows(file)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=names)

    listed = list_files(path)
    files = spark.createDataFrame([(f,) for f, _ in listed], "file_path string").repartition(max(1, len(listed)))
    return files.mapInArrow(run, schema)


def member_table(spark, path: str):
    """The members of every compressed archive below ``path``: ``file_path``, ``compressed_offset``,
    ``compressed_length``, ``logical_offset``, ``logical_length``; the index by which such files are split."""

    def rows(file: str):
        if not file.lower().endswith(".gz"):
            return
        source = Plain(file)
        try:
            yield from member_index(source)
        finally:
            source.close()

    return _per_file(spark, path, rows, "file_path string, compressed_offset bigint, compressed_length bigint, logical_offset bigint, logical_length bigint")


def cdx_table(spark, path: str):
    """The lines of the stored CDX indexes of every container below ``path``: ``file_path``, ``url``, ``mime``,
    ``status``, ``position``, ``record``. Lines of fewer fields are left out; a status that is no number is null."""

    def rows(file: str):
        for _, start, size in cdx_ranges(file) if file.lower().endswith(".wacz") else ():
            source = Plain(file, start, size)
            try:
                for line in source.read(0, size).decode("utf-8", "replace").splitlines():
                    x = line.split(" ")
                    if len(x) > 10 and x[8].isdigit():
                        yield x[0], x[3], int(x[4]) if x[4].isdigit() else None, int(x[8]), x[10]
            finally:
                source.close()

    return _per_file(spark, path, rows, "file_path string, url string, mime string, status bigint, position bigint, record string")


def folder_stats(spark, path: str):
    """``files`` and ``total_bytes`` of the archive files below a folder, by a listing alone."""
    from pyspark.sql import functions as F

    listed = spark.createDataFrame(list_files(path), "file_path string, size bigint")
    return listed.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"))
