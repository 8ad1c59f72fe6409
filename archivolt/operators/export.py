"""Exports: budgets, entry paths, stored zip archives."""

from __future__ import annotations

import json
import re
import zipfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Sizes of the parts of a zip archive without zip64, and the limits beyond which zip64 sets in.
LOCAL, DESCRIPTOR, CENTRAL, END, END_64 = 30, 16, 46, 22, 76
MAX_32, MAX_16 = 0xFFFFFFFF, 0xFFFF


def within_budget(requests: DataFrame, group: str, order: str, size: str, entries: int, total: int) -> DataFrame:
    """The requests of each group, in order, up to ``entries`` of them and ``total`` bytes. A group is one export,
    whose requests one client names; a null size counts as 0."""
    ahead = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = requests.withColumn("_n", F.count("*").over(ahead)).withColumn("_bytes", F.sum(F.coalesce(size, F.lit(0))).over(ahead))
    return counted.where((F.col("_n") <= entries) & (F.col("_bytes") <= total)).drop("_n", "_bytes")


def stored_zip_size(entries: DataFrame) -> DataFrame:
    """``entries`` and the exact ``archive_size`` of a stored archive of rows (``name``, ``size``), as
    :func:`write_stored_zip` writes it: the directory's end takes 76 bytes more beyond 65,535 entries or 4 GiB before
    it. Exact while every entry and its offset fits 32 bits."""
    name = F.octet_length("name")
    each = LOCAL + CENTRAL + DESCRIPTOR + 2 * name + F.col("size")
    before = F.coalesce(F.sum(each - CENTRAL - name), F.lit(0))
    beyond = F.when((F.count("*") > MAX_16) | (before > MAX_32), END_64).otherwise(0)
    return entries.agg(F.count("*").alias("entries"), (F.coalesce(F.sum(each), F.lit(0)) + END + beyond).cast("bigint").alias("archive_size"))


class _Unseekable:
    """A sink that only goes forward, so that entries carry data descriptors."""

    def __init__(self, raw) -> None:
        self.raw, self.at = raw, 0

    def write(self, data) -> int:
        self.at += len(data)
        return self.raw.write(data)

    def flush(self) -> None:
        self.raw.flush()


class ArchiveFile:
    """A stored zip archive on a shared file system, written from front to back, with a manifest as its last entry."""

    def __init__(self, folder: str, export_id: str) -> None:
        from archivolt.operators.view import MANIFEST
        from archivolt.sources.files import resolve

        self.manifest, self.export_id = MANIFEST, export_id
        self.system, inner = resolve(folder)
        self.system.create_dir(inner, recursive=True)
        self.path = f"{inner.rstrip('/')}/{re.sub(r'[^A-Za-z0-9._-]', '_', export_id)}.zip"
        self.raw = self.system.open_output_stream(f"{self.path}.part", compression=None)
        self.archive = zipfile.ZipFile(_Unseekable(self.raw), "w", zipfile.ZIP_STORED)
        self.entries, self.duplicates, self.last, self.listed = 0, 0, None, []

    def add(self, name: str, body: bytes | None) -> None:
        """Entries come in order of name, so that only the last has to be remembered."""
        if body is None or name == self.last:
            self.duplicates += body is not None
            self.listed.append({"path": name, "status": "no-payload" if body is None else "duplicate"})
            return
        self._write(name, body)
        self.last, self.entries = name, self.entries + 1
        self.listed.append({"path": name, "status": "stored", "size": len(body)})

    def _write(self, name: str, body: bytes) -> None:
        self.archive.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), body, zipfile.ZIP_STORED)

    def finished(self):
        import pyarrow as pa

        self._write(self.manifest, json.dumps(self.listed).encode())
        self.archive.close()
        size = self.archive.fp.at if self.archive.fp else self.raw.tell()
        self.raw.close()
        self.system.move(f"{self.path}.part", self.path)
        row = (self.export_id, self.path, self.entries, self.duplicates, size)
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["export_id", "file", "entries", "duplicates", "bytes"])


def write_stored_zip(path: str, entries: Iterable[tuple[str, bytes]], deflate: bool = False) -> list[dict]:
    """Write entries in order, one at a time, into one archive; returns the ledger. A failing entry is noted and the
    others go on; of two entries of one path the first is kept. If the source itself breaks off, no archive stays."""
    import os

    ledger, names = [], set()
    part = f"{path}.part"
    try:
        with open(part, "wb") as raw, zipfile.ZipFile(_Unseekable(raw), "w", zipfile.ZIP_DEFLATED if deflate else zipfile.ZIP_STORED) as archive:
            for name, body in entries:
                if name in names:
                    ledger.append({"name": name, "status": "duplicate"})
                    continue
                try:
                    archive.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), body, zipfile.ZIP_DEFLATED if deflate else zipfile.ZIP_STORED)
                    names.add(name)
                    ledger.append({"name": name, "status": "stored", "size": len(body)})
                except (TypeError, ValueError) as error:
                    ledger.append({"name": name, "status": "error", "error": str(error)})
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.remove(part)
    return ledger


def colliding_paths(paths: DataFrame) -> DataFrame:
    """``id``, ``path`` and whether another entry has the path in any letter case; every peer is then renamed."""
    peers = Window.partitionBy(F.lower("path"))
    return paths.select("id", "path", (F.count("*").over(peers) > 1).alias("collides"))
