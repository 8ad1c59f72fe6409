"""Captures written as WARC files, one per task, into a shared folder."""

from __future__ import annotations

import gzip
import re
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.sources.files import resolve

#: Bytes of a chunk of a body that is sent in chunks.
CHUNK = 100
SUFFIX = {"plain": ".warc", "gz": ".warc.gz", "wacz": ".wacz"}


def _flat(text: str) -> str:
    """A header value; a line break would end it and is replaced by a blank."""
    return " ".join(x for x in re.split(r"[ \t\r\n]+", text) if x)


def record(kind: str, uri: str, date: str, block: bytes, identity: str, more: str = "") -> bytes:
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{identity}>\r\nWARC-Date: {date}\r\nWARC-Target-URI: {_flat(uri)}\r\n{more}Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def http_block(status: int, content_type: str | None, body: bytes, more: str = "") -> bytes:
    return f"HTTP/1.1 {status} -\r\nContent-Type: {_flat(content_type or 'application/octet-stream')}\r\n{more}\r\n".encode() + body


def response_record(uri: str, date: str, status: int, content_type: str | None, body: bytes, identity: str) -> bytes:
    return record("response", uri, date, http_block(status, content_type, body, f"Content-Length: {len(body)}\r\n"), identity)


def in_chunks(body: bytes) -> bytes:
    pieces = (body[i : i + CHUNK] for i in range(0, len(body), CHUNK))
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in pieces) + b"0\r\n\r\n"


def crawled(uri: str, date: str, status: int, content_type: str | None, body: bytes, identity: str) -> list[bytes]:
    """What a crawler writes of one capture: request, response, a resource that quotes a record, and a revisit. Bodies
    of odd length are sent in chunks, those of a length that 6 divides are compressed."""
    other = lambda part: str(uuid.uuid5(uuid.NAMESPACE_URL, f"{part} {identity}"))
    if len(body) % 2:
        block = http_block(status, content_type, in_chunks(body), "Transfer-Encoding: chunked\r\n")
    elif len(body) % 3 == 0:
        block = http_block(status, content_type, gzip.compress(body, 6, mtime=0), "Content-Encoding: gzip\r\n")
    else:
        block = http_block(status, content_type, body)
    quoted = response_record(uri, date, status, content_type, b"quoted", other("quoted"))
    return [
        record("request", uri, date, b"GET / HTTP/1.1\r\nHost: x\r\n\r\n", other("request")), record("response", uri, date, block, identity),
        record("resource", uri, date, quoted, other("resource")), record("revisit", uri, date, http_block(status, content_type, b""), other("revisit"), f"WARC-Refers-To: <urn:uuid:{identity}>\r\n"),
    ]


def write_warcs(df: DataFrame, folder: str, compress: bool = True, shape: str | None = None, whole: bool = False) -> DataFrame:
    """Write rows (``uri``, ``date`` text, ``status``, ``content_type``, ``body`` binary, ``identity``) below
    ``folder``; returns ``file_path`` and ``records`` per file. Rows with a null URI or body are left out; a task that
    is run again writes its file again under the same name.

    ``shape``: ``plain``, ``gz`` (a member a record) or ``wacz`` (the latter stored in a container, with an index of
    its responses). ``whole``: not only the response, but all that a crawler writes (:func:`crawled`).
    """
    form = shape or ("gz" if compress else "plain")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, inner = resolve(folder)
        system.create_dir(inner, recursive=True)
        name = f"{inner.rstrip('/')}/part-{TaskContext.get().partitionId():05d}{SUFFIX[form]}"
        n, at, index = 0, 0, []

        def pieces() -> Iterator[bytes]:
            nonlocal n, at
            for batch in batches:
                for uri, date, status, content_type, body, identity in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    status, identity = status if status is not None else 200, identity or str(uuid.uuid5(uuid.NAMESPACE_URL, uri))
                    every = crawled(uri, date, status, content_type, body, identity) if whole else [response_record(uri, date, status, content_type, body, identity)]
                    for k, one in enumerate(every):
                        data = one if form == "plain" else gzip.compress(one, 6, mtime=0)
                        if k == len(every) // 3:  # the response
                            index.append(f"{_flat(uri).replace(' ', '%20')} {date} - {_flat(content_type or '-').replace(' ', '')} {status} - - {len(data)} {at} - urn:uuid:{identity}\n")
                        n, at = n + 1, at + len(data)
                        yield data

        with system.open_output_stream(name, compression=None) as out:
            if form != "wacz":
                for data in pieces():
                    out.write(data)
            else:
                with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as container:
                    with container.open("archive/data.warc.gz", "w", force_zip64=True) as entry:
                        for data in pieces():
                            entry.write(data)
                    container.writestr("indexes/index.cdx", "".join(index))
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["file_path", "records"])

    rows = df.select("uri", "date", "status", "content_type", F.col("body").cast("binary").alias("body"), "identity").where("uri is not null and body is not null")
    return rows.mapInArrow(run, "file_path string, records bigint")
