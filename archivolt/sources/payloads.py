"""Payload bytes of captures, read on the executors, file by file in order of offset."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.functions.codec import decode_content, dechunk
from archivolt.sources.files import Plain, member_slice

COLUMNS = ["file_path", "payload_offset", "payload_length", "is_chunked", "member_offset", "offset_in_member", "content_encoding"]


def read_payload(source: Plain, offset: int | None, length: int, chunked: bool, member: int | None, in_member: int | None, encoding: str | None) -> bytes:
    """The decoded body: out of its gzip member, then de-chunked, then content-decoded."""
    body = member_slice(source, member, in_member, length) if member is not None else source.read(offset, length)
    return decode_content(dechunk(body) if chunked else body, encoding)


def with_payloads(captures: DataFrame, id_col: str) -> DataFrame:
    """``id``, ``payload`` and ``error`` for captures as the ``warc`` source gives them, with ``content_encoding``.

    Rows without a location have neither. A missing file, a slice beyond a file's end or a broken member gives the
    row's error and no payload. Rows are range-partitioned by place, so a file is opened once per task and a large
    file is shared by several tasks.
    """
    located = captures.select(F.col(id_col).alias("id"), *COLUMNS).where("file_path is not null and payload_length is not null and (payload_offset is not null or member_offset is not null)")
    placed = located.repartitionByRange("file_path", F.coalesce("member_offset", "payload_offset")).sortWithinPartitions("file_path", F.coalesce("member_offset", "payload_offset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, source = None, None
        for batch in batches:
            bodies, errors = [], []
            for file, *place in zip(*(batch.column(c).to_pylist() for c in COLUMNS), strict=True):
                try:
                    if file != path:
                        if source is not None:
                            source.close()
                        path, source = file, Plain(file)
                    if place[3] is None and place[0] + place[1] > source.size:
                        raise ValueError(f"short read: {place[0] + place[1]} is beyond the file's {source.size} bytes")
                    bodies.append(read_payload(source, *place))
                    errors.append(None)
                except (OSError, ValueError, zlib.error) as error:
                    if source is None or isinstance(error, OSError):
                        path, source = None, None
                    bodies.append(None)
                    errors.append(f"{type(error).__name__}: {error}")
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(bodies, pa.binary()), pa.array(errors, pa.string())], names=["id", "payload", "error"])

    return placed.mapInArrow(run, f"id {captures.schema[id_col].dataType.simpleString()}, payload binary, error string")
