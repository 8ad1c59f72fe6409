"""The ``warc`` data source: captures of .warc, .warc.gz and .wacz files, in batch and as a stream.

A file is split into segments; a record belongs to the segment in which its first byte lies, so any number of segments
gives the rows of a single pass. A segment that begins inside a record looks for the next line that begins a record and
accepts it only if the record it announces ends where another begins (or the file ends), with the gap the file uses.
"""

from __future__ import annotations

import io
import json
import re
import struct
import zlib
from collections.abc import Iterable, Iterator, Sequence
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from archivolt.functions.codec import SIZE_LINE
from archivolt.sources.files import Inflated, Plain, archives_in, list_files, resolve

SCHEMA = """file_path string, entry string, offset bigint, length bigint, warc_version string, warc_type string, record_id string, target_uri string,
warc_date timestamp, ip string, warc_headers map<string,string>, http_version string, status int, reason string, http_headers map<string,string>,
payload_offset bigint, payload_length bigint, is_chunked boolean, chunk_sizes array<bigint>, payload_digest string, is_truncated boolean,
member_offset bigint, offset_in_member bigint, skipped_bytes bigint, error string"""
SEGMENT, WINDOW, HEADER_MAX = 64 << 20, 1 << 20, 1 << 20
#: Segments smaller than this are read several in a task, each for itself; starting a task costs more than reading one.
TASK = 4 << 20
#: Bytes between a record's content and the next record, as the standard has it and as some writers do.
GAPS = (4, 8, 0, 2)
MARK = b"WARC/1."
BLANKS = " \t\r\n"
_STATUS = re.compile(rb"^HTTP/(\d+(?:\.\d+)?)[ \t]+(\d{3})(?:[ \t]+(.*))?$")
_UUID = re.compile(r"urn:uuid:([0-9a-fA-F-]{36})")


def split_header(reader, at: int) -> tuple[bytes, int] | None:
    """The header block from ``at`` and the offset behind its blank line; None if there is none in the file."""
    size = 1024
    while True:
        block = reader.read(at, size)
        ends = [(k, n) for k, n in ((block.find(b"\r\n\r\n"), 4), (block.find(b"\n\n"), 2)) if k >= 0]
        if ends:
            k, n = min(ends)
            return block[:k], at + k + n
        if len(block) < size or size >= HEADER_MAX:
            return None
        size *= 8


def fields(lines: Sequence[bytes]) -> dict[str, str]:
    """Header fields; repeated ones are joined by ``", "`` under their first spelling, folded lines are unfolded."""
    out: dict[str, str] = {}
    spelling: dict[str, str] = {}
    last = None
    for raw in lines:
        line = raw.decode("utf-8", "replace")
        if line[:1] in " \t" and last:
            out[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon:
            continue
        name, value = name.strip(BLANKS), value.strip(BLANKS)
        last = spelling.setdefault(name.lower(), name)
        out[last] = f"{out[last]}, {value}" if last in out else value
    return out


def get(headers: dict[str, str], name: str) -> str | None:
    if name in headers:
        return headers[name]
    return next((v for k, v in headers.items() if k.lower() == name.lower()), None)


def timestamp(text: str | None) -> datetime | None:
    try:
        at = datetime.fromisoformat((text or "").strip().replace("Z", "+00:00"))
    except ValueError:
        return None
    return at if at.tzinfo else at.replace(tzinfo=UTC)


def walk_chunks(reader, at: int, end: int | None) -> tuple[list[int], int]:
    """Sizes of the chunks from ``at`` and the offset behind the terminator. Stops at the end, at a size line that is
    none, or without a line end within 64 bytes."""
    sizes: list[int] = []
    while end is None or at < end:
        line = reader.read(at, SIZE_LINE if end is None else min(SIZE_LINE, end - at))
        k = line.find(b"\r\n")
        if k < 0:
            break
        try:
            n = int(line[:k].split(b";")[0].strip(), 16)
        except ValueError:
            break
        at += k + 2
        if n <= 0:
            return sizes, at + 2
        sizes.append(n)
        at += n + 2
    return sizes, at


def is_record(reader, at: int) -> bool:
    return reader.read(at, len(MARK)) == MARK


def content_bounds(reader, at: int) -> tuple[dict[str, str], str, int, int | None] | None:
    """(fields, version, content start, content end or None if unknown) of the record at ``at``."""
    block = split_header(reader, at)
    if block is None:
        return None
    lines = block[0].split(b"\n")
    lines = [x.rstrip(b"\r") for x in lines]
    headers = fields(lines[1:])
    size = get(headers, "Content-Length")
    end = block[1] + int(size) if size and size.strip().isdigit() else None
    return headers, lines[0].decode("latin-1").strip(), block[1], end


def next_record(reader, end: int, size: int | None, gap: int | None) -> tuple[int | None, int | None]:
    """Where the record behind content that ends at ``end`` begins, and the gap; (None, None) if not where it should;
    (-1, gap) at the end of the file."""
    for g in (gap,) if gap is not None else GAPS:
        tail = reader.read(end, g + len(MARK))
        if tail[g:] == MARK and not tail[:g].strip(b"\r\n"):
            return end + g, g
    if not reader.read(end, 16).strip(b"\r\n"):
        return -1, gap
    return None, None


def find_record(reader, at: int, limit: int | None, gap: int | None) -> int | None:
    """The first confirmed record that begins at or behind ``at`` and before ``limit``."""
    position = at
    while limit is None or position < limit:
        span = WINDOW if limit is None else min(WINDOW, limit - position)
        window = reader.read(position, span + len(MARK))
        if not window:
            return None
        k = window.find(MARK)
        while k >= 0 and (k < span or len(window) <= span):
            here = position + k
            if limit is not None and here >= limit:
                return None
            before = window[k - 1 : k] if k else reader.read(here - 1, 1) if here else b"\n"
            if before == b"\n" and confirmed(reader, here, gap):
                return here
            k = window.find(MARK, k + 1)
        if len(window) <= span:
            return None
        position += span
    return None


def confirmed(reader, at: int, gap: int | None) -> bool:
    bounds = content_bounds(reader, at)
    if bounds is None or not get(bounds[0], "WARC-Type"):
        return False
    if bounds[3] is None:
        return True
    following, _ = next_record(reader, bounds[3], None, gap)
    return following is not None


def record_before(reader, at: int, gap: int | None) -> int:
    """A record that begins before ``at``, from which the walk forward meets the one that reaches over ``at``."""
    low = at
    while low > 0:
        low = max(0, low - WINDOW)
        found = find_record(reader, low, at, gap)
        if found is not None:
            return found
    return 0


def decode(reader, start: int, end: int | None, types: frozenset[str] | None = None, gap: int | None = None, upto: int | None = None, after: int | None = None) -> Iterator[dict]:
    """The records whose first byte lies in ``[start, end)``. Bytes that belong to no record are skipped and counted
    on the next row; a record that cannot be read gives a row with ``error``. With ``upto``, of a file that is still
    written, a record that ends behind it is left for later; with ``after``, the record that reaches over that offset
    comes first and those that end before it are left out."""
    if gap is None:
        gap = learn_gap(reader) if not isinstance(reader, Inflated) else 4
    at, skipped = start if after is None else record_before(reader, after, gap), 0
    if not is_record(reader, at) or (start and not confirmed(reader, at, gap)):
        found = find_record(reader, at, end, gap)
        if found is None:
            return
        skipped = 0 if start else found - at
        at = found
    while at is not None and (end is None or at < end):
        bounds = content_bounds(reader, at)
        if bounds is None:
            if upto is not None:
                return
            yield {"offset": at, "skipped_bytes": skipped, "error": "the record's header has no end"}
            return
        headers, version, body, stop = bounds
        row = {"offset": at, "warc_version": version, "warc_type": (get(headers, "WARC-Type") or "").lower() or None, "warc_headers": headers, "skipped_bytes": skipped}
        uri = (get(headers, "WARC-Target-URI") or "").strip(BLANKS)
        uri = uri[1:-1].strip(BLANKS) if uri[:1] == "<" and uri[-1:] == ">" else uri
        uuid = _UUID.search(get(headers, "WARC-Record-ID") or "")
        row |= {"target_uri": uri or None, "record_id": uuid[1].lower() if uuid else None, "warc_date": timestamp(get(headers, "WARC-Date")), "ip": get(headers, "WARC-IP-Address"), "payload_digest": get(headers, "WARC-Payload-Digest"), "is_truncated": get(headers, "WARC-Truncated") is not None}
        if row["warc_type"] == "response":
            stop = _response(reader, row, body, stop)
        elif stop is None:
            row["error"] = "no Content-Length"
        row["length"] = stop - at if stop is not None else None
        if upto is not None and (stop if stop is not None else body) > upto:
            return
        if stop is not None and len(reader.read(stop - 1, 1)) == 0 and stop > body:
            row["error"] = row.get("error") or "the record is cut off"
        if isinstance(reader, Inflated):
            member, logical = reader.member_at(at)
            row |= {"member_offset": member, "offset_in_member": row.get("payload_offset", at) - logical}
        if (types is None or row["warc_type"] in types) and (after is None or (stop if stop is not None else body) > after):
            yield row
        skipped = 0
        following, _ = next_record(reader, stop, None, gap) if stop is not None else (None, None)
        if following == -1:
            return
        if following is None:
            resume = stop if stop is not None else body
            following = find_record(reader, resume, None, gap)
            skipped = following - resume if following is not None else 0
        at = following


def _response(reader, row: dict, body: int, stop: int | None) -> int | None:
    block = split_header(reader, body)
    first = block[0].split(b"\n", 1)[0].rstrip(b"\r") if block and (stop is None or block[1] <= stop) else b""
    status = _STATUS.match(first)
    if not status:
        row["error"] = "no HTTP status line"
        return stop
    http = fields([x.rstrip(b"\r") for x in block[0].split(b"\n")[1:]])
    codings = [x.strip() for x in (get(http, "Transfer-Encoding") or "").lower().split(",")]
    row |= {"http_version": "HTTP/" + status[1].decode(), "status": int(status[2]), "reason": (status[3] or b"").decode("latin-1").strip() or None, "http_headers": http, "payload_offset": block[1], "is_chunked": "chunked" in codings}
    if "chunked" in codings:
        sizes, behind = walk_chunks(reader, block[1], stop)
        row["chunk_sizes"] = sizes
        stop = behind if stop is None else stop
    elif stop is None:
        row["error"] = "no Content-Length"
        return None
    row["payload_length"] = stop - block[1]
    return stop


def learn_gap(reader) -> int:
    """The gap between records that the file's first two records show; 4, the standard's, where they show none."""
    if is_record(reader, 0) and (bounds := content_bounds(reader, 0)) and bounds[3] is not None:
        _, gap = next_record(reader, bounds[3], None, None)
        if gap is not None:
            return gap
    return 4


class Segment(InputPartition):
    """A stretch ``[start, end)`` of a file, whose first bytes the executor looks at; of a compressed file the logical
    stretch from the member at ``compressed`` on. ``upto`` and ``after``: see :func:`decode`. With ``step``, so many
    segments of that size in one task."""

    def __init__(self, path: str, start: int, end: int | None, compressed: int = 0, upto: int | None = None, after: int | None = None, step: int | None = None) -> None:
        self.path, self.start, self.end, self.compressed, self.upto, self.after, self.step = path, start, end, compressed, upto, after, step

    def cuts(self) -> Iterator[tuple[int, int | None, int | None]]:
        """(start, end, after) of each segment."""
        if self.end is None or self.step is None:
            yield self.start, self.end, self.after
            return
        for a in range(self.start, self.end, self.step):
            yield a, min(a + self.step, self.end), self.after if a == self.start else None


def _stretches(file: str, begin: int, stop: int, step: int, **more) -> list[Segment]:
    task = max(1, TASK // step) * step
    return [Segment(file, a, min(a + task, stop), after=begin if begin and a == begin else None, step=step, **more) for a in range(begin, stop, task)]


def _is_gzip_name(file: str) -> bool:
    return file.lower().endswith(".gz")


def member_groups(path: str, step: int) -> dict[str, list[tuple[int, int]]]:
    """Of a member index in order (JSON lines of file_path, compressed_offset, logical_offset) one member every
    ``step`` compressed bytes and file: as few as the segments, however many members there are. The index is read once,
    line by line, from where the archives are shared."""
    system, inner = resolve(path)
    groups: dict[str, list[tuple[int, int]]] = {}
    with system.open_input_stream(inner) as raw, io.TextIOWrapper(io.BufferedReader(_Readable(raw)), "utf-8") as lines:
        for line in lines:
            if not line.strip():
                continue
            x = json.loads(line)
            own = groups.setdefault(x["file_path"], [(0, 0)])
            if x["compressed_offset"] - own[-1][0] >= step:
                own.append((x["compressed_offset"], x["logical_offset"]))
    return groups


class _Readable(io.RawIOBase):
    def __init__(self, raw) -> None:
        self.raw = raw

    def readable(self) -> bool:
        return True

    def readinto(self, target) -> int:
        data = self.raw.read(len(target))
        target[: len(data)] = data
        return len(data)


def plan(path: str, options: dict) -> list[Segment]:
    """One segment per 64 MiB of a file; one per compressed file, or per group of members with an index. Smaller
    segments of a file share tasks of 4 MiB. Only the folder is listed; no file is opened."""
    step = int(options.get("segmentbytes", SEGMENT))
    groups = member_groups(options["memberindex"], step) if options.get("memberindex") else {}
    out = []
    for file, size in list_files(path):
        if not _is_gzip_name(file):
            out += _stretches(file, 0, size, step)
            continue
        own = groups.get(file, [(0, 0)])
        ends = [g[1] for g in own[1:]] + [None]
        out += [Segment(file, logical, end, compressed) for (compressed, logical), end in zip(own, ends, strict=True)]
    return out


_NAMES = [x.strip().split()[0] for x in re.sub(r"<[^>]*>", "", SCHEMA).split(",")]


def read_segment(s: Segment, types: frozenset[str] | None) -> Iterator[tuple]:
    """The rows of a segment. What the file is, its first bytes tell, not its name: a stretch of a plain file or entry
    gives the records that begin in it, a compressed file or entry belongs to the stretch in which it begins."""

    def broken(error: Exception, at: int) -> tuple:
        return tuple({"file_path": s.path, "offset": at, "error": f"{type(error).__name__}: {error}"}.get(c) for c in _NAMES)

    try:
        archives = archives_in(s.path)
    except (OSError, ValueError, struct.error) as error:
        if s.start == 0:
            yield broken(error, s.start)
        return
    for kind, base, size, entry in archives:
        if kind == "gzip":
            if _is_gzip_name(s.path) or s.start <= base < (s.end or 0):
                whole = not _is_gzip_name(s.path)
                yield from _rows(s, kind, base, size, entry, [(s.start, 0 if whole else s.start, None if whole else s.end, None)], types, broken)
        elif s.end is None or (s.start < base + size and s.end > base):
            cuts = ((a, max(a - base, 0), size if b is None else min(b - base, size), after) for a, b, after in s.cuts() if b is None or (a < base + size and b > base))
            yield from _rows(s, kind, base, size, entry, cuts, types, broken)


def _rows(s: Segment, kind: str, base: int, size: int, entry: str, cuts: Iterable[tuple[int, int, int | None, int | None]], types: frozenset[str] | None, broken) -> Iterator[tuple]:
    """The rows of the segments ``cuts``, (place in the file, start, end, after) within the archive. Each is decoded for
    itself; they share the open file, its block in memory and the gap."""
    reader, gap = Plain(s.path, base, size), None
    source = reader
    growing = kind == "plain" and not base
    try:
        for place, start, end, after in cuts:
            try:
                if kind == "gzip":
                    source = Inflated(reader, s.compressed, start)
                elif gap is None:
                    gap = learn_gap(reader)
                for row in decode(source, start, end, types, gap, s.upto if growing else None, after if growing else None):
                    row |= {"file_path": s.path, "entry": entry or None}
                    if row.get("member_offset") is not None:
                        row["member_offset"] += base
                    elif base:
                        row["payload_offset"] = row["payload_offset"] + base if row.get("payload_offset") is not None else None
                    yield tuple(row.get(c) for c in _NAMES)
            except (OSError, ValueError, zlib.error) as error:  # one broken file does not fail the job
                yield broken(error, place)
    finally:
        reader.close()


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options
        self.types = frozenset(x.strip().lower() for x in options["types"].split(",")) if options.get("types") else None

    def partitions(self) -> Sequence[InputPartition]:
        return plan(self.options["path"], self.options)

    def read(self, partition: Segment) -> Iterator[tuple]:
        return read_segment(partition, self.types)


class WarcStreamReader(DataSourceStreamReader):
    """New records of a folder whose plain files grow and whose compressed files arrive whole. The offset maps each
    file to the byte up to which it has been taken, by its size alone; ``maxBytesPerTrigger`` bounds a batch. A record
    belongs to the batch in which it ends, so one that is half written waits, and the next batch's executors look for
    its beginning. No file is opened on the driver. ``resumeFrom`` is the offset at which a restarted query stopped, for
    a source is not told; without it a budget would count from the beginning again."""

    def __init__(self, options: dict) -> None:
        self.options = options
        self.types = frozenset(x.strip().lower() for x in options["types"].split(",")) if options.get("types") else None
        self.seen: dict[str, int] = json.loads(json.loads(options.get("resumefrom") or '{"files": "{}"}')["files"])

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        budget = int(self.options.get("maxbytespertrigger", 1 << 40))
        offsets = dict(self.seen)
        for file, size in list_files(self.options["path"]):
            done = offsets.get(file, 0)
            if size <= done or budget <= 0:
                continue
            upto = min(size, done + budget) if file.lower().endswith(".warc") else size
            budget -= upto - done
            offsets[file] = upto
        self.seen = offsets
        return {"files": json.dumps(offsets, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        self.seen = {**after, **self.seen} if not self.seen else self.seen
        step, out = int(self.options.get("segmentbytes", SEGMENT)), []
        for file, stop in sorted(after.items()):
            begin = before.get(file, 0)
            if stop <= begin:
                continue
            if file.lower().endswith(".warc"):
                out += _stretches(file, begin, stop, step, upto=stop)
            elif _is_gzip_name(file):
                out.append(Segment(file, 0, None))
            else:
                out += _stretches(file, 0, stop, step)
        return out

    def read(self, partition: Segment) -> Iterator[tuple]:
        return read_segment(partition, self.types)

    def commit(self, end: dict) -> None:
        return None


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(path)``. Options: ``types`` (comma-separated record types), ``segmentBytes``,
    ``memberIndex`` (see :func:`member_groups`), ``maxBytesPerTrigger``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader({k.lower(): v for k, v in dict(self.options).items()})

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return WarcStreamReader({k.lower(): v for k, v in dict(self.options).items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
