"""The WARC source: any split of a file gives the rows of one pass, whatever the container."""

import json
import random

import pytest
import warcs
from pyspark.sql import functions as F

from archivolt.functions.codec import dechunk
from archivolt.sources import files, warc
from archivolt.sources.payloads import read_payload, with_payloads


def rows_of(path, start=0, end=None):
    return list(warc.decode(files.Plain(path), start, end))


def keys(rows):
    return [(r["offset"], r["warc_type"], r.get("target_uri"), r.get("payload_length")) for r in rows]


@pytest.mark.parametrize("gap", [b"\r\n\r\n", b"\r\n\r\n\r\n\r\n", b"\r\n"])
def test_segments_give_the_single_pass(tmp_path, gap):
    path = warcs.write(tmp_path / "a.warc", warcs.records(gap=gap))
    whole = keys(rows_of(path))
    assert len(whole) == 49
    size = files.Plain(path).size
    rng = random.Random(1)
    for n in (2, 5, 17):
        cuts = sorted(rng.sample(range(1, size), n - 1))
        parts = [k for a, b in zip([0, *cuts], [*cuts, size], strict=True) for k in keys(rows_of(path, a, b))]
        assert parts == whole


def test_small_segments_share_a_task_and_its_reads(tmp_path, monkeypatch):
    import zipfile

    path = warcs.write(tmp_path / "a.warc", warcs.records(300))
    with zipfile.ZipFile(tmp_path / "b.wacz", "w", zipfile.ZIP_STORED) as z:
        z.writestr("archive/data.warc", b"".join(warcs.records(300)))
    whole, size, taken = keys(rows_of(path)), files.Plain(path).size, []
    raw = files.Plain._raw
    monkeypatch.setattr(files.Plain, "_raw", lambda self, at, n: taken.append(len(data := raw(self, at, n))) or data)
    for task, step, tasks in ((4 << 20, 100, 1), (2_500, 1_000, size // 2_000 + 1), (100, 1_000, size // 1_000 + 1)):
        monkeypatch.setattr(warc, "TASK", task, raising=False)
        for name in ("a.warc", "b.wacz"):
            taken.clear()
            parts = warc.plan(str(tmp_path / name), {"segmentbytes": str(step)})
            assert tasks <= len(parts) <= tasks + (tasks > 1)  # the container is a little larger
            assert keys(dict(zip(warc._NAMES, r, strict=True)) for s in parts for r in warc.read_segment(s, None)) == whole
            assert tasks > 1 or sum(taken) < 8 * size


def test_fields_of_a_response(tmp_path):
    body = warcs.http(warcs.chunked(b"Wiki", b"pedia"), "301", ("Location: /x", "Set-Cookie: a=1", "set-cookie: b=2", "Transfer-Encoding: gzip, Chunked"))
    path = warcs.write(tmp_path / "a.warc", [warcs.record("response", "https://site.test/", body, extra="WARC-Payload-Digest: sha1:ABC")])
    (r,) = rows_of(path)
    assert (r["status"], r["reason"], r["http_version"], r["chunk_sizes"], r["is_chunked"]) == (301, None, "HTTP/1.1", [4, 5], True)
    assert r["http_headers"]["Set-Cookie"] == "a=1, b=2" and r["payload_digest"] == "sha1:ABC" and r["target_uri"] == "https://site.test/"
    assert read_payload(files.Plain(path), r["payload_offset"], r["payload_length"], True, None, None, None) == b"Wikipedia"


def test_missing_length_is_recovered_from_chunks_only(tmp_path):
    good = warcs.record("response", "https://site.test/a", warcs.http(warcs.chunked(b"abc"), headers=("Transfer-Encoding: chunked",)), length=False)
    bad = warcs.record("response", "https://site.test/b", warcs.http(b"abc"), length=False)
    last = warcs.record("response", "https://site.test/c", warcs.http(b"end"))
    rows = rows_of(warcs.write(tmp_path / "a.warc", [good, bad, last]))
    assert [r.get("error") for r in rows] == [None, "no Content-Length", None]
    assert rows[0]["chunk_sizes"] == [3] and rows[2]["skipped_bytes"] > 0


def test_response_without_status_line_is_a_row_of_its_own(tmp_path):
    rows = rows_of(warcs.write(tmp_path / "a.warc", [warcs.record("response", "dns:site.test", b"20240101\nsite.test 1.2.3.4"), warcs.record("response", "https://site.test/", warcs.http(b"x"))]))
    assert [r.get("error") for r in rows] == ["no HTTP status line", None]


def test_planted_record_is_not_taken_for_one(tmp_path):
    inner = warcs.record("response", "https://inner.test/", warcs.http(b"inner"))
    outer = warcs.record("resource", "https://outer.test/", b"junk\n" + inner)
    path = warcs.write(tmp_path / "a.warc", [outer, warcs.record("response", "https://next.test/", warcs.http(b"next"))])
    assert [r["target_uri"] for r in rows_of(path)] == ["https://outer.test/", "https://next.test/"]
    assert [r["target_uri"] for r in rows_of(path, 1)] == ["https://next.test/"]


def test_damage_is_skipped_and_counted(tmp_path):
    parts = warcs.records(6)
    parts.insert(3, b"\x00garbage\n" * 20)
    rows = rows_of(warcs.write(tmp_path / "a.warc", parts))
    assert len(rows) == 8 and sum(r["skipped_bytes"] for r in rows) >= 180


def test_bare_newlines(tmp_path):
    path = warcs.write(tmp_path / "a.warc", [warcs.record("resource", f"https://site.test/{i}", b"x" * i, newline="\n", gap=b"\n\n") for i in range(4)])
    assert len(rows_of(path)) == 4


def test_gzip_member_index_is_contiguous_and_slices_agree(tmp_path):
    parts = warcs.records(20)
    path = warcs.write_gz(tmp_path / "a.warc.gz", parts)
    source = files.Plain(path)
    index = list(files.member_index(source))
    assert [x[0] for x in index][1:] == [x[0] + x[1] for x in index][:-1] and index[-1][0] + index[-1][1] == source.size
    assert [x[3] for x in index] == [len(p) for p in parts]
    for (compressed, _, _, n), p in zip(index, parts, strict=True):
        assert files.member_slice(source, compressed, 3, n - 3) == p[3:]
    with pytest.raises(ValueError, match="fewer"):
        files.member_slice(source, index[0][0], 0, index[0][3] + 1)


def test_single_member_gzip_and_history(tmp_path):
    import gzip

    data = b"".join(warcs.records(30))
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(data))
    reader = files.Inflated(files.Plain(str(tmp_path / "a.warc.gz")), history=64)
    assert reader.read(len(data) - 50, 50) == data[-50:]
    with pytest.raises(files.PastWindow):
        files.Inflated(files.Plain(str(tmp_path / "a.warc.gz")), logical=10).read(2, 3)


def test_source_reads_every_container(spark, tmp_path):
    warc.register(spark)
    parts = warcs.records()
    (tmp_path / "deep").mkdir()
    warcs.write(tmp_path / "deep" / "a.warc", parts)
    warcs.write_gz(tmp_path / "b.warc.gz", parts)
    warcs.write_wacz(tmp_path / "c.wacz", parts)
    df = spark.read.format("warc").option("segmentBytes", 2000).load(str(tmp_path))
    got = {r["file_path"].rsplit("/", 1)[-1]: r["n"] for r in df.groupBy("file_path").agg(F.count("*").alias("n")).collect()}
    assert got == {"a.warc": 49, "b.warc.gz": 49, "c.wacz": 49}
    only = spark.read.format("warc").option("types", "response").load(str(tmp_path / "b.warc.gz"))
    assert only.count() == 40
    sums = []
    for name in ("deep/a.warc", "b.warc.gz", "c.wacz"):
        captures = spark.read.format("warc").option("types", "response").load(str(tmp_path / name)).withColumn("content_encoding", F.lit(None).cast("string"))
        bodies = with_payloads(captures, "target_uri")
        sums.append(sorted((r["id"], bytes(r["payload"]), r["error"]) for r in bodies.collect()))
    assert sums[0] == sums[1] == sums[2] and all(e is None for _, _, e in sums[0])
    assert sums[0][0][1].startswith(b"<p>page 0</p>")


def test_gzip_splits_by_member_index(spark, tmp_path):
    warc.register(spark)
    path = warcs.write_gz(tmp_path / "a.warc.gz", warcs.records())
    with open(tmp_path / "index.json", "w") as out:
        for compressed, _, logical, _ in files.member_index(files.Plain(path)):
            out.write(json.dumps({"file_path": path, "compressed_offset": compressed, "logical_offset": logical}) + "\n")
    plain = spark.read.format("warc").load(path)
    split = spark.read.format("warc").option("segmentBytes", 1500).option("memberIndex", str(tmp_path / "index.json")).load(path)
    assert split.rdd.getNumPartitions() > 3
    columns = ["offset", "warc_type", "target_uri", "member_offset", "offset_in_member"]
    assert sorted(map(tuple, split.select(*columns).collect()), key=str) == sorted(map(tuple, plain.select(*columns).collect()), key=str)


def test_deflated_container_is_refused(tmp_path):
    import zipfile

    with pytest.raises(ValueError, match="only stored"):
        files.archives_in(warcs.write_wacz(tmp_path / "c.wacz", warcs.records(3), zipfile.ZIP_DEFLATED))
    path = warcs.write_wacz(tmp_path / "d.wacz", warcs.records(3))
    ((name, start, size),) = files.cdx_ranges(path)
    assert name == "indexes/index.cdx" and files.Plain(path).read(start, size) == b"a b c\n"


def test_broken_file_gives_an_error_row(spark, tmp_path):
    warc.register(spark)
    (tmp_path / "a.warc.gz").write_bytes(b"\x1f\x8bnot gzip at all")
    warcs.write(tmp_path / "b.warc", warcs.records(3))
    df = spark.read.format("warc").load(str(tmp_path))
    assert df.where("file_path like '%a.warc.gz' and error is not null").count() == 1
    assert df.where("file_path like '%b.warc'").count() == 4


def test_stream_resumes_where_it_stopped(spark, tmp_path):
    warc.register(spark)
    from archivolt.streaming.ingest import start_ingest

    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    parts = warcs.records(20)
    path = folder / "a.warc"
    path.write_bytes(b"".join(parts[:9]) + parts[9][:30])  # the last record is still being written
    for _ in range(2):
        query = start_ingest(spark, str(folder), str(out), str(tmp_path / "checkpoint"), available_now=True)
        query.awaitTermination()
        path.write_bytes(b"".join(parts))
    query = start_ingest(spark, str(folder), str(out), str(tmp_path / "checkpoint"), available_now=True)
    query.awaitTermination()
    got = spark.read.parquet(str(out / "records"))
    assert got.count() == got.select("warc_custom_id").distinct().count() == 20


def test_every_record_of_a_growing_file_comes_once(tmp_path):
    parts = warcs.records(12)
    data = b"".join(parts)
    whole = [r["offset"] for r in warc.decode(warc.Plain(warcs.write(tmp_path / "w.warc", parts)), 0, None)]
    path = tmp_path / "g.warc"
    for step in (37, 400, 1111, 5000):
        got, done = [], 0
        for stop in [*range(step, len(data), step), len(data)]:
            path.write_bytes(data[:stop])
            for s in warc._stretches(str(path), done, stop, 700, upto=stop):
                got += [dict(zip(warc._NAMES, r, strict=True)) for r in warc.read_segment(s, None)]
            done = stop
        assert [r["offset"] for r in got] == whole and not any(r["error"] for r in got), step


def test_budgets_go_on_after_a_restart(spark, tmp_path):
    from archivolt.streaming import ingest

    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    warcs.write(folder / "a.warc", warcs.records(15))
    warcs.write_gz(folder / "b.warc.gz", warcs.records(5))
    size = (folder / "a.warc").stat().st_size
    for n in range(5):
        ingest.start_ingest(spark, str(folder), str(out), str(tmp_path / "log"), available_now=True, max_bytes=size // 3).awaitTermination()
        if n == 0:
            assert {r["status"] for r in ingest.file_progress(spark, str(out), str(folder)).collect()} == {"parsing", "pending"}
    got = spark.read.parquet(str(out / "records"))
    assert got.count() == got.select("warc_custom_id").distinct().count() == 20
    assert {(r["status"], r["byte_offset"] == r["file_size"]) for r in ingest.file_progress(spark, str(out), str(folder)).collect()} == {("parsed", True)}


def test_the_first_bytes_tell_what_a_file_is(spark, tmp_path):
    warc.register(spark)
    parts = warcs.records(6)
    warcs.write_gz(tmp_path / "a.warc", parts)
    warcs.write(tmp_path / "b.warc.gz", parts)
    n = len(list(warc.decode(warc.Plain(warcs.write(tmp_path / "c.warc", parts)), 0, None)))
    counts = spark.read.format("warc").option("segmentBytes", 900).load(str(tmp_path)).groupBy("file_path").count().collect()
    assert {r["count"] for r in counts} == {n} and len(counts) == 3


def test_dechunk_at_every_window():
    from archivolt.functions.codec import dechunk_stream

    body = warcs.chunked(b"Wiki", b"", b"pedia in chunks")[:0] + warcs.chunked(b"Wiki", b"pedia")
    for n in range(1, len(body) + 1):
        assert b"".join(dechunk_stream(body[i : i + n] for i in range(0, len(body), n))) == dechunk(body) == b"Wikipedia"
    assert dechunk(b"5\r\nab") == b"ab" and dechunk(b"zz\r\nab") == b""
