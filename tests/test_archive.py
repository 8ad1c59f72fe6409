"""The archive's operators on a small hand-made star."""

import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from archivolt.operators import archive as A
from archivolt.operators import closure, export, ingest, progress, redirects

BASE = datetime(2024, 1, 10)
NAMES = ["https://a.test/", "https://a.test/one", "https://a.test/two", "https://b.test/100%_sure", "https://b.test/x/y"]


@pytest.fixture(scope="module")
def star(spark):
    types = spark.createDataFrame([(1, "text/html; charset=utf-8", "text/html"), (2, "text/css", "text/css"), (3, "TEXT/HTML", "text/html")], "id bigint, type string, base_type string")
    uris = spark.createDataFrame([(i, u, u.count("/") - 3 + (not u.endswith("/")), [1] if i % 2 else [2]) for i, u in enumerate(NAMES)], "id bigint, uri string, recursion_level int, content_type_ids array<bigint>")
    files = spark.createDataFrame([(1, "f1.warc")], "id bigint, file_path string")
    records, responses = [], []
    for i in range(20):
        u = i % 5
        records.append((i, 1, f"f1.warc::{NAMES[u]}::{i}", "response", BASE + timedelta(hours=i), BASE, u, None, None, None, None))
        headers = {"Location": {0: "/one", 1: "//a.test/two", 2: "https://a.test/", 3: "gone", 4: "https://b.test/x/y"}[u]} if u != 4 or i > 10 else {"x": "y"}
        responses.append((100 + i, i, "HTTP/1.1", 302 if u < 4 else 200, 1 + u % 3, headers, None, None, BASE))
    records.append((0, 1, "old", "response", BASE, BASE - timedelta(days=1), 3, None, None, None, None))
    return A.Archive(
        types, uris, files,
        A.last_written(spark.createDataFrame(records, "id bigint, warc_file_id bigint, warc_custom_id string, record_type string, archived_date timestamp, created_at timestamp, uri_id bigint, ip_id bigint, payload_id bigint, payload_digest string, block_digest string"), "id", "created_at"),
        spark.createDataFrame(responses, "id bigint, record_id bigint, http_version string, status int, content_type_id bigint, headers map<string,string>, last_modified timestamp, concurrent_to bigint, created_at timestamp"),
        spark,
    )


def test_offset_and_keyset_pages_agree(star):
    seen, level, uri = [], None, None
    for n in range(6):
        by_offset = {r["response_id"] for r in star.search("test", n, 1).collect()}
        rows = star.search_after("test", level, uri, 1).collect()
        assert {r["response_id"] for r in rows} == by_offset
        if rows:
            level, uri = rows[0]["recursion_level"], rows[0]["uri"]
            seen.append(uri)
    assert seen == sorted(NAMES, key=lambda u: (u.count("/") - 3 + (not u.endswith("/")), u))


def test_search_escapes_and_filters(star):
    assert {r["uri"] for r in star.search("100%_").collect()} == {NAMES[3]}
    assert star.search("%").count() == 4 and star.search("nothing").count() == 0
    typed = star.search("test", content_type="text/html").collect()
    assert {r["uri"] for r in typed} == {NAMES[3]} and len(typed) == 4
    assert star.search(" ", content_type="unknown/type").count() == 0
    assert star.search_count("test").first()[0] == 5 and star.search_count("test", cap=3).first()[0] == 3 and star.search_count(None, "css").first()[0] == 3


def test_plan_cuts_the_page_before_joining(star):
    plan = star.search("test", 0, 2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "BroadcastHashJoin" in plan


def test_history_and_site(star):
    assert [r["response_id"] for r in star.history(NAMES[1] + "#x").collect()] == [116, 111, 106, 101]
    assert star.history(" ").count() == 0
    assert star.site_responses(warc_custom_id=f"f1.warc::{NAMES[2]}::2").count() == 4
    with pytest.raises(ValueError, match="needs"):
        star.site_responses()


def test_near_ties_and_sides(star):
    assert star.near(NAMES[0], "2024-01-10T02:30:00Z").first()["response_id"] == 100
    assert star.near(NAMES[0], "2024-01-10T04:00:00Z").first()["response_id"] == 105
    assert star.near(NAMES[0], "1999-01-01T00:00:00Z").first()["response_id"] == 100
    assert star.near("https://none.test/", "2024-01-10T00:00:00Z").first() is None
    followed = star.near_following(NAMES[0], "2024-01-10T00:00:00Z").first()
    assert followed["followed"] and followed["response_id"] == 101


def test_nearest_matches_brute_force(spark):
    import random

    rng = random.Random(3)
    moment = lambda: BASE + timedelta(days=rng.randrange(-90, 90), seconds=rng.choice([0, 0, 60, 3600]))
    captures = [(rng.choice(["hot", "hot", "hot", "cold"]), moment(), i) for i in range(120)]
    requests = [(rng.choice(["hot", "cold", "never", None]), rng.choice([moment(), moment(), None]), i) for i in range(200)]
    got = A.nearest(spark.createDataFrame(requests, "uri string, moment timestamp, rid bigint"), spark.createDataFrame(captures, "uri string, archived_date timestamp, cid bigint"), ["rid"])
    want = {}
    for u, t, i in requests:
        near = [(abs(d - t), d, c) for v, d, c in captures if v == u] if t is not None else []
        if near:
            want[i] = min(near)[2]
    assert {r["rid"]: r["cid"] for r in got.collect()} == want


def test_redirect_chains(spark, star):
    paths = redirects.redirect_paths(star.captures(), spark.createDataFrame([(100,), (100,), (103,), (104,), (114,)], "response_id bigint")).collect()
    by = {}
    for r in sorted(paths, key=lambda r: r["hop"]):
        by.setdefault(r["start_id"], []).append(r["uri"])
    assert by[100] == NAMES[:3] and by[103] == [NAMES[3]] and by[104] == [NAMES[4]] and by[114] == [NAMES[4]]
    capped = redirects.redirect_paths(star.captures(), spark.createDataFrame([(100,)], "response_id bigint"), 2)
    assert capped.count() == 2


def test_batch_keeps_order_and_unknown_ids(star):
    ids = [f"f1.warc::{NAMES[1]}::1", "none", f"f1.warc::{NAMES[0]}::0"]
    rows = sorted(star.batch(ids).collect(), key=lambda r: r["ordinal"])
    assert [r["response_id"] for r in rows] == [101, None, 100]
    assert star.batch([]).count() == 0


def test_parse_work_reasons(spark):
    files = spark.createDataFrame([(i, f"f{i}") for i in range(9)], "id bigint, file_path string")
    state = [(1, "pending", 0, 10, 0), (2, "parsing", 5, 10, 1), (3, "parsing", 0, 10, 0), (4, "parsed", 10, 10, 3), (5, "parsed", 10, 10, 3), (6, "parsed", 10, 10, 3), (7, "error", 4, 10, 2), (8, "parsed", 10, 10, 3)]
    done = spark.createDataFrame([(*s, None) for s in state], "file_id bigint, status string, byte_offset bigint, file_size bigint, records bigint, error string")
    sizes = spark.createDataFrame([(f"f{i}", s) for i, s in enumerate([10, 10, 10, 10, 20, 5, 10, 10])], "file_path string, size bigint")
    got = {r["file_id"]: (r["reason"], r["start"], r["records"]) for r in progress.parse_work(progress.parse_plan(files, done), sizes).collect()}
    assert got == {0: ("new", 0, 0), 1: ("new", 0, 0), 2: ("resume", 5, 1), 3: ("new", 0, 0), 4: ("grew", 10, 3), 5: ("replaced", 0, 0), 6: ("done", 10, 3), 7: ("retry", 4, 2)}
    batches = spark.createDataFrame([(1, 0, 10, True), (1, 10, 20, False), (1, 20, 30, True), (2, 0, 9, True)], "file_id bigint, start bigint, end bigint, finished boolean")
    assert {r["file_id"]: r["safe_offset"] for r in progress.low_watermark(batches).collect()} == {1: 10, 2: 9}


def bulk(spark, rows):
    schema = "row_id bigint, batch_id int, warc_custom_id string, warc_record_id string, warc_archived_date timestamp, file_path string, ip string, uri string, http_content_type string, http_headers map<string,string>, http_status int, http_last_modified timestamp, payload_byte_offset bigint, payload_byte_length bigint, payload_chunks array<bigint>, payload_digest string, recursion_level int"
    full = [(i, 1, c, None, BASE, "f", ip, u, t, {"a": 'b"c'}, 200, None, o, n, None, None, 0) for i, (c, u, t, ip, o, n) in enumerate(rows)]
    return spark.createDataFrame(full, schema)


def test_ingest_is_idempotent(spark, tmp_path):
    first = bulk(spark, [("a", "https://a.test/", "text/html", None, 0, 5), ("b", "https://a.test/", " ", "1.2.3.4", None, None), ("c", " ", None, None, 0, 1), (None, "u", None, None, 0, 1), ("d", "u", None, None, 0, 1), ("d", "u", None, None, 0, 1)])
    assert {r["reason"] for r in ingest.invalid_rows(first).collect()} == {"blank uri", "blank id", "repeated id"}
    for _ in range(2):
        ingest.write_batch(first, str(tmp_path / "star"))
    count = lambda t: spark.read.parquet(str(tmp_path / "star" / t)).count()
    assert {t: count(t) for t in ("records", "responses", "uris", "content_types", "payloads", "ips")} == {"records": 2, "responses": 2, "uris": 1, "content_types": 1, "payloads": 1, "ips": 1}
    ingest.write_batch(bulk(spark, [("e", "https://a.test/", "text/css", None, 9, 5)]), str(tmp_path / "star"))
    assert count("records") == 3 and count("uris") == 1 and count("content_types") == 2
    sets = spark.read.parquet(str(tmp_path / "star" / "uri_type_sets")).groupBy("uri_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("content_type_ids")))).alias("n"))
    assert sets.first()["n"] == 2


def test_header_refresh(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3", "c": "4"}), (None, {"x": "y"}), ({"x": "y"}, None)], "o map<string,string>, n map<string,string>")
    assert [dict(r[0]) for r in df.select(ingest.refreshed_headers(F.col("o"), F.col("n"))).collect()] == [{"a": "1", "b": "3", "c": "4"}, {"x": "y"}, {"x": "y"}]


SITE = [
    (1, "https://site.test/", "text/html", 200, "<link rel=stylesheet href=/style.css><img src=/logo.png><a href=/about.html>", "d1"),
    (2, "https://site.test/style.css", "text/css", 200, "a{b:url(/bg.png)} @import '/style.css'; c{d:url(/lost.png)}", "d2"),
    (3, "http://site.test/style.css", "text/css", 200, "a{b:url(/bg.png)} @import '/style.css'; c{d:url(/lost.png)}", "d2"),
    (4, "https://site.test/logo.png", "image/png", 404, None, "d4"),
    (5, "https://site.test/bg.png", "image/png", 200, "png", "d5"),
    (6, "https://site.test/about.html", "text/html", 200, "<img src=/Logo.PNG>", "d6"),
]


def test_closure_of_a_small_site(spark):
    captures = spark.createDataFrame([(i, u, BASE, t, s, b) for i, u, t, s, b, _ in SITE], "id bigint, uri string, archived_date timestamp, content_type string, status int, body string")
    rows = closure.dependency_closure(captures, spark.createDataFrame([(1,), (1,)], "id bigint")).collect()
    got = {r["url"].rsplit("/", 1)[-1]: (r["depth"], r["id"], r["reason"]) for r in rows}
    assert got == {"": (0, 1, None), "style.css": (1, 2, None), "logo.png": (1, 4, "error-status"), "bg.png": (2, 5, None), "lost.png": (2, None, "not-archived")}
    shallow = closure.dependency_closure(captures, spark.createDataFrame([(1,)], "id bigint"), 1).collect()
    assert {r["url"].rsplit("/", 1)[-1] for r in shallow if r["reason"] == "depth-limit"} == {"bg.png", "lost.png"}


def test_cycles_of_sheets_and_unreadable_bodies(spark):
    url = "https://site.test/{}.css".format
    rows = [(1, url("a"), "@import 'b.css'; url(x.png)", None), (2, url("b"), "@import 'c.css'", None), (3, url("c"), "@import 'a.css'", None), (4, url("d"), "@import 'd.css#x'", None), (5, url("e"), "@import 'a.css'", None), (6, "https://site.test/x.png", None, "broken member")]
    captures = spark.createDataFrame([(i, u, BASE, "text/css" if u.endswith("css") else "image/png", 200, b, e) for i, u, b, e in rows], "id bigint, uri string, archived_date timestamp, content_type string, status int, body string, error string")
    assert {(r["id"], r["url"]) for r in closure.cyclic_references(captures).collect()} == {(1, url("b")), (2, url("c")), (3, url("a")), (4, url("d"))}
    needs = {r["url"]: r["reason"] for r in closure.dependency_closure(captures, captures.where("id = 1").select("id")).collect()}
    assert needs == {url("a"): None, url("b"): None, url("c"): None, "https://site.test/x.png": "unreadable"}
    assert closure.cyclic_references(captures.limit(0)).collect() == []


def test_entries_merge_and_paths(spark):
    entries = spark.createDataFrame([(i, u, t, s, d, "x/arc.warc", f"u{i}") for i, u, t, s, _, d in SITE], "id bigint, url string, content_type string, status int, digest string, archive string, uuid string")
    merged = {r["entry_id"]: r["urls"] for r in closure.merged_entries(entries).collect()}
    assert len(merged) == 5 and len(merged[2]) == 2
    paths = {r["id"]: r["path"] for r in closure.assigned_paths(entries).collect()}
    assert paths[1] == "site.test/index.html" and paths[2] == "site.test/style.x_arc.u2.css" and paths[3] == "site.test/style.x_arc.u3.css" and len(set(paths.values())) == 6
    lines = closure.manifest(spark.createDataFrame([(1, "p")], "id bigint, path string"), spark.createDataFrame([("u", "not-archived")], "url string, reason string")).collect()
    assert [r["kind"] for r in lines] == ["entry", "missing"]


def test_zip_has_the_size_that_was_computed(spark, tmp_path):
    entries = [("a.txt", b"x" * 1000), ("ü/é.html", b""), ("a.txt", b"again"), ("big", b"\x00" * 100_000)]
    path = str(tmp_path / "out.zip")
    ledger = export.write_stored_zip(path, entries)
    assert [x["status"] for x in ledger] == ["stored", "stored", "duplicate", "stored"]
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and z.namelist() == ["a.txt", "ü/é.html", "big"] and z.read("big") == b"\x00" * 100_000
    df = spark.createDataFrame([(n, len(b)) for n, b in (entries[0], entries[1], entries[3])], "name string, size bigint")
    assert export.stored_zip_size(df).first()["archive_size"] == (tmp_path / "out.zip").stat().st_size

    def broken():
        yield "a", b"1"
        raise RuntimeError("cancelled")

    with pytest.raises(RuntimeError):
        export.write_stored_zip(str(tmp_path / "no.zip"), broken())
    assert not list(tmp_path.glob("no.zip*"))


def test_crc_is_the_usual_one(spark):
    (row,) = spark.sql("select crc32(cast('The quick brown fox jumps over the lazy dog' as binary)) c").collect()
    assert row["c"] == 0x414FA339


def test_compact_gives_the_same_lookups_and_pushes_filters(spark, tmp_path):
    import os

    source = "/root/testdata/sf0.001"
    if not os.path.isdir(source):
        pytest.skip("no test tables here")
    A.compact(spark, source, str(tmp_path))
    raw, packed = A.Archive.read(spark, source), A.Archive.read(spark, str(tmp_path), unique=True)
    uri = raw.captures(["uri"]).groupBy("uri").count().orderBy(F.desc("count"), "uri").first()["uri"]
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(raw.history(uri).drop("headers"), packed.history(uri).drop("headers")) and same(raw.search("test"), packed.search("test"))
    assert packed.records.count() == packed.records.select("id").distinct().count() == raw.records.count()
    plan = packed.near(uri, "2024-01-10T00:00:00Z")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(uri_id" in plan or "In(uri_id" in plan
