"""Views, ledgers and offline bundles."""

import json
import zipfile
from datetime import datetime

from pyspark.sql import functions as F

from archivolt.functions import native as N
from archivolt.operators import ingest, view
from archivolt.sources import files

BASE = datetime(2024, 1, 1)


def test_views_rewrite_documents_only(spark):
    rows = [(1, "https://a.test/", BASE, "text/html", bytearray(b"<a href='/b'>")), (2, "https://a.test/s.css", BASE, "TEXT/css; x", bytearray(b"url(i.png)")), (3, "https://a.test/i.png", BASE, "image/png", bytearray(b"\xff\x00url(x)")), (4, None, BASE, None, None)]
    df = spark.createDataFrame(rows, "id bigint, uri string, archived_date timestamp, content_type string, body binary")
    got = {r["id"]: r["body"] for r in view.viewed(df, "https://archive.test/view").collect()}
    assert b"__archiveGuarded" in got[1] and b"uri=https%3A%2F%2Fa.test%2Fb" in got[1] and b"uri=https%3A%2F%2Fa.test%2Fi.png" in got[2] and bytes(got[3]) == b"\xff\x00url(x)" and got.get(4) is None
    parts = {r["id"]: (r["status"], r["part"]) for r in view.ranged(df.select("id", "body").where("id = 3"), "bytes=1-3").collect()}
    assert parts == {3: (206, b"\x00ur")}


def test_ledger(spark):
    captures = spark.createDataFrame([(1, 0, 10, 100), (2, 10, 10, 100), (3, None, None, 100), (4, 95, 10, 100), (5, 0, 10, None), (6, 20, 10, 100)], "id bigint, byte_offset bigint, byte_length bigint, file_size bigint")
    asked = spark.createDataFrame([("x", n, i) for n, i in enumerate([1, 9, 3, 4, 5, 2, 6, 1])] + [("y", 0, 6)], "export_id string, ordinal int, id bigint")
    got = {(r["export_id"], r["ordinal"]): r["status"] for r in view.ledger(asked, captures, 2, 1000).collect()}
    assert [got["x", n] for n in range(8)] == ["stored", "not-found", "no-payload", "short-read", "short-read", "stored", "over-budget", "over-budget"] and got["y", 0] == "stored"
    by_bytes = {r["ordinal"]: r["status"] for r in view.ledger(asked.where("export_id = 'x'"), captures, 99, 15).collect()}
    assert by_bytes[0] == "stored" and by_bytes[5] == "over-budget"


def test_bundle_links_what_it_holds(spark, tmp_path):
    rows = [
        (1, "https://a.test/", "text/html", 200, "f.warc", "u1", "<link rel=stylesheet href=/s.css><a href='/b?x=1#t'>b</a><a href=/lost>l</a>"),
        (2, "https://a.test/s.css", "text/css", 200, "f.warc", "u2", "a{b:url(i.svg)} url(https://else.test/x)"),
        (3, "https://a.test/i.svg", "image/svg+xml", 200, "f.warc", "u3", "<svg/>"),
        (4, "https://a.test/b?x=1", "text/html", 200, "f.warc", "u4", None),
    ]
    df = spark.createDataFrame(rows, "id bigint, url string, content_type string, status int, archive string, uuid string, body string")
    bundled = view.bundle(df)
    got = {r["path"]: r["body"] for r in bundled.collect()}
    assert got["a.test/s.css"] == "a{b:url(i.svg)} url(https://else.test/x)"
    index = got["a.test/index.html"]
    other = next(p for p in got if p.startswith("a.test/b"))
    assert 'href="s.css"' in index and f"href='{other.split('/', 1)[1]}#t'" in index and 'href="https://a.test/lost"' in index
    ledger = view.write_bundles(bundled, f"file://{tmp_path}/out").collect()
    assert [(r["export_id"], r["entries"], r["duplicates"]) for r in ledger] == [("bundle", 3, 0)]
    with zipfile.ZipFile(tmp_path / "out" / "bundle.zip") as z:
        assert z.testzip() is None and z.namelist()[-1] == "manifest.json" and z.namelist()[:-1] == sorted(z.namelist()[:-1])
        assert z.read("a.test/s.css").decode() == got["a.test/s.css"] and ledger[0]["bytes"] == (tmp_path / "out" / "bundle.zip").stat().st_size
        assert {x["status"] for x in json.loads(z.read("manifest.json"))} == {"stored", "no-payload"}


def test_redirects_lead_on_and_equal_bodies_are_stored_once(spark):
    rows = [
        (1, "x", "https://a.test/", "text/html", 200, "<img src=/i.png><img src=/j.png><a href=/old>o</a>", None, "d1"),
        (2, "x", "https://a.test/i.png", "image/png", 200, "png", None, "d2"), (3, "x", "https://a.test/j.png", "image/png", 200, "png", None, "d2"),
        (4, "x", "https://a.test/old", "text/html", 301, "moved", "/", None), (5, "x", "https://a.test/gone", "text/html", 302, "left", "https://b.test/", None),
        (6, "y", "https://a.test/j.png", "image/png", 200, "png", None, "d2"), (7, None, "https://a.test/k.png", "image/png", 200, None, None, None),
    ]
    df = spark.createDataFrame([(*r[:5], "f.warc", f"u{r[0]}", *r[5:]) for r in rows], "id bigint, export_id string, url string, content_type string, status int, archive string, uuid string, body string, location string, digest string")
    got = {(r["export_id"], r["path"]): r["body"] for r in view.bundle(df).collect()}
    assert set(got) == {("x", "a.test/index.html"), ("x", "a.test/i.png"), ("x", "a.test/old.html"), ("x", "a.test/gone.html"), ("y", "a.test/j.png"), (None, "a.test/k.png")}
    assert got["x", "a.test/index.html"].count('src="i.png"') == 2 and "url=index.html" in got["x", "a.test/old.html"] and got["x", "a.test/gone.html"] == "left"
    assert view.bundle(df.limit(0)).collect() == []


def test_small_pieces(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(b"12345")
    (tmp_path / "b.txt").write_bytes(b"1")
    assert tuple(files.folder_stats(spark, str(tmp_path)).first()) == (1, 5)
    df = spark.createDataFrame([('{"a": 1, "b": "c"}',), ("no json",), (None,)], "t string")
    assert [dict(r[0]) for r in df.select(N.json_object("t")).collect()] == [{"a": "1", "b": "c"}, {"raw": "no json"}, {}]
    shape = "record_id bigint, status int, headers map<string,string>, last_modified timestamp, content_type_id bigint"
    old = spark.createDataFrame([(1, 200, {"a": "1"}, BASE, 5), (2, 404, None, None, None)], shape)
    new = spark.createDataFrame([(1, 301, {"a": "2", "b": "3"}, None, None), (3, 200, {}, None, 7)], shape)
    got = {r["record_id"]: (r["status"], r["headers"], r["last_modified"], r["content_type_id"]) for r in ingest.refreshed_responses(old, new).orderBy("record_id").collect()}
    assert got == {1: (301, {"a": "2", "b": "3"}, BASE, 5), 2: (404, {}, None, None), 3: (200, {}, None, 7)}
    assert df.agg(F.count("*")).first()[0] == 3
