"""Truth tables of the scalar functions."""

import zlib

import pytest
from pyspark.sql import functions as F

from archivolt.functions import codec, paths, web
from archivolt.functions import native as N


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v")).alias("x")).collect()]


def test_content_types(spark):
    values = ["Text/HTML; charset=utf-8", " text/css ", "", None, ";x", 'a/b;Charset = "ISO 8859"; q=1']
    assert column(spark, values, N.content_type_base) == ["text/html", "text/css", None, None, None, "a/b"]
    assert column(spark, values, N.content_type_charset) == ["utf-8", None, None, None, None, "iso8859"]
    assert column(spark, values, N.document_kind) == ["html", "css", "other", "other", "other", "other"]
    assert column(spark, ["a; b ;c"], N.joined_content_type) == ["a; b; c"]


def test_recursion_level(spark):
    values = ["https://a.test", "https://a.test/", "https://a.test/b", "https://a.test/b/", "HTTP://a.test/b/c?x=/d", "a.test/b", "https://a.test//b///c", "https://a.test/#/x/y", None, "https://a.test?q=/1/2"]
    assert column(spark, values, N.recursion_level) == [0, 0, 1, 1, 2, 1, 2, 0, 0, 0]


def test_fragments(spark):
    values = ["https://a.test/#x#y", "https://a.test/#", "https://a.test/", None]
    assert column(spark, values, N.strip_fragment) == ["https://a.test/", "https://a.test/", "https://a.test/", None]
    assert column(spark, values, N.fragment_of) == ["#x#y", "", "", None]


def test_locations(spark):
    uri = F.lit("https://a.test:8080/b/c?d")
    assert column(spark, ["//x.test/y", "/y", "https://z.test/", "y", None], lambda c: N.resolve_location(c, uri)) == ["https://x.test/y", "https://a.test:8080/y", "https://z.test/", "https://a.test:8080/y", None]


def test_headers_and_codings(spark):
    df = spark.createDataFrame([({"Content-TYPE": "a", "x": "b"},), ({"content-type": "c", "Content-Type": "d"},), (None,), ({},)], "h map<string,string>")
    assert [r[0] for r in df.select(N.header("h", "Content-Type")).collect()] == ["a", "d", None, None]
    assert column(spark, ["gzip, Chunked", "chunked", "gzip", None], N.is_chunked) == [True, True, False, False]


def test_ranges(spark):
    got = column(spark, ["bytes=0-9", "bytes=90-", "bytes=-10", "bytes=-1000", "bytes=100-", "bytes=5-2", "bytes=-0", "bytes=-", "bytes=0-1,2-3", None], lambda c: N.byte_range(c, F.lit(100)))
    assert [tuple(x) for x in got] == [(206, 0, 9), (206, 90, 99), (206, 90, 99), (206, 0, 99), (416, None, None), (416, None, None), (416, None, None), (200, 0, 99), (200, 0, 99), (200, 0, 99)]


def test_chunk_ranges_point_at_the_data(spark):
    body = b"4\r\nWiki\r\n5\r\npedia\r\n10\r\n0123456789abcdef\r\n0\r\n\r\n"
    (ranges,) = column(spark, [[4, 5, 16]], N.chunk_ranges, "array<bigint>")
    assert b"".join(body[r["start"] : r["start"] + r["length"]] for r in ranges) == b"Wikipedia0123456789abcdef" == codec.dechunk(body)
    assert column(spark, ["{1,2,0,x}", "[3, 4]", ""], N.chunk_sizes) == [[1, 2], [3, 4], []]


def test_uuid_and_target(spark):
    assert column(spark, ["<urn:uuid:7C52EA2B-bbe1-4301-aa10-dfe1fbd19c53>", "x", None], N.record_uuid) == ["7c52ea2b-bbe1-4301-aa10-dfe1fbd19c53", None, None]
    assert column(spark, ["<https://a.test/>", " https://a.test/ ", "<>", None], N.target_uri) == ["https://a.test/", "https://a.test/", None, None]


def test_content_encodings():
    body = b"hello world" * 20
    packed = zlib.compressobj(9, zlib.DEFLATED, 31)
    gz = packed.compress(body) + packed.flush()
    for name, data in (("gzip", gz), ("x-gzip", gz), (" GZIP ", gz), ("deflate", zlib.compress(body)), ("identity", body), (None, body), ("br", body), ("gzip", body)):
        assert codec.decode_content(data, name) == body


def test_entities():
    assert web.decode_entities("a&amp;b&#38;c&#x26;d&lt;&quot;&apos;&nbsp;") == "a&b&c&d<\"' "
    assert web.decode_entities("a&&&amp;;&#x;&#12x;&#;&") == "a&&&;&#x;&#12x;&#;&"
    assert web.decode_entities("&amp;lt; &bogus; &#xD800; &#1114112; &amp &#0;") == "&lt; &bogus; &#xD800; &#1114112; &amp &#0;"


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("../x", "https://site.test/x"), ("y?q=1#f", "https://site.test/a/y?q=1#f"), ("//CDN.test/z", "https://cdn.test/z"), ("/r/./s/../t", "https://site.test/r/t"), ("?q", "https://site.test/a/b?q"),
        ("", "https://site.test/a/b?c=d"), ("http://x.test:80", "http://x.test/"), ("https:\\\\x.test\\y", "https://x.test/y"), ("mailto:a@b.test", "mailto:a@b.test"), (" \thttps://x.test/a b ", "https://x.test/a%20b"),
        ("https://bücher.test/ü", "https://xn--bcher-kva.test/%C3%BC"), ("http://", None), ("#f", "https://site.test/a/b?c=d#f"), ("/a&amp;b", "https://site.test/a&b"),
    ],
)
def test_absolute(raw, want):
    assert web.absolute(raw, "https://site.test/a/b?c=d") == want


def test_archived_links():
    page, api = "https://site.test/a", "https://archive.test/view"
    link = lambda raw: web.archived_href(raw, page, "2024-01-01", api)
    assert link(None) is None and link("") is None
    for raw in ("data:image/png;base64,a&amp;b", "mailto:x@y.test", "javascript:void(0)", "https://archive.test/view?uri=x"):
        assert link(raw) == raw
    assert link("#top") == "#top" and link("https://site.test/a#top") == "#top"
    assert link("/b?x=1&amp;y=2#z") == "https://archive.test/view?uri=https%3A%2F%2Fsite.test%2Fb%3Fx%3D1%26y%3D2&dateNear=2024-01-01&apiUri=https%3A%2F%2Farchive.test%2Fview&preventDefault=#z"


def test_css_and_srcset():
    mark = lambda u: f"X({u})"
    assert web.rewrite_css("a{b:url( 'c.png' )} @import \"d.css\"; url(data:x) url(e)", mark) == "a{b:url('X(c.png)')} @import \"X(d.css)\"; url(data:x) url(X(e))"
    assert web.rewrite_srcset("a.png 1x, b.png 2x , ", mark) == "X(a.png) 1x, X(b.png) 2x"


def test_html_is_kept_to_the_letter_but_for_links():
    page = "<!DOCTYPE html>\n<HTML><head>\n<base href='/x/'><link rel=stylesheet href=a.css><style>b{c:url(d)}</style><script>var e='<a href=\"f\">'</script></head><body  id=g><!-- <a href=h> --><img src='i' srcset=\"j 1x\" alt='>'><a href=\"#k\">l</a><meta http-equiv=refresh content='5; url=m'></body>"
    same = web.rewrite_html(page, lambda u: u, base=False)
    assert same == page
    new = web.rewrite_html(page, lambda u: f"/{u}", guard="<G>")
    assert "<base" not in new and 'href="/a.css"' in new and "url(/d)" in new and "var e='<a href=\"f\">'" in new and "<a href=h>" in new and "src='/i'" in new and 'srcset="/j 1x"' in new and 'href="#k"' in new and "url=/m" in new and "<head><G>" in new
    assert web.rewrite_html("<p>x", lambda u: u, guard="<G>") == "<G><p>x"


def test_references():
    page = "<base href='https://cdn.test/q/'><link rel='shortcut icon' href=f.ico><link rel=canonical href=no><img src=a.png data-src='b.png' srcset='c.png 1x, d.png 2x'><div style=\"x:url(&quot;e.png&quot;)\"><a href=no><img src='data:z'><style>@import 's.css'</style>"
    assert [u.rsplit("/", 1)[-1] for _, u in web.references(page, "html", "https://site.test/")] == ["f.ico", "a.png", "b.png", "c.png", "d.png", "e.png", "s.css"]
    assert web.references("url(a) url('b')", "css", "https://site.test/c/d.css") == [("url", "https://site.test/c/a"), ("url", "https://site.test/c/b")]


def evaluated(spark, rows, expression):
    """The expression over columns a, b, c of ``rows``, in order."""
    df = spark.createDataFrame([(i, *r, *[None] * (3 - len(r))) for i, r in enumerate(rows)], "i int, a string, b string, c string")
    return [r["v"] for r in df.select("i", expression.alias("v")).orderBy("i").collect()]


def test_paths_in_archives(spark):
    long = "https://site.test/" + "/".join(["s" * 90] * 4)
    given = {
        ("https://Site.test/a/b", "text/html; x"): "site.test/a/b.html", ("https://site.test/", "text/css"): "site.test/index.css", ("https://site.test/a/", None): "site.test/a/index.html",
        ("https://u@site.test:81/a.HTM", "text/html"): "site.test/a.HTM", ("https://site.test/%2e%2e/%2e%2e/x/con", ""): "site.test/x/_con", ("https://site.test/a+b%20c", ""): "site.test/a+b c",
        ("https://site.test/100%", "TEXT/HTML"): "site.test/100%.html", ("not a url", "text/html"): "_unparsed/not a url", ("https://site.test/a:b. ", ""): "site.test/a_b", (None, "x"): None,
    }
    assert evaluated(spark, given, paths.zip_path("a", "b")) == list(given.values())
    assert evaluated(spark, [("",), ("a",), ("é😀",)], paths.short_hash("a")) == ["811c9dc5", "e40c292c", fnv("é😀")]
    asked, deep = evaluated(spark, [("https://site.test/a.htm?p=2", "text/html"), (long, "text/html")], paths.zip_path("a", "b"))
    assert asked == f"site.test/a__q{fnv('p=2')}.htm" and len(deep) <= 180 and deep.startswith("site.test/_deep/")
    assert all(len(x) == 96 and x.endswith(f"~{fnv('y' * 300 + '.png')}.png") for x in evaluated(spark, [("y" * 300 + ".png",)], paths.safe_segment("a")))
    assert web.relative_path("a/b/c.html", "a/d/e.css") == "../d/e.css" and web.relative_path("a/b.html", "a/b.html") == "b.html"
    assert 'content="0; url=../a%20b.html"' in web.redirect_stub("../a b.html")


def fnv(text):
    h, data = 0x811C9DC5, text.encode("utf-16-le")
    for low, high in zip(data[::2], data[1::2], strict=True):
        h = (h ^ (high << 8 | low)) * 0x01000193 % (1 << 32)
    return f"{h:08x}"


def test_entry_paths(spark):
    given = {("https://site.test/a/b.html?x=1", "id"): "site.test/a/b--x-1.id.html", ("https://site.test", "f::u/x::1"): "site.test/index.f-u-x-1.html", ("https://Site.test:81/a/", "i"): "site.test-81/a.i.html", ("not a url at all", "i"): "unknown-host/index.i.html", (None, "i"): None}
    assert evaluated(spark, given, paths.entry_path("a", "b")) == list(given.values())
    hostile = ["../../../etc/passwd", "..%2f..%2fetc%2fpasswd", "a/../../b", "%2e%2e/%2e%2e/x", "a/./../b", "C:\\Windows\\system32", "a\0b", "/////", "x" * 500 + ".html"]
    for path in evaluated(spark, [(f"https://example.test/{h}", "id") for h in hostile], paths.entry_path("a", "b")):
        assert not set(path) & set("\\:\0") and not {"", ".", ".."} & set(path.split("/")) and len(path) < 200


def test_paths_are_told_apart_by_record(spark):
    rows = [("a/b.html", "x/y.WARC.gz", "<urn:uuid:1-2>"), ("b", "y.arc", None), ("a/b.html", None, "u/../v"), ("h/" + "d" * 60 + "/" + "s" * 90 + ".html", "z" * 40, "1" * 36), ("h/" + "d/" * 80 + "s.html", "y.warc", "1" * 36)]
    got = evaluated(spark, rows, paths.with_record("a", "b", "c"))
    assert got[:3] == ["a/b.x_y.1-2.html", "b.y.unknown", "a/b..u_.._v.html"] or got[:3] == ["a/b.x_y.1-2.html", "b.y.unknown", "a/b._.u_.._v.html"]
    assert all(len(p) <= 180 for p in got) and got[3].startswith("h/ddd") and got[4].startswith("h/_deep/")


def test_navigation_rewrite():
    assert web.rewrite_navigation("parent.location='/a'; globalThis.location.replace('/b'); location.reload(); my.location = 1; var location = 2; x.location.href = 3") == "window.__archiveNavigate('/a'); window.__archiveNavigate('/b'); void (); my.location = 1; var location = 2; x.location.href = 3"
    assert web.rewrite_html("<script>location.href='/a';</script>", lambda u: u, scripts=True) == "<script>window.__archiveNavigate('/a');</script>"
    assert web.rewrite_navigation("window.location = '/a'; location.href='/b'; location.replace('/c'); if (location == 1) {}") == "window.__archiveNavigate('/a'); window.__archiveNavigate('/b'); window.__archiveNavigate('/c'); if (location == 1) {}"
