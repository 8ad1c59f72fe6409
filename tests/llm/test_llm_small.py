"""Formatting copies, chunk deduplication and look-alikes: brute force and edge cases."""

import random
import shutil
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from archivolt.llm import canonical, chunks, lookalikes

# -- problem 1 ---------------------------------------------------------------------


def canon(uri):
    keep = lambda s: "".join(c.casefold() for c in s if unicodedata.category(c)[0] in "LNM")
    bare, _, fragment = uri.partition("#")
    path, _, query = bare.partition("?")
    fields = sorted(f for f in (keep(x) for x in query.replace(";", "&").split("&")) if f)
    return (keep(path), tuple(fields), keep(fragment)) if fields else (keep(path) + keep(fragment), (), "")


def pairs_of(rows):
    first, out = {}, set()
    for i, u in sorted({(i, u) for i, u in rows if i is not None and u is not None}):
        k = canon(u)
        if k in first and first[k] < i:
            out.add((first[k], i))
        first.setdefault(k, i)
    return out


uris = st.text(alphabet="aB1é?&;=#/ \n-ßI", max_size=14)


@settings(max_examples=400, deadline=None)
@given(uris, uris)
def test_hash_and_comparison_agree_with_the_definition(a, b):
    words = canonical.part_hashes([a, b])
    assert canonical.same_text(a, b) == (canon(a) == canon(b))
    assert (words[0] == words[1]).all() == (canon(a) == canon(b))


def test_copies_match_brute_force(spark):
    rng = random.Random(1)
    base = ["https://a.test/x?b=1&c=2", "https://a.test/x?b=1&c=3", "http://a.test/größe/#top", "https://www.a.test/x?c=2&b=1", "", "https://a.test/" + "long/" * 3000]

    def vary(u):
        path, _, query = u.partition("?")
        fields = query.split("&")
        rng.shuffle(fields)
        u = rng.choice([path + ("?" + "&".join(fields) if query else ""), u])
        u = rng.choice([u, u.upper(), f" {u}\r\n", f"<{u}>,", u.replace("/", "//"), u.replace("&", ";"), u + "&", " " + u])
        return u

    rows = [(i, vary(rng.choice(base))) for i in range(400)] + [(5, None), (None, base[0]), (7, base[1])]
    df = spark.createDataFrame([(i, u, "z", "y") for i, u in rows], "id bigint, uri string, h0 string, text string")
    got = {tuple(r) for r in canonical.formatting_copies(df, "id", "uri").collect()}
    clean = [(i, u) for i, u in rows if i != 7]
    assert {p for p in got if 7 not in p} == {p for p in pairs_of(clean) if 7 not in p}
    counts = canonical.collapsed(df.where("id <> 7"), "id", "uri")
    assert counts.agg(F.sum("copies")).first()[0] == 399 and counts.count() == len({canon(u) for _, u in clean if _ is not None and u is not None})
    assert canonical.formatting_copies(df.limit(0), "id", "uri").collect() == []


def test_collisions_are_resolved(spark, monkeypatch):
    real = canonical.part_hashes

    def weak(texts, uri=True, seed=0):  # one value for all texts, in the first round
        return np.zeros((len(texts), 2), np.uint64) if seed == 0 else real(texts, uri, seed)

    rows = [(1, "a"), (2, "b"), (3, "A "), (4, "B"), (5, "c")]
    df = spark.createDataFrame(rows, "id bigint, uri string")
    original = canonical.hashed

    def hashed(rest, uri, seed):
        out = original(rest, uri, seed)
        return out.withColumn("h0", F.lit(0).cast("bigint")).withColumn("h1", F.lit(0).cast("bigint")) if seed == 0 else out

    monkeypatch.setattr(canonical, "hashed", hashed)
    assert {tuple(r) for r in canonical.formatting_copies(df, "id", "uri").collect()} == {(1, 3), (2, 4)}
    assert weak(["a", "b"])[0].tolist() == [0, 0]


# -- problem 4 -----------------------------------------------------------------------


def test_rolling_hash_is_the_window_sum():
    data = np.frombuffer(random.Random(2).randbytes(300), np.uint8)
    h = chunks.rolling(data)
    for i in (0, 5, 31, 32, 250):
        want = 0
        for k in range(min(32, i + 1)):
            want += int(chunks.GEAR[data[i - k]]) << k
        assert int(h[i]) == want % 2**64


def test_boundaries_cover_and_survive_an_insertion():
    raw = random.Random(3).randbytes(60_000)
    shifted = raw[:20_000] + b"inserted" + raw[20_000:]
    cut = lambda b: chunks.boundaries(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]), 256, 1024, 4096)[0]
    pieces = lambda b: [b[i:j] for i, j in zip([0, *cut(b)[:-1]], cut(b), strict=True)]
    a, b = pieces(raw), pieces(shifted)
    assert b"".join(a) == raw and all(256 <= len(x) <= 4096 for x in a[:-1])
    assert sum(len(x) for x in b if x in set(a)) > 0.9 * len(raw)


def test_store_judges_batches_like_one_pass(spark, tmp_path):
    rng = random.Random(5)
    blocks = [rng.randbytes(3000) for _ in range(12)]
    rows = [(i, b"".join(rng.choice(blocks) for _ in range(rng.randrange(1, 5)))) for i in range(60)] + [(60, b""), (61, None), (62, blocks[0][:10]), (63, blocks[0][:10]), (None, blocks[1])]
    df = spark.createDataFrame([(i, b, "x") for i, b in rows], "row_id bigint, body binary, chunk string")
    whole = chunks.chunk_rows(df, "row_id", "body")
    once = {r["id"]: (r["bytes"], r["shared"], r["first_id"]) for r in chunks.coverage(whole, chunks.first_holders(whole)).collect()}
    assert 60 not in once and 61 not in once and once[63] == (10, 10, 62) and once[0][1] == 0 or once[0][2] is None
    store, stepwise = chunks.ChunkStore(spark, str(tmp_path / "store")), {}
    for n, (low, high) in enumerate([(0, 20), (20, 21), (21, 64)]):
        part = chunks.chunk_rows(df.where((F.col("row_id") >= low) & (F.col("row_id") < high)), "row_id", "body")
        stepwise |= {r["id"]: (r["bytes"], r["shared"], r["first_id"]) for r in store.judge(part).collect()}
        for _ in range(2):  # a batch accepted twice changes nothing
            store.accept(part, f"{n}")
    assert stepwise == once


@pytest.mark.parametrize(
    "text",
    ["sha1:AAAQEAYEAUDAOCAJBIFQYDIOB4IBCEQT", " SHA-1: aaaqeayeaudaocajbifqydiob4ibceqt\n", '"urn:sha1:000102030405060708090a0b0c0d0e0f10111213"', "000102030405060708090A0B0C0D0E0F10111213", "sha1=AAECAwQFBgcICQoLDA0ODxAREhM=", "AAAQEAYEAUDAOCAJBIFQYDIOB4IBCEQT"],
)
def test_digests_of_one_value(text):
    assert chunks.digest_value(text) == b"sha1:" + bytes(range(20))


def test_digests_that_say_nothing():
    assert [chunks.digest_value(x) for x in (None, "", "sha1:", "md5:xyz", "sha1:0001", "crc32:00000000")] == [None] * 6
    assert chunks.digest_value("md5:" + "0" * 32) != chunks.digest_value("sha1:" + "0" * 40)


def test_file_places():
    same = ["/a/b c/d.warc", " /a/b%20c/d.WARC\t", "file:///a//b c/./d.warc", "\\a\\b c\\d.warc", "/a/x/../b c/d.warc", "//a/b c/d.warc", "file:////a/b c/d.warc", "file://\\a\\b c\\d.warc", "file:/a/b c/d.warc"]
    assert len({chunks.file_place(x) for x in same}) == 1
    assert len({chunks.file_place(x) for x in ("/a/d.warc", "/a/old/d.warc", "/mnt/a/d.warc", "/a/d-1.warc")}) == 4 and chunks.file_place(" ") is None is chunks.file_place(None)


def test_same_payload_is_carried_on(spark):
    d = [f"sha1:{n:040x}" for n in range(9)]
    rows = [(1, "/f", 0, 5, d[1]), (2, "/F", 0, 5, None), (3, "/g", 9, 9, d[2]), (4, "file:///f", 0, 5, d[3]), (5, "/h", 1, 1, d[3].upper()), (6, "/g", 9, 8, None), (7, None, 9, 9, None), (8, "/g", None, 9, " "), (9, "/g", 9, 9, None), (9, "/g", 9, 9, None), (None, "/f", 0, 5, d[1]), (10, "/" + "x" * 9000, 1, 1, None), (11, "/" + "X" * 9000, 1, 1, None), (12, "/" + "x" * 9000 + "y", 1, 1, None)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "row_id bigint, file_path string, payload_byte_offset bigint, payload_byte_length bigint, payload_digest string, chunk string, label string")
    assert {tuple(r) for r in chunks.same_payload(df).collect()} == {(1, 2), (1, 4), (1, 5), (3, 9), (10, 11)}
    assert chunks.same_payload(df.limit(0)).collect() == []
    split = df.withColumn("batch_id", F.when(F.col("row_id") > 3, F.col("row_id") % 3 + 1))  # nulls, and ids that do not rise with the batch
    assert {tuple(r) for r in chunks.same_payload(split).collect()} == {(1, 2), (1, 4), (1, 5), (3, 9), (10, 11)}


def test_batches_match_brute_force_and_leave_history_alone(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, f"/f{rng.randrange(9)}", rng.randrange(4), 5, f"sha1:{rng.randrange(60):040x}", i // 25) for i in range(100)]
    above = list(range(100))
    for i, (_, f, o, _, d, _) in enumerate(rows):
        for j in range(i):
            if rows[j][4] == d or (rows[j][1], rows[j][2]) == (f, o):
                a, b = above[i], above[j]
                above = [min(a, b) if x in (a, b) else x for x in above]
    columns = "row_id bigint, file_path string, payload_byte_offset bigint, payload_byte_length bigint, payload_digest string, batch_id int"
    df = spark.createDataFrame(rows, columns)
    want = {(k, i) for i, k in enumerate(above) if k < i}
    assert {tuple(r) for r in chunks.same_payload(df).collect()} == want
    store = chunks.ChunkStore(spark, str(tmp_path / "s"))
    for n in range(4):
        folder = str(tmp_path / f"in{n}")
        chunks.chunk_rows(chunks.payload_evidence(df.where(f"batch_id = {n}")), "id", "evidence", *chunks.EVIDENCE_CHUNKS).write.parquet(folder)
        for _ in range(1 + n % 2):  # a batch taken twice changes nothing
            chunks.take_batch(spark.read.parquet(folder), store, f"{n}")
        shutil.rmtree(folder)  # nothing of an accepted batch is read again but the table
    assert {(r["low"], r["high"]) for r in chunks.resolved(store.links()).collect()} == want
    assert store.holders().groupBy("chunk", "key").count().where("count > 1").count() == 0


def test_every_stage_of_same_payload_counts(spark, monkeypatch):
    d = [f"sha1:{n:040x}" for n in range(9)]
    rows = [(1, "/f", 0, 5, d[1], 1), (2, "/g", 0, 5, d[2], 1), (3, "/F", 0, 5, d[2].upper(), 2), (4, "/h", 7, 7, d[2], 2), (5, "/h", 7, 7, None, 3), (6, "/k", 1, 1, d[5], 3)]
    df = spark.createDataFrame(rows, "row_id bigint, file_path string, payload_byte_offset bigint, payload_byte_length bigint, payload_digest string, batch_id int")
    got = lambda: {tuple(r) for r in chunks.same_payload(df).collect()}
    cut = chunks.chunk_rows(chunks.payload_evidence(df), "id", "evidence", *chunks.EVIDENCE_CHUNKS).select("id", "chunk", "key").collect()
    monkeypatch.delattr(chunks, "chunk_rows")  # evidence is never cut
    assert got() == {(1, 2), (1, 3), (1, 4), (1, 5)}
    assert sorted(cut) == sorted(chunks.evidence_rows(df, "batch_id").drop("batch_id").collect())  # tables written before stay valid
    none = lambda self, first, but=None: first.where("false").select("chunk", "key", F.lit(None).cast("bigint").alias("first_id"))
    for owner, name, instead in [(chunks.ChunkStore, "known", none), (chunks.ChunkStore, "append", lambda self, rows, batch: None), (chunks, "resolved", lambda links: links)]:
        with monkeypatch.context() as without:
            without.setattr(owner, name, instead)
            assert got() != {(1, 2), (1, 3), (1, 4), (1, 5)}, name


def test_long_chains_are_resolved(spark):
    order = list(range(60))
    random.Random(2).shuffle(order)
    links = spark.createDataFrame([(max(a, b), min(a, b)) for a, b in zip(order, order[1:])] + [(99, 98)], chunks.LINKS)
    assert {tuple(r) for r in chunks.resolved(links).collect()} == {(i, 0) for i in range(1, 60)} | {(99, 98)}
    assert chunks.resolved(links.limit(0)).collect() == []


def test_near_duplicates_recall_against_shingles(spark):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in "stone river paper lantern orchard bridge".split() for b in "ing er ly s ed y".split()]
    texts = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randrange(500, 1500))]
        texts.append(" ".join(base))
        for _ in range(2):
            near = list(base)
            for _ in range(rng.randrange(1, 3)):
                at = rng.randrange(len(near))
                near[at : at + rng.randrange(2)] = [rng.choice(words)]
            texts.append(" ".join(near))
    shingles = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    near = lambda i, j: len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j])
    want = {i for i in range(len(texts)) if any(near(i, j) for j in range(i))}
    df = spark.createDataFrame(list(enumerate(texts)), "i bigint, t string")
    rows = chunks.chunk_rows(df, "i", "t", *chunks.NEAR_CHUNKS)
    got = {r["id"]: r["first_id"] for r in chunks.near_duplicates(rows, chunks.first_holders(rows)).collect()}
    assert len(want) > 100 and len(want & set(got)) >= 0.9 * len(want) and set(got) <= want
    assert all(near(i, j) for i, j in got.items())


# -- problem 10 -------------------------------------------------------------------------

SAME = [
    ("office ﬁne", "ofﬁce fine"), ("Ａ１，", "A1,"), ("été", "été"), ("a b c", "a b c"), ("co­op​﻿", "coop"), ("x‑y", "x-y"), ("Раrіѕ", "Paris"), ("Ελλάδα ο", "Eλλάδα o"),
    ("K", "K"), ("օ", "o"), ("w‍x", "wx"), ("ё", "ë"), ("ё", "ë"), ("ό", "ó"), ("　", " "), ("ｶ", "カ"),
]
DIFFERENT = [("10²", "102"), ("½", "1/2"), ("№", "No"), ("café", "cafe"), ("a\nb", "a b"), ("a b", "a  b"), ("👩‍🌾", "👩🌾"), ("—", "-"), ("a", "A"), ("ı", "i"), ("l", "1"), ("°C", "C"), ("в", "b")]


def forms(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r["text"] for r in sorted(lookalikes.canonical_texts(df, "i", "t").collect(), key=lambda r: r["id"])]


def test_forms(spark):
    flat = forms(spark, [x for pair in SAME + DIFFERENT for x in pair])
    for i, (a, b) in enumerate(SAME + DIFFERENT):
        assert (flat[2 * i] == flat[2 * i + 1]) == (i < len(SAME)), (a, b)
    assert forms(spark, [None, "", "plain"]) == [None, "", "plain"]
    once = forms(spark, [a for a, _ in SAME + DIFFERENT])
    assert forms(spark, once) == once


def test_character_map_by_rule():
    mapping = lookalikes.character_map()
    for c, to in mapping.items():
        assert len(c) == len(to) == 1 and mapping.get(to, to) == to, (c, to)
    assert all(mapping[chr(0xFEE0 + i)] == chr(i) for i in range(33, 127))


def test_pairs_match_brute_force(spark):
    rng = random.Random(6)
    bank = [x for pair in SAME for x in pair] + [x for pair in DIFFERENT for x in pair] + [" ", "​", "  ", "y" * 50_000 + "é", "y" * 50_000 + "é"]
    rows = [(i, rng.choice(bank)) for i in range(260)] + [(900, None), (901, ""), (None, bank[0])]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id bigint, body string, look string, raw string")
    keys = lookalikes.form_keys(df, "doc_id", "body")
    flat = dict(zip([i for i, _ in rows], forms(spark, [t for _, t in rows]), strict=True))
    live = [(i, t) for i, t in rows if i is not None and t is not None and flat[i].strip()]
    want = {(i, j) for i, t in live for j, u in live if i < j and t != u and flat[i] == flat[j]}
    assert {tuple(r) for r in lookalikes.lookalike_pairs(keys).collect()} == want
    classes = lookalikes.look_classes(keys.where("id is not null")).collect()
    assert all(r["class_id"] == min(i for i, _ in live if flat[i] == flat[r["id"]]) for r in classes) and len(classes) == len(live)
    assert lookalikes.lookalike_pairs(lookalikes.form_keys(df.limit(0), "doc_id", "body")).collect() == []
