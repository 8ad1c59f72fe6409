"""Token counts, prefix sums, packing and mixing."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from archivolt.llm import mixing, packing, queries, tokens
from archivolt.llm.ordinals import prefix_sums
from archivolt.plans.runtime import cut


@pytest.fixture(scope="module")
def counter():
    return tokens.Counter(tokens.default_tokenizer())


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=" \n\t ab1é!'s漢🌾", max_size=24))
def test_cached_counts_are_exact(text):
    c = test_cached_counts_are_exact.counter = getattr(test_cached_counts_are_exact, "counter", None) or tokens.Counter(tokens.default_tokenizer())
    assert c.count(text) == len(c.encode(text))


def test_cache_is_emptied_not_wrong(counter, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_UNITS", 3)
    text = "one two three four five six seven two three"
    assert counter.count(text) == len(counter.encode(text)) and len(counter.units) <= 3


def test_counts_leave_out_empty_texts(spark, counter):
    df = spark.createDataFrame([(1, "a b"), (2, ""), (3, None), (4, " "), (5, "word " * 40_000)], "i bigint, t string")
    got = {r["i"]: r["n_tokens"] for r in tokens.token_counts(df, "t", ["i"]).collect()}
    assert set(got) == {1, 4, 5} and got[5] == len(counter.encode("word " * 40_000))


def test_prefix_sums_within_groups(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 5 + ["cold", "c"]), rng.randrange(100)) for _ in range(4000)]
    fixed = cut(spark.createDataFrame(rows, "g string, v bigint").repartition(7))
    got = prefix_sums(fixed, "g", "v").collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["g"], r["before"], r["v"])):
        by.setdefault(r["g"], []).append((r["before"], r["v"]))
    for g, values in by.items():
        total = 0
        for before, v in sorted(values):
            if v:
                assert before == total
            total += v
        assert total == sum(v for k, v in rows if k == g)
    assert prefix_sums(cut(fixed.limit(0)), "g", "v").collect() == []


def padding(bounds, sizes, counts):
    return int(((bounds[np.searchsorted(bounds, sizes)] - sizes) * counts).sum())


def test_bucket_bounds_are_optimal():
    import itertools

    rng = np.random.default_rng(1)
    for _ in range(30):
        sizes = np.sort(rng.choice(np.arange(1, 60), 9, replace=False))
        counts = rng.integers(1, 20, 9)
        best = min(padding(np.array([*c, sizes[-1]]), sizes, counts) for c in itertools.combinations(sizes[:-1], 2))
        assert padding(packing.bucket_bounds(sizes, counts, 3), sizes, counts) == best


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 64), st.integers(1, 30)), min_size=1, max_size=20, unique_by=lambda x: x[0]), st.integers(2, 20))
def test_batch_plan_places_everything_within_capacity(histogram, buckets):
    sizes, counts = (np.array(x) for x in zip(*sorted(histogram), strict=True))
    bounds = packing.bucket_bounds(sizes, counts, buckets)
    total = np.bincount(np.searchsorted(bounds, sizes), weights=counts, minlength=len(bounds)).astype(int)
    segments, containers = packing.batch_plan(bounds, total, 64)
    load, placed = np.zeros(containers), np.zeros(len(bounds), int)
    for b, rank, first, fit, times in segments:
        assert rank == placed[b]
        placed[b] += fit * times
        load[first : first + times] += fit * bounds[b]
    assert (placed == total).all() and load.max() <= 64 and (load > 0).all()


def test_packing_of_rows(spark):
    rng = random.Random(2)
    items = [(i, rng.choice([3, 7, 20, rng.randrange(1, 120)])) for i in range(3000)] + [(None, 5), (5, 9), (9000, 100_003), (9001, None), (9002, 0)]
    df = spark.createDataFrame([(i, n, "x", "y") for i, n in items], "doc_id bigint, n_tokens bigint, pack string, bucket string").select("doc_id", "n_tokens")
    packs = [("a", 50), ("b", 64), ("none", None), ("zero", 0)]
    rows = packing.pack(df, "doc_id", packs, buckets=12).collect()
    whole = [(i, n) for i, n in items if n]
    for name, capacity in packs[:2]:
        mine = [r for r in rows if r["pack_name"] == name]
        assert sum(r["n_tokens"] for r in mine) == sum(n for _, n in whole)
        load, parts = {}, {}
        for r in mine:
            load[r["container"]] = load.get(r["container"], 0) + r["n_tokens"]
            parts.setdefault(r["doc_id"], []).append((r["first_token"], r["n_tokens"]))
        assert max(load.values()) <= capacity and sorted(load) == list(range(len(load)))
        assert all(len(parts[i]) == 1 for i, n in whole if n <= capacity and i not in (5, None))
        assert sum(sorted(load.values())) / (len(load) * capacity) > 0.9
        assert sorted(parts[9000])[-1] == (100_003 // capacity * capacity, 100_003 % capacity)
    report = {r["pack_name"]: r for r in packing.fill_report(spark.createDataFrame(rows), packs[:2]).collect()}
    assert report["a"]["fill"] > 0.9
    assert packing.pack(df.limit(0), "doc_id", packs).collect() == [] and packing.pack(df, "doc_id", []).collect() == []


def test_budgets():
    weights = [("big", 2.0, 1), ("small", 1.0, 3), ("none", 1.0, 2), ("zero", 0.0, 5), ("null", None, 1)]
    tokens_of = {"big": 1000, "small": 10, "zero": 50, "null": 5}
    got = mixing.budgets(tokens_of, weights, 600)
    assert got == {"small": 30.0, "big": 570.0}
    assert mixing.budgets(tokens_of, weights, 30) == {"big": 20.0, "small": 10.0}
    assert mixing.budgets({}, weights) == {} and sum(mixing.budgets(tokens_of, weights).values()) == 1010


def test_mixture_reaches_its_shares(spark):
    rng = random.Random(3)
    docs = [(i, s, rng.randrange(1, 40), "x") for i, s in enumerate(["a"] * 900 + ["b"] * 300 + ["c"] * 20 + ["z"] * 50)] + [(5000, None, 9, "x"), (5001, "a", 0, "x"), (5002, "a", None, "x")]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint, uses string").select("doc_id", "source", "n_tokens")
    weights = [("a", 1.0, 1), ("b", 2.0, 3), ("c", 1.0, 2), ("z", 0.0, 1), ("gone", 1.0, 1), (None, 1.0, 1)]
    rows = mixing.mixture(df, "doc_id", "source", weights, 12_000).collect()
    used = {}
    for r in rows:
        used[r["source"]] = used.get(r["source"], 0) + r["n_tokens"] * r["uses"]
        assert r["uses"] <= {"a": 1, "b": 3, "c": 2}[r["source"]]
    have = {s: sum(n for _, t, n, _ in docs if t == s and n) for s in "abc"}
    want = mixing.budgets(have, weights, 12_000)
    assert all(abs(used[s] - want[s]) <= 20 for s in "abc") and set(used) == set("abc")
    report = {r["source"]: r for r in mixing.shares(spark.createDataFrame(rows), weights).collect()}
    assert abs(sum(r["share"] for r in report.values()) - 1) < 1e-5 and report["gone"]["tokens"] == 0 and report["z"]["documents"] == 0
    again = mixing.mixture(df.repartition(3), "doc_id", "source", weights, 12_000).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    assert mixing.mixture(df.limit(0), "doc_id", "source", weights).collect() == []


def test_limits_tell_a_mixture_that_misses_its_shares(spark, tmp_path, monkeypatch):
    docs = [(i, "abc"[i % 3], "one two three four " * (1 + i % 5)) for i in range(60)] + [(60, "z", "none of it"), (61, None, "nor this"), (62, "a", "")]
    spark.createDataFrame(docs, "doc_id bigint, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    weights = [("a", 1.0, 1), ("b", 2.0, 3), ("c", 1.0, 2), ("z", 0.0, 1), ("gone", 1.0, 1), (None, 1.0, 1), ("null", None, None)]
    spark.createDataFrame(weights, "source string, weight double, max_repeats int").write.parquet(str(tmp_path / "mix_weights.parquet"))
    kept = lambda: {r["source"]: r["kept"] for r in queries.p9_limits(spark, str(tmp_path)).collect()}
    named = {"a", "b", "c", "z", "gone", "null"}
    assert kept() == dict.fromkeys(named, True)
    whole = mixing.mixture
    monkeypatch.setattr(mixing, "mixture", lambda *args: whole(*args).where("source <> 'b' and (source <> 'c' or doc_id % 2 = 0)"))
    assert kept() == {s: s not in ("b", "c") for s in named}  # one left out, one cut in half
