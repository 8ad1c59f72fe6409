"""The general training-data operators against brute force, and their edge cases."""

import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from archivolt.operators import heavy_keys as heavy
from archivolt.operators import orphans, packed

BASE = datetime(2024, 1, 1)


def at(n):
    return None if n is None else BASE + timedelta(hours=n)


# -- orphan references -------------------------------------------------------------

CHILD = "ref_table string, ref_id bigint, parent_table string, target_id bigint, at timestamp, written string, removed_at string, epoch string"
PARENT = "parent_table string, target_id bigint, at timestamp, written string"


def run_orphans(spark, children, parents, removals, partitions=None):
    c = spark.createDataFrame([(t, i, p, k, at(n), "x", "y", "z") for t, i, p, k, n in children], CHILD)
    p = spark.createDataFrame([(t, k, at(n), "x") for t, k, n in parents], PARENT)
    r = spark.createDataFrame([(t, k, at(n), "x") for t, k, n in removals], PARENT)
    out = orphans.orphan_references(c, p, r, partitions)
    return {tuple(x) for x in orphans.distinct_cases(out).collect()}, out


def brute_orphans(children, parents, removals):
    out = set()
    for t, i, p, k, n in children:
        if k is None:
            continue
        sound = n is not None and any(q == p and j == k and m is not None and m <= n and not any(a == p and b == k and c is not None and m <= c <= n for a, b, c in removals) for q, j, m in parents)
        if not sound:
            out.add((t, i, k))
    return out


def test_orphans_match_brute_force(spark):
    rng = random.Random(4)
    hour = lambda: rng.choice([None, *range(12)])
    key = lambda: rng.choice([None, 1, 1, 1, 1, 2, 3, 4, 5, 6])
    table = lambda: rng.choice("ab")
    children = [("u", i % 150, table(), key(), hour()) for i in range(300)]
    parents = [(table(), key(), hour()) for _ in range(25)] * 2
    removals = [(table(), key(), hour()) for _ in range(12)] * 2
    got, out = run_orphans(spark, children, parents, removals)
    assert got == brute_orphans(children, parents, removals)
    months = orphans.orphans_by_period(out).collect()
    assert sum(r["orphan_references"] for r in months) == out.select("ref_table", "parent_table", "ref_id", "target_id", F.date_format("at", "yyyy-MM").alias("m")).distinct().count()


@pytest.mark.parametrize("partitions", [1, 5, 23])
def test_a_hot_key_is_split_and_stitched(spark, partitions):
    rng = random.Random(partitions)
    hot = [("u", i, "a", 1, rng.randrange(60)) for i in range(400)] + [("v", i, "a", 1, 30) for i in range(100)]
    children = hot + [("u", 1000 + i, "a", rng.randrange(2, 9), rng.randrange(60)) for i in range(60)] + [("u", 2000 + i, "b", 1, rng.randrange(60)) for i in range(60)] + [("u", 3000, "a", 1, None)]
    parents = [("a", 1, 3), ("a", 1, 30), ("a", 2, 5), ("b", 1, 59)] * 30
    removals = [("a", 1, 20), ("a", 1, 45)] * 9
    got, out = run_orphans(spark, children, parents, removals, partitions)
    assert got == brute_orphans(children, parents, removals)
    assert run_orphans(spark, hot, [], removals, partitions)[0] == {(t, i, 1) for t, i, *_ in hot}


def test_orphans_of_empty_tables(spark):
    child = [("u", 1, "a", 7, 3)]
    assert run_orphans(spark, [], [("a", 7, 1)], [])[0] == set()
    assert run_orphans(spark, child, [], [])[0] == {("u", 1, 7)}
    assert run_orphans(spark, child, [("a", 7, 3)], [])[0] == set()
    assert run_orphans(spark, child, [("a", 7, 3)], [("a", 7, 3)])[0] == {("u", 1, 7)}
    assert run_orphans(spark, child, [("b", 7, 1)], [])[0] == {("u", 1, 7)}


def test_archive_references_skip_nulls(spark):
    uris = spark.createDataFrame([(1, [5, None, 5], BASE), (2, None, BASE), (3, [], BASE)], "id bigint, content_type_ids array<bigint>, created_at timestamp")
    responses = spark.createDataFrame([(9, None, BASE)], "id bigint, record_id bigint, created_at timestamp")
    rows = orphans.archive_references(uris, responses).collect()
    assert sorted((r["ref_table"], r["ref_id"], r["target_id"]) for r in rows if r["target_id"] is not None) == [("uris", 1, 5)]


# -- packed values --------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "values"),
    [
        ("text/html; charset=utf-8", ["text/html", "charset=utf-8"]),
        (' a/b ;; ,|\t c="x;y" ;', ["a/b", "c=x;y"]),
        ('"a/b",n="p \\"q\\" r";"', ["a/b", 'n=p "q" r', '"']),
        ("", []), (" ;,", []), (" a \r\nb", ["a", "b"]), ('x="\\\\";y', ["x=\\", "y"]), ('a"b;c', ['a"b', "c"]), ("İ;i", ["İ", "i"]), ('""', [""]),
    ],
)
def test_segmentation(text, values):
    assert packed.segment(text, packed.build_automaton(["text/html", "a/b"])) == values


def test_known_values_protect_their_delimiters():
    automaton = packed.build_automaton(["text/html;level=1", "a,b,c", "b,c;d"])
    assert packed.segment("TEXT/HTML;level=1;q=2, a,b,c", automaton) == ["TEXT/HTML;level=1", "q=2", "a,b,c"]
    assert packed.segment("xa,b,c", automaton) == ["xa", "b", "c"]
    assert packed.segment("a,b,c;d", automaton) == ["a,b,c", "d"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab/=+. -", min_size=1, max_size=6).map(str.strip).filter(bool), max_size=6), st.lists(st.sampled_from([";", ",", " ; ", "|", "\r\n", "\t", ";;"]), min_size=6, max_size=6), st.lists(st.booleans(), min_size=6, max_size=6))
def test_packing_round_trip(values, separators, quoted):
    written = [f'"{v}"' if q else v for v, q in zip(values, quoted, strict=False)]
    text = "".join(w + s for w, s in zip(written, separators, strict=False))
    assert packed.segment(text, packed.build_automaton(["text/html", "a/b"])) == values


def test_the_columns_own_dictionary_decides_the_cut(spark):
    rows = [(1, 'text/html; title="notes, part 1; final"'), (2, 'title="Notes, Part 1; Final"|q=1'), (3, "text/css; title=notes, part 1; final; q=2"), (4, 'title="once, only"'), (5, "title=once, only"), (6, "a title=notes, part 1"), (7, None)]
    df = spark.createDataFrame(rows, "id bigint, packed string")
    assert packed.learn_dictionary(df, "packed") == ["title=notes, part 1; final"]
    cut = lambda known: {r["id"]: r["v"] for r in packed.split_packed(df, "id", "packed", known).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "val")))["val"].alias("v")).collect()}
    learnt, plain = cut(None), cut([])
    assert learnt[3] == ["text/css", "title=notes, part 1; final", "q=2"] and plain[3] == ["text/css", "title=notes", "part 1", "final", "q=2"]
    assert {i for i in learnt if learnt[i] != plain[i]} == {3}
    assert packed.learn_dictionary(df.limit(0), "packed") == []


def test_split_packed_edges(spark):
    rows = [(1, "a;b", "x"), (1, "a;b", "x"), (None, "c", "x"), (2, None, "x"), (3, "", "x"), (4, ";".join(f"v{i}" for i in range(5000)), "x")]
    df = spark.createDataFrame(rows, "id bigint, packed string, pos string")
    got = packed.split_packed(df, "id", "packed").collect()
    assert sorted((r["id"] or 0, r["pos"], r["val"]) for r in got if r["id"] != 4) == [(0, 1, "c"), (1, 1, "a"), (1, 1, "a"), (1, 2, "b"), (1, 2, "b")]
    assert sorted((r["pos"], r["val"]) for r in got if r["id"] == 4)[-1] == (5000, "v4999")
    assert packed.split_packed(df.limit(0), "id", "packed").collect() == []


# -- heavy keys ----------------------------------------------------------------------------


def brute_captures(rows):
    by = {}
    for k, t, _ in rows:
        if k is not None:
            by.setdefault(k, []).append(t)
    out = {}
    for k, times in by.items():
        known = sorted(t for t in times if t is not None)
        gap = max((b - a for a, b in zip(known, known[1:], strict=False)), default=0) if known else None
        out[k] = (len(times), len(known), known[0] if known else None, known[-1] if known else None, gap)
    return out


def capture_rows(n, seed=2):
    rng = random.Random(seed)
    return [(rng.choice(["hot"] * 6 + ["warm", "warm", None, f"k{rng.randrange(60)}"]), rng.choice([None, *range(1000)] if i % 9 == 0 else [rng.randrange(1_000_000)]), i) for i in range(n)]


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_captures_match_brute_force(spark, partitions):
    rows = capture_rows(3000)
    df = spark.createDataFrame([(k, None if t is None else BASE + timedelta(microseconds=t), i, "x", "y") for k, t, i in rows], "key string, moment timestamp, id bigint, n string, tie string")
    got = heavy.per_key_captures(df, "key", "moment", "id", partitions).collect()
    base = int((BASE - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    want = {k: (n, m, None if a is None else a + base, None if b is None else b + base, g) for k, (n, m, a, b, g) in brute_captures(rows).items()}
    assert {r["k"]: (r["n"], r["n_timed"], r["first_us"], r["last_us"], r["max_gap_us"]) for r in got} == want


def test_captures_split_the_hot_key(spark):
    df = spark.range(20000).select(F.lit(7).alias("key"), F.timestamp_micros(F.col("id") % 3).alias("moment"), "id")
    narrow = df.select("key", F.unix_micros("moment").alias("at"), F.xxhash64("id").alias("tie"))
    sizes = narrow.repartitionByRange(8, "key", "at", "tie").groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= 7 and max(r["count"] for r in sizes) < 5000
    (row,) = heavy.per_key_captures(df, "key", "moment", "id", 8).collect()
    assert (row["n"], row["first_us"], row["last_us"], row["max_gap_us"]) == (20000, 0, 2, 1)


def test_captures_edges(spark):
    df = spark.createDataFrame([(None, BASE, 1), ("a", None, 2), ("", BASE, 3), ("", BASE, 3)], "key string, moment timestamp, id bigint")
    got = {r["k"]: (r["n"], r["n_timed"], r["max_gap_us"]) for r in heavy.per_key_captures(df, "key", "moment").collect()}
    assert got == {"a": (1, 0, None), "": (2, 2, 0)}
    empty = heavy.per_key_captures(df.limit(0), "key", "moment")
    assert empty.collect() == [] and heavy.heavy_keys(empty, 0).collect() == []
    states = heavy.per_key_captures(df, "key", "moment")
    assert {r["k"] for r in heavy.heavy_keys(states, 4, 0.5).collect()} == {""}
