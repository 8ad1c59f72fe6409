"""Filling fixed-capacity containers with items (problem 8).

The global histogram of item sizes (at most ``capacity`` rows, whatever the data's size) is all the driver sees. Dynamic
programming over it picks bucket boundaries that minimise padding. Batches of at most ``capacity`` tokens are then
planned over the buckets: the largest bucket left is completed with the largest ones that still fit, and each such
pattern is repeated as often as its buckets allow. Batches that draw from one bucket only, as the plain bucketing
method forms them, waste everything beyond half the capacity, so batches here draw on complementary buckets. An item's
container follows from its position within its bucket, a distributed prefix count; no bucket is ever brought together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.llm.ordinals import prefix_sums
from archivolt.plans.runtime import cut

#: Buckets per capacity at most.
BUCKETS = 256


def bucket_bounds(sizes: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """The upper bounds of at most ``buckets`` buckets over ascending ``sizes`` for which the padding, the sum of
    (bound - size) * count, is least: exact dynamic programming."""
    n = len(sizes)
    if n <= buckets:
        return sizes.copy()
    count, mass = np.r_[0, np.cumsum(counts)].astype(np.float64), np.r_[0, np.cumsum(counts * sizes)].astype(np.float64)
    best = sizes * count[1:] - mass[1:]  # one bucket over sizes[0..j]
    choice = np.zeros((buckets, n), np.int32)
    for k in range(1, buckets):
        best = _next_layer(best, k, sizes, count, mass, choice[k])
    bounds, j = [], n - 1
    for k in range(buckets - 1, -1, -1):
        bounds.append(sizes[j])
        if k == 0:
            break
        j = int(choice[k, j]) - 1
    return np.array(bounds[::-1])


def _next_layer(best: np.ndarray, k: int, sizes: np.ndarray, count: np.ndarray, mass: np.ndarray, choice: np.ndarray) -> np.ndarray:
    """The least padding of sizes[0..j] in k + 1 buckets, given that in k; ``choice[j]`` gets where the last begins.
    The best beginning never falls as j grows, so the middle of a range bounds those of its halves; all ranges of one
    depth are worked out together."""
    n = len(sizes)
    after = best.copy()
    jl, jr, il, ir = (np.array([v]) for v in (k, n - 1, k, n - 1))
    while len(jl):
        mid = (jl + jr) // 2
        length = np.minimum(mid, ir) - il + 1
        begin = np.cumsum(length) - length
        i = np.arange(length.sum()) - np.repeat(begin - il, length)
        m = np.repeat(mid, length)
        cost = best[i - 1] + sizes[m] * (count[m + 1] - count[i]) - (mass[m + 1] - mass[i])
        least = np.minimum.reduceat(cost, begin)
        hits = np.flatnonzero(cost == np.repeat(least, length))
        at = i[hits[np.searchsorted(hits, begin)]]
        after[mid], choice[mid] = least, at
        left, right = jl < mid, mid < jr
        jl, jr, il, ir = np.r_[jl[left], mid[right] + 1], np.r_[mid[left] - 1, jr[right]], np.r_[il[left], at[right]], np.r_[at[left], ir[right]]
    return after


def batch_plan(bounds: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Segments ``(bucket, first rank, first container, items per container, containers)`` and the containers' number.

    A pattern takes the largest bucket left, then again and again the largest that fits, each as often as it fits."""
    left, used = counts.astype(np.int64).copy(), np.zeros(len(counts), np.int64)
    segments, containers = [], 0
    while (alive := np.flatnonzero(left)).size:
        room, pattern = capacity, []
        for b in alive[::-1].tolist():
            if fit := min(room // int(bounds[b]), int(left[b])):
                pattern.append((b, fit))
                room -= fit * int(bounds[b])
                if room < bounds[alive[0]]:
                    break
        times = min(int(left[b]) // fit for b, fit in pattern)
        for b, fit in pattern:
            segments.append((b, int(used[b]), containers, fit, times))
            used[b] += fit * times
            left[b] -= fit * times
        containers += times
    return segments, containers


def pieces(counts: DataFrame, id_col: str, packs: list[tuple[str, int]]) -> DataFrame:
    """One row per pack and item; an item beyond the capacity is cut into full pieces and a rest."""
    table = F.array(*[F.struct(F.lit(i).alias("pack"), F.lit(c).cast("bigint").alias("capacity")) for i, (_, c) in enumerate(packs)])
    each = counts.select(id_col, "n_tokens", F.explode(table).alias("p")).select(id_col, "n_tokens", "p.pack", "p.capacity")
    cut_up = each.withColumn("piece", F.explode(F.sequence(F.lit(0), (F.floor((F.col("n_tokens") - 1) / F.col("capacity"))).cast("int"))))
    start = F.col("piece") * F.col("capacity")
    return cut_up.select(id_col, "pack", "piece", start.alias("first_token"), F.least("capacity", F.col("n_tokens") - start).alias("n_tokens"))


def pack(counts: DataFrame, id_col: str, packs: list[tuple[str, int]], buckets: int = BUCKETS) -> DataFrame:
    """``pack_name``, the id column, ``piece`` (0 for a whole item), ``first_token``, ``n_tokens``, ``container``.

    ``counts`` holds the id and ``n_tokens``; items of null or no tokens are left out, a null id is carried through,
    repeated rows are items of their own. Packs of null or non-positive capacity are left out; packs of one name are
    filled one by one. Every item is placed in every pack; containers count from 0 within each pack. No container
    holds more than its capacity. Ties in size are broken by place, so the result is one of many equal ones.
    """
    packs = [(name, int(c)) for name, c in packs if c is not None and c > 0]
    id_type = counts.schema[id_col].dataType.simpleString()
    schema = f"pack_name string, `{id_col}` {id_type}, piece int, first_token bigint, n_tokens bigint, container bigint"
    spark = counts.sparkSession
    if not packs:
        return spark.createDataFrame([], schema)
    fixed = cut(counts.where("n_tokens > 0"))
    cut_up = pieces(fixed, id_col, packs)
    histogram = cut_up.groupBy("pack", "n_tokens").count().collect()  # at most the sum of the capacities
    plans, bucket_rows = {}, []
    for i, (_, capacity) in enumerate(packs):
        rows = sorted((r["n_tokens"], r["count"]) for r in histogram if r["pack"] == i)
        if not rows:
            continue
        sizes, n = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        bounds = bucket_bounds(sizes, n, buckets)
        which = np.searchsorted(bounds, sizes)
        total = np.bincount(which, weights=n, minlength=len(bounds)).astype(np.int64)
        bucket_rows += [(i, int(s), i * (buckets + 1) + int(b)) for s, b in zip(sizes, which, strict=True)]
        segments, _ = batch_plan(bounds, total, capacity)
        for b, rank, container, fit, _times in segments:
            plans.setdefault(i * (buckets + 1) + b, []).append((rank, container, fit))
    by_bucket = {k: tuple(np.array(x, np.int64) for x in zip(*sorted(v), strict=True)) for k, v in plans.items()}
    lookup = spark.createDataFrame(bucket_rows, "pack int, n_tokens bigint, bucket int")
    # narrow and broadcast joins only, so the pieces keep the checkpoint's partitions and order
    placed = cut_up.join(F.broadcast(lookup), ["pack", "n_tokens"]).select(id_col, "pack", "piece", "first_token", "n_tokens", "bucket", F.lit(1).cast("bigint").alias("one"))
    ranked = prefix_sums(placed, "bucket", "one")
    names = [name for name, _ in packs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pack_at, bucket, rank = (batch.column(c).to_numpy() for c in ("pack", "bucket", "before"))
            container = np.empty(len(rank), np.int64)
            for b in np.unique(bucket).tolist():
                at = np.flatnonzero(bucket == b)
                first, start, fit = by_bucket[b]
                k = np.searchsorted(first, rank[at], side="right") - 1
                container[at] = start[k] + (rank[at] - first[k]) // fit[k]
            label = pa.array(names, pa.string()).take(pa.array(pack_at))
            yield pa.RecordBatch.from_arrays([label, *(batch.column(c) for c in (id_col, "piece", "first_token", "n_tokens")), pa.array(container)], names=["pack_name", id_col, "piece", "first_token", "n_tokens", "container"])

    return ranked.mapInArrow(run, schema)


def fill_report(packed: DataFrame, packs: list[tuple[str, int]]) -> DataFrame:
    """Per pack: ``containers``, ``tokens``, ``capacity_tokens`` and ``fill``, the share of the space that is used."""
    capacity = F.create_map(*[x for name, c in packs for x in (F.lit(name), F.lit(int(c)))])
    return (
        packed.groupBy("pack_name")
        .agg((F.max("container") + 1).alias("containers"), F.sum("n_tokens").alias("tokens"))
        .withColumn("capacity_tokens", capacity[F.col("pack_name")])
        .withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))
    )
