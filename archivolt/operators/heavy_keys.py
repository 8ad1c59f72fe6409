"""Per-key results where a few keys hold most rows (problem 6): range partitioning with boundary stitching.

Rows are range-partitioned on the composite (key, order, tie) by sampled quantiles, so a heavy key is cut into as many
ranges as its share of the rows asks for and no task gets more than its part. Each task folds its sorted range into one
partial state per key in a single vectorised pass. Only keys that touch a range's edge have more than one state; the
states of a key are few (at most one per partition) and are stitched in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = "n bigint, n_timed bigint, first_us bigint, last_us bigint, max_gap_us bigint"


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold rows sorted by (k, at) into one state per run of equal keys; the last run waits for the next batch."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, at = batch.column("k"), batch.column("at")
        codes = pc.rank(keys, sort_keys="ascending", tiebreaker="dense").to_numpy()
        starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        timed = pc.is_valid(at).to_numpy(zero_copy_only=False)
        us = pc.fill_null(at, 0).to_numpy()
        n = np.diff(np.r_[starts, len(us)])
        n_timed = np.add.reduceat(timed.astype(np.int64), starts)
        low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
        first = np.minimum.reduceat(np.where(timed, us, high), starts)
        last = np.maximum.reduceat(np.where(timed, us, low), starts)
        gap = np.zeros(len(us), np.int64)
        both = timed[1:] & timed[:-1]
        gap[1:][both] = (us[1:] - us[:-1])[both]
        gap[starts] = 0
        most = np.maximum.reduceat(gap, starts)
        rows = [list(x) for x in zip(keys.take(pa.array(starts)).to_pylist(), n.tolist(), n_timed.tolist(), first.tolist(), last.tolist(), most.tolist(), strict=True)]
        if held is not None:
            if held[0] == rows[0][0]:
                rows[0] = _merge(held, rows[0])
            else:
                rows.insert(0, held)
        held = rows.pop()
        if rows:
            yield _batch(rows, keys.type)
    if held is not None:
        yield _batch([held], keys.type)


def _merge(a: list, b: list) -> list:
    joint = b[3] - a[4] if a[2] and b[2] else 0
    return [a[0], a[1] + b[1], a[2] + b[2], min(a[3], b[3]), max(a[4], b[4]), max(a[5], b[5], joint)]


def _batch(rows: list[list], key_type: pa.DataType) -> pa.RecordBatch:
    k, n, timed, first, last, gap = zip(*rows, strict=True)
    some = [bool(x) for x in timed]
    pick = lambda values: pa.array([v if s else None for v, s in zip(values, some, strict=True)], pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(k, key_type), pa.array(n, pa.int64()), pa.array(timed, pa.int64()), pick(first), pick(last), pick(gap)],
        names=["k", "n", "n_timed", "first_us", "last_us", "max_gap_us"],
    )


def per_key_captures(df: DataFrame, key: str, at: str, tie: str | None = None, partitions: int | None = None) -> DataFrame:
    """Per key: ``k``, ``n`` rows, ``n_timed`` rows with a time, ``first_us``, ``last_us`` and the longest pause
    between consecutive times ``max_gap_us`` (0 for a single time), in microseconds.

    A null key is no key and is left out. Rows with a null time count in ``n`` only; a key without any time has null
    ``first_us``, ``last_us`` and ``max_gap_us``. Equal times make a pause of 0. Repeated rows are counted. ``tie``
    names a column that spreads rows of one key and one time over partitions. An empty table gives no rows.
    """
    narrow = df.select(F.col(key).alias("k"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), (F.xxhash64(tie) if tie else F.lit(0)).alias("tie")).where(F.col("k").isNotNull())
    by = ["k", "at", "tie"]
    ranged = (narrow.repartitionByRange(partitions, *by) if partitions else narrow.repartitionByRange(*by)).sortWithinPartitions(*by)
    kind = df.schema[key].dataType.simpleString()
    partial = ranged.select("k", "at").mapInArrow(_states, f"k {kind}, {STATE}")
    joint = F.expr(
        "aggregate(states, named_struct('last', cast(null as bigint), 'gap', cast(null as bigint)), (s, x) -> named_struct("
        "'last', coalesce(x.last_us, s.last), "
        "'gap', greatest(s.gap, x.max_gap_us, if(s.last is not null and x.first_us is not null, x.first_us - s.last, null))), s -> s.gap)"
    )
    return (
        partial.groupBy("k")
        .agg(
            F.sum("n").alias("n"),
            F.sum("n_timed").alias("n_timed"),
            F.min("first_us").alias("first_us"),
            F.max("last_us").alias("last_us"),
            F.array_sort(F.collect_list(F.struct("first_us", "last_us", "max_gap_us"))).alias("states"),
        )
        .select("k", "n", "n_timed", "first_us", "last_us", joint.alias("max_gap_us"))
    )


def heavy_keys(states: DataFrame, total: int, share: float = 0.02) -> DataFrame:
    """The keys that hold at least ``share`` of ``total`` rows; none if there are no rows."""
    return states.where((F.col("n") >= F.lit(share) * F.lit(total)) & F.lit(total > 0))
