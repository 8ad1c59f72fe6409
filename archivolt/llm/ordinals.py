"""Distributed prefix sums: positions within a group without ever bringing the group together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archivolt.plans.runtime import small


def prefix_sums(fixed: DataFrame, group: str, value: str) -> DataFrame:
    """``fixed`` with ``before``: the sum of ``value`` over the earlier rows of the row's group.

    ``fixed`` must be materialised (a checkpoint), for rows are earlier by partition and by place in it. Each task sums
    its own rows; only one total per task and group is shuffled and turned into offsets. Values and groups are not null.
    """
    names = fixed.columns
    g, v = names.index(group), names.index(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(g).dictionary_encode()
            codes, values = coded.indices.to_numpy(), batch.column(v).to_numpy()
            order = np.argsort(codes, kind="stable")
            run_values = values[order]
            total = np.cumsum(run_values)
            starts = np.flatnonzero(np.r_[True, codes[order][1:] != codes[order][:-1]])
            ends = np.r_[starts[1:], len(order)]
            labels = coded.dictionary.take(pa.array(codes[order][starts])).to_pylist()
            start_sum = np.r_[0, total[ends[:-1] - 1]]
            base = np.array([sums.get(x, 0) for x in labels], np.int64)
            exclusive = total - run_values - np.repeat(start_sum, ends - starts) + np.repeat(base, ends - starts)
            for x, b, s, e in zip(labels, base.tolist(), start_sum.tolist(), total[ends - 1].tolist(), strict=True):
                sums[x] = b + e - s
            out = np.empty(len(order), np.int64)
            out[order] = exclusive
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*names, "pid", "local"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fixed.schema.fields)
    local = fixed.withColumn("pid", F.spark_partition_id()).mapInArrow(run, f"{schema}, pid int, local bigint")
    totals = fixed.withColumn("pid", F.spark_partition_id()).groupBy("pid", group).agg(F.sum(value).alias("total"))
    ahead = Window.partitionBy(group).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("pid", group, F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("offset"))
    return local.join(small(offsets), ["pid", group]).select(*names, (F.col("local") + F.col("offset")).alias("before"))
