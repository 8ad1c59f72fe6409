"""References to rows that do not exist: never there, deleted, or written later (problem 2).

Parents, deletions and children are united in long form ``(table, key, at, tag)`` and grouped by table and key. In a
group's order of time, parents before deletions before children of the same moment, a child is sound exactly if the
last parent or deletion before it is a parent: the *flag* that its group carries at that point.

Groups are ranges: rows are range-partitioned on (table, key, at, tag, referring row) by sampled quantiles, so a key
that holds a third of all rows is cut into as many ranges as its share asks for. Each task walks its sorted range once.
Children of a range's first key that meet no parent or deletion within the range stay open, and are settled by the last
flag of the ranges before; there is one such flag a range, and no child ever meets a parent in a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.plans.runtime import bounded, cut

KEYS = ["parent_table", "target_id"]
#: Tags in the order in which events of one moment count.
PARENT, REMOVAL, CHILD = 0, 1, 2
#: What a task says of a row: an unsound child, an open child, or the flag with which its range ends.
UNSOUND, OPEN, ENDS_PARENT, ENDS_REMOVAL = range(4)
_NONE = -1


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (parent_table, target_id, at, tag): the unsound and open children, and the final flag."""
    part = TaskContext.get().partitionId()
    key, flag, within_first, last_row = None, _NONE, True, None

    def told(batch: pa.RecordBatch, at: np.ndarray, status: np.ndarray) -> pa.RecordBatch:
        rows = batch.take(pa.array(at, pa.int64()))
        return pa.RecordBatch.from_arrays(
            [*(rows.column(c) for c in ("ref_table", "ref_id", *KEYS, "at")), pa.array(np.full(len(at), part, np.int32)), pa.array(status.astype(np.int8))],
            names=["ref_table", "ref_id", *KEYS, "at", "part", "status"],
        )

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        codes = [batch.column(c).dictionary_encode().indices.to_numpy() for c in KEYS]
        starts = np.ones(n, bool)
        starts[1:] = (codes[0][1:] != codes[0][:-1]) | (codes[1][1:] != codes[1][:-1])
        first, final = ((batch.column(KEYS[0])[i].as_py(), batch.column(KEYS[1])[i].as_py()) for i in (0, n - 1))
        starts[0] = first != key
        if key is None:
            starts[0] = False  # the range's first key may have begun before it
        tag = batch.column("tag").to_numpy().astype(np.int8)
        place = np.arange(n)
        run = np.maximum.accumulate(np.where(starts, place, -1))  # -1: goes on from the rows before
        event = np.maximum.accumulate(np.where(tag != CHILD, place, -1))
        flags = np.where((event >= 0) & (event >= run), tag[event], np.where(run < 0, flag, _NONE))
        timed = batch.column("at").is_valid().to_numpy(zero_copy_only=False)
        open_ = (tag == CHILD) & timed & (flags == _NONE) & (run < 0) & within_first
        cases = (tag == CHILD) & ((flags != PARENT) | ~timed)
        if len(at := np.flatnonzero(cases | open_)):
            yield told(batch, at, np.where(open_[at], OPEN, UNSOUND))
        within_first = within_first and run[-1] < 0
        key, flag, last_row = final, int(flags[-1]), batch.slice(n - 1)
    if flag != _NONE:
        yield told(last_row, np.array([0]), np.array([ENDS_PARENT if flag == PARENT else ENDS_REMOVAL]))


def orphan_references(children: DataFrame, parents: DataFrame, removals: DataFrame, partitions: int | None = None) -> DataFrame:
    """The child rows whose reference is unsound.

    ``children``: ref_table, ref_id, parent_table, target_id, at. ``parents``: parent_table, target_id, at.
    ``removals``: parent_table, target_id, at. Other columns are ignored.

    Null targets are no references and are left out. A child with a null ``at`` has no time at which its parent
    could have been there: it is unsound. Parents and removals with a null table,
    key or time say nothing, and a child with a null table has no parent. A parent written
    at the child's own time counts as there; a removal at the parent's or the child's own time counts as a removal.
    Repeated rows give repeated results here (see :func:`distinct_cases`). Empty tables are sound inputs: without
    parents every reference is an orphan.
    """
    ref = {c: children.schema[c].dataType for c in ("ref_table", "ref_id")}
    key = children.schema["target_id"].dataType

    def events(df: DataFrame, tag: int) -> DataFrame:
        named = [F.col(c) if tag == CHILD else F.lit(None).cast(t).alias(c) for c, t in ref.items()]
        return df.select(*named, F.col("parent_table"), F.col("target_id").cast(key).alias("target_id"), F.col("at").cast("timestamp").alias("at"), F.lit(tag).cast("tinyint").alias("tag"))

    known = F.col("parent_table").isNotNull() & F.col("target_id").isNotNull() & F.col("at").isNotNull()
    long = events(parents, PARENT).where(known).unionByName(events(removals, REMOVAL).where(known)).unionByName(events(children, CHILD).where(F.col("target_id").isNotNull()))
    by = [*KEYS, "at", "tag", "ref_id"]
    ranged = (long.repartitionByRange(partitions, *by) if partitions else long.repartitionByRange(*by)).sortWithinPartitions(*by)
    types = ", ".join(f"{c} {t.simpleString()}" for c, t in (*ref.items(), ("parent_table", children.schema["parent_table"].dataType), ("target_id", key)))
    walked = cut(ranged.mapInArrow(_walk, f"{types}, at timestamp, part int, status tinyint"))
    opens = walked.where(F.col("status") == OPEN)
    ends = walked.where(F.col("status") >= ENDS_PARENT).select(*KEYS, F.col("part").alias("before"), "status").alias("e")
    edges = opens.select(*KEYS, "part").distinct().alias("o")  # one a range at most, like the ends
    same = F.col("o.parent_table").eqNullSafe(F.col("e.parent_table")) & (F.col("o.target_id") == F.col("e.target_id")) & (F.col("o.part") > F.col("e.before"))
    flags = bounded(edges.join(ends, same).groupBy("o.part").agg(F.max_by("e.status", "e.before").alias("flag")))
    settled = opens.join(flags, "part", "left").where(F.col("flag").isNull() | (F.col("flag") != ENDS_PARENT))
    columns = ["ref_table", "ref_id", *KEYS, "at"]
    return walked.where(F.col("status") == UNSOUND).select(*columns).unionByName(settled.select(*columns))


def distinct_cases(orphans: DataFrame) -> DataFrame:
    """Each unsound reference once: ref_table, ref_id, target_id."""
    return orphans.select("ref_table", "ref_id", "target_id").distinct()


def orphans_by_period(orphans: DataFrame) -> DataFrame:
    """Unsound references per referring table, parent table and month of the referring row's ``at``; a null ``at``
    is counted under a null month."""
    once = orphans.select("ref_table", "parent_table", "ref_id", "target_id", F.date_format("at", "yyyy-MM").alias("month"))
    return (
        once.distinct()
        .groupBy("ref_table", "parent_table", "month")
        .agg(F.count("*").alias("orphan_references"), F.count_distinct("target_id").alias("missing_keys"))
    )


def archive_references(uris: DataFrame, responses: DataFrame) -> DataFrame:
    """The references of the archive's tables in long form; null arrays, empty arrays and null elements are none."""
    typed = uris.select(
        F.lit("uris").alias("ref_table"),
        F.col("id").alias("ref_id"),
        F.lit("content_types").alias("parent_table"),
        F.explode(F.array_distinct("content_type_ids")).alias("target_id"),
        F.col("created_at").alias("at"),
    )
    recorded = responses.select(
        F.lit("responses").alias("ref_table"),
        F.col("id").alias("ref_id"),
        F.lit("records").alias("parent_table"),
        F.col("record_id").alias("target_id"),
        F.col("created_at").alias("at"),
    )
    return typed.unionByName(recorded)


def archive_parents(content_types: DataFrame, records: DataFrame) -> DataFrame:
    one = lambda df, name: df.select(F.lit(name).alias("parent_table"), F.col("id").alias("target_id"), F.col("created_at").alias("at"))
    return one(content_types, "content_types").unionByName(one(records, "records"))


def archive_removals(removed_keys: DataFrame) -> DataFrame:
    return removed_keys.where(F.col("table_name").isin("content_types", "records")).select(
        F.col("table_name").alias("parent_table"), F.col("key_id").alias("target_id"), F.col("removed_at").alias("at")
    )
