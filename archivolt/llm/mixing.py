"""Mixing sources to target weights (problem 9).

Documents get hash-random keys and are range-sorted by (source, key); prefix sums of token counts, taken over the sorted
partitions, tell where each source's budget cuts. A source too small for its budget is used again from its start, at
most ``max_repeats`` times; what it then lacks is shared out among the others in proportion to their weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.llm.ordinals import prefix_sums
from archivolt.plans.runtime import cut


def budgets(tokens: dict[str, int], weights: list[tuple[str, float, int]], total: int | None = None) -> dict[str, float]:
    """Each source's budget in tokens: in proportion to the weights, at most ``max_repeats`` times what the source
    has; sources that reach their limit leave the rest to the others. ``total``: by default, all tokens of the
    sources with a weight."""
    usable = {s: (w, r * tokens[s]) for s, w, r in weights if s in tokens and w is not None and w > 0 and r is not None and r > 0 and tokens[s] > 0}
    left = float(sum(tokens[s] for s in usable) if total is None else total)
    out: dict[str, float] = {}
    while usable:
        unit = left / sum(w for w, _ in usable.values())
        full = [s for s, (w, limit) in usable.items() if w * unit >= limit]
        if not full:
            return out | {s: w * unit for s, (w, _) in usable.items()}
        for s in full:
            out[s] = float(usable.pop(s)[1])
            left -= out[s]
    return out


def mixture(counts: DataFrame, id_col: str, source_col: str, weights: list[tuple[str, float, int]], total: int | None = None, seed: int = 0) -> DataFrame:
    """``source``, the id column, ``n_tokens``, ``uses``: every document of the mixture with how often it is used.

    A null source, a source without a positive weight and a source that ``weights`` does not name contribute nothing;
    a document without tokens is never used; a named source without documents is only missing. Repeated rows are
    documents of their own, ties in the random key are broken by place. Each source misses its budget by half a
    document at most: the document on the cut is used if at least half of it lies within. The weights are a small
    table the caller has read; of the data only one total per source reaches the driver.
    """
    named = [(s, float(w or 0), int(r or 0)) for s, w, r in weights if s is not None]
    wanted = [s for s, w, r in named if w > 0 and r > 0]
    rows = counts.select(F.col(source_col).alias("source"), id_col, "n_tokens", F.xxhash64(F.lit(seed), F.col(id_col)).alias("key")).where(F.col("source").isin(wanted) & (F.col("n_tokens") > 0))
    rows = cut(rows)  # the range partitioner samples its input, and texts are to be counted once
    fixed = cut(rows.repartitionByRange("source", "key").sortWithinPartitions("source", "key", id_col))
    have = {r["source"]: r["t"] for r in fixed.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    plan = []
    for source, budget in budgets(have, named, total).items():
        rounds = int(budget // have[source])
        plan.append((source, rounds, budget - rounds * have[source]))
    plan_rows = counts.sparkSession.createDataFrame(plan, "source string, rounds int, rest double")
    placed = prefix_sums(fixed, "source", "n_tokens").join(F.broadcast(plan_rows), "source")
    uses = F.col("rounds") + F.when(F.col("before") + F.col("n_tokens") / 2 <= F.col("rest"), 1).otherwise(0)
    return placed.select("source", id_col, "n_tokens", uses.alias("uses")).where("uses > 0")


def shares(mixed: DataFrame, weights: list[tuple[str, float, int]]) -> DataFrame:
    """Per named source, those without documents too: ``weight``, ``target_share``, ``tokens``, ``share`` reached,
    ``documents`` and ``max_uses``."""
    named = [(s, float(w or 0)) for s, w, _ in weights if s is not None]
    whole = sum(w for _, w in named) or 1.0
    wanted = mixed.sparkSession.createDataFrame([(s, w, w / whole) for s, w in named], "source string, weight double, target_share double")
    got = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.count("*").alias("documents"), F.max("uses").alias("max_uses"))
    all_tokens = got.agg(F.sum("tokens").alias("all_tokens"))
    return (
        F.broadcast(wanted).join(got, "source", "left").join(F.broadcast(all_tokens))  # one row
        .select("source", "weight", F.round("target_share", 6).alias("target_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
                F.round(F.coalesce("tokens", F.lit(0)) / F.col("all_tokens"), 6).alias("share"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("max_uses", F.lit(0)).alias("max_uses"))
    )
