"""Global orderings without a single-task window.

A sort over the whole key set is range-partitioned; each row's place inside its partition
comes from the generated row id, and the partition offsets are a table with one row per
partition.  The sorted rows are checkpointed first so that both readings see one layout.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadquarry.operators.skew import lookup_join
from leadquarry.session import cut

#: Group tables up to this number of rows are sent to all tasks; larger ones are joined by shuffle.
BROADCAST_GROUPS = 200_000
_PID = "__pid"
_POS = "__pos"


def sorted_layout(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Globally sorted, checkpointed rows with partition number and position inside it."""
    mid = F.monotonically_increasing_id()
    return cut(
        df.orderBy(*order)
        .withColumn(_PID, F.shiftright(mid, 33))
        .withColumn(_POS, mid.bitwiseAND(F.lit((1 << 33) - 1)))
    )


def row_numbers(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Unique ranks 1..n.  ``order`` must end with a unique key."""
    laid = sorted_layout(df, order)
    sizes = laid.groupBy(_PID).agg(F.count("*").alias("__n"))
    before = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select(_PID, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    return (
        laid.join(F.broadcast(offsets), _PID)   # at most one row per shuffle partition
        .withColumn(name, F.col("__off") + F.col(_POS) + 1)
        .drop(_PID, _POS, "__off")
    )


def grouped_row_numbers(df: DataFrame, group: str, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Ranks 1..n inside each group, with groups larger than one task allowed."""
    numbered = cut(row_numbers(df, [F.asc(group), *order], "__g"))
    start = cut(numbered.groupBy(group).agg(F.min("__g").alias("__s")).withColumnRenamed(group, "__of"))
    if start.count() <= BROADCAST_GROUPS:      # one row per group; a group may hold any share of the rows
        start = F.broadcast(start)
    return (
        numbered.join(start, F.col(group).eqNullSafe(F.col("__of")))
        .drop("__of")
        .withColumn(name, F.col("__g") - F.col("__s") + 1)
        .drop("__g", "__s")
    )


def prefix_sums(df: DataFrame, group: str, order: Sequence[Column], values: Sequence[str]) -> DataFrame:
    """Exclusive running sums ``<value>_before`` of each value along the order, per group.

    ``df`` must be free of duplicate sort keys (aggregate first)."""
    laid = sorted_layout(df, [F.asc(group), *order])
    totals = laid.groupBy(_PID, group).agg(*[F.sum(v).alias(f"__t_{v}") for v in values])
    before = Window.partitionBy(group).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        _PID, group,
        *[F.coalesce(F.sum(f"__t_{v}").over(before), F.lit(0)).alias(f"__o_{v}") for v in values],
    )
    inside = Window.partitionBy(_PID, group).orderBy(_POS).rowsBetween(Window.unboundedPreceding, -1)
    running = laid.select(
        "*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"__r_{v}") for v in values]
    )
    out = running.join(offsets, [_PID, group])
    return out.select(
        *df.columns, *[(F.col(f"__o_{v}") + F.col(f"__r_{v}")).alias(f"{v}_before") for v in values]
    )


def average_ranks(scores: DataFrame, group: str = "method", score: str = "score") -> DataFrame:
    """Ascending ranks where ties share their mean rank: one row per ``(group, score)``.

    Columns: group, score, ``n`` (rows with that score) and ``avg_rank``."""
    counts = scores.groupBy(group, score).agg(F.count("*").alias("n"))
    pre = prefix_sums(counts, group, [F.asc(score)], ["n"])
    return pre.select(group, score, "n", (F.col("n_before") + (F.col("n") + 1) / 2).alias("avg_rank"))


def ensemble(scores: DataFrame, weights: dict[str, float] | None = None, id_col: str = "biz_id") -> DataFrame:
    """Rank ensemble of long ``(id, method, score)`` rows: mean rank over methods / n.

    A missing score takes no rank: such a row is averaged over the methods that score it, and a
    row that no method scores has a null score.
    ``weights`` maps a method to its weight (normalised here); absent means equal weights.
    """
    ids, scores = scores, cut(scores.where(F.col("score").isNotNull()).select(id_col, "method", "score"))
    ranks = cut(average_ranks(scores))
    # Binned scores tie by the thousand: rows of a heavy tie never meet on one key.
    per_row = lookup_join(scores, ranks.select("method", "score", "avg_rank"), ["method", "score"], ranks.select("method", "score", "n"))
    sizes = scores.groupBy("method").agg(F.count("*").alias("m"))     # one row per method
    if weights is None:
        weight = F.lit(1.0)
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        weight = F.create_map(*pairs)[F.col("method")]
    ranked = (
        per_row.join(F.broadcast(sizes), "method")
        .groupBy(id_col)
        .agg((F.sum(weight * F.col("avg_rank") / F.col("m")) / F.sum(weight)).alias("score"))
    )
    unscored = ids.groupBy(id_col).agg(F.count("score").alias("n")).where("n = 0")
    return ranked.unionByName(unscored.select(id_col, F.lit(None).cast("double").alias("score")))


def ranked_list(df: DataFrame, score: str, id_col: str = "biz_id", label: str | None = "is_customer",
                label_as: str = "is_known_customer") -> DataFrame:
    """All rows with ``rank`` 1..n by score descending; the label column is renamed."""
    out = row_numbers(df, [F.desc_nulls_last(score), F.asc(id_col)], "rank")
    return out.withColumnRenamed(label, label_as) if label else out


def top_per_segment(df: DataFrame, segment: str, score: str, n: int = 50, id_col: str = "biz_id") -> DataFrame:
    """Best ``n`` rows per segment; rows without a segment drop out.

    The row-number filter becomes a group limit below the shuffle, so a hot segment sends at
    most ``n`` rows per task."""
    w = Window.partitionBy(segment).orderBy(F.desc_nulls_last(score), F.asc(id_col))
    return (
        df.where(F.col(segment).isNotNull())
        .withColumn("segment_rank", F.row_number().over(w)).where(F.col("segment_rank") <= n)
    )


def head(df: DataFrame, score: str, n: int = 10, id_col: str = "biz_id") -> DataFrame:
    """The ``n`` best rows overall (take-ordered, no full sort)."""
    return df.orderBy(F.desc_nulls_last(score), F.asc(id_col)).limit(n)


def exact_quantiles_by_column(df: DataFrame, columns: Sequence[str], qs: Sequence[float],
                              discrete: bool = False) -> dict[str, list[float | None]]:
    """Quantiles of several columns from one shared sort: no task ever holds a whole column.

    Linear interpolation, or with ``discrete`` the smallest value that a share ``q`` of the rows
    does not exceed.  Only the at most ``2 * len(qs)`` rows a column at the wanted positions reach
    the driver, and the result is the same under any partitioning.
    """
    if not columns:
        return {}
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
    counts = long.where(F.col("v").isNotNull()).groupBy("c", "v").agg(F.count("*").alias("n"))
    pre = cut(prefix_sums(counts, "c", [F.asc("v")], ["n"]))
    totals = {r.c: r.n for r in pre.groupBy("c").agg(F.sum("n").alias("n")).collect()}

    def places(n: int, q: float) -> tuple[int, int]:
        if discrete:
            at = max(1, n - math.floor(n - q * n)) - 1
            return at, at
        at = int((n - 1) * q)
        return at, min(at + 1, n - 1)
    wanted = F.array().cast("array<bigint>")
    for c, n in totals.items():
        spots = sorted({p for q in qs for p in places(n, q)})
        wanted = F.when(F.col("c") == c, F.array(*[F.lit(p).cast("long") for p in spots])).otherwise(wanted)
    hit = F.filter(wanted, lambda s: (s >= F.col("n_before")) & (s < F.col("n_before") + F.col("n")))
    at = {(r.c, r.s): r.v for r in pre.select("c", "v", F.explode(hit).alias("s")).collect()}
    out: dict[str, list[float | None]] = {}
    for c in columns:
        n = totals.get(c)
        out[c] = [None] * len(qs) if not n else []
        for q in qs if n else ():
            lo, hi = places(n, q)
            share = 0.0 if discrete else (n - 1) * q - lo
            out[c].append(at[c, lo] + (at[c, hi] - at[c, lo]) * share)
    return out


def exact_quantiles(df: DataFrame, value: str, qs: Sequence[float]) -> list[float | None]:
    """Linear-interpolated quantiles of one column."""
    return exact_quantiles_by_column(df, [value], qs)[value]
