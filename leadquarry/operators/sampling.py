"""Exact-size, reproducible samples and splits.

A row's place is its ``md5(id:salt)``: the same in every engine and under any partitioning.
Exact sizes come from distributed ranks of that hash, never from one window task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadquarry.operators.rank import grouped_row_numbers, row_numbers
from leadquarry.session import cut


def place(id_col: str, salt: str | Column) -> Column:
    salt = F.lit(salt) if isinstance(salt, str) else salt
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(":"), salt.cast("string")).cast("binary"))


def sample_n(df: DataFrame, n: int, salt: str, id_col: str = "biz_id") -> DataFrame:
    """Exactly ``min(n, rows)`` rows: the ones with the smallest hash.

    A hash cut-off keeps slightly more than ``n`` candidates; only those are ranked.
    """
    total = df.count()
    keyed = df.withColumn("__h", place(id_col, salt))
    if total > n > 0:
        keyed = keyed.where(F.col("__h") < _cutoff(n, total))
        if keyed.count() < n:                       # a run of bad luck beyond six sigma
            keyed = df.withColumn("__h", place(id_col, salt))
    ranked = row_numbers(keyed, [F.asc("__h"), F.asc(id_col)], "__n")
    return ranked.where(F.col("__n") <= n).drop("__h", "__n")


def _cutoff(n: int, total: int) -> str:
    share = (n + 6 * math.sqrt(n) + 10) / total
    return "g" if share >= 1 else f"{int(share * 16 ** 15):015x}"    # 'g' sorts after every digit


def holdout_split(df: DataFrame, seed: int | str, label: str = "is_customer", fraction: float = 0.2,
                  id_col: str = "biz_id", salt: str = "holdout") -> DataFrame:
    """Adds ``is_holdout`` and ``y_train``: a rounded-up fraction of the positives is held out
    and looks unlabelled while training."""
    positives = df.where(F.col(label) == 1).select(id_col)
    n = math.ceil(fraction * positives.count() - 1e-9)
    chosen = sample_n(positives, n, f"{salt}:{seed}", id_col).withColumn("__held", F.lit(True))
    out = df.join(chosen, id_col, "left").withColumn("is_holdout", F.coalesce("__held", F.lit(False))).drop("__held")
    return out.withColumn(
        "y_train", F.when((F.col(label) == 1) & ~F.col("is_holdout"), 1).otherwise(0))


def spies(train: DataFrame, seed: int | str, ratio: float = 0.15, at_least: int = 20,
          label: str = "y_train", id_col: str = "biz_id") -> DataFrame:
    """Ids of the training positives hidden among the unlabelled (never more than exist)."""
    positives = train.where(F.col(label) == 1).select(id_col)
    p = positives.count()
    return sample_n(positives, min(p, max(int(ratio * p), at_least)), f"spy:{seed}", id_col)


def pseudo_negatives(train: DataFrame, seed: int | str, rounds: int = 50, multiple: int = 3,
                     label: str = "y_train", id_col: str = "biz_id") -> DataFrame:
    """``(id, round)`` rows: per round ``multiple`` x positives unlabelled ids, drawn without
    replacement and independently between rounds.

    Rows are exploded over rounds only where they pass the round's hash cut-off, which leaves
    little more than the sample itself; the survivors are ranked per round.
    """
    sizes = train.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("u")).first()
    n = multiple * sizes.p
    if n > sizes.u:
        raise ValueError(f"{n} pseudo-negatives wanted, {sizes.u} unlabelled rows present")
    pool = train.where(F.col(label) == 0).select(id_col)

    def candidates(cut_at: str) -> DataFrame:
        hashed = F.transform(
            F.sequence(F.lit(0), F.lit(rounds - 1)),
            lambda r: F.struct(r.alias("round"), F.md5(F.concat(
                F.col(id_col).cast("string"), F.lit(f":neg:{seed}:"), r.cast("string")).cast("binary")).alias("h")))
        return pool.select(id_col, F.inline(F.filter(hashed, lambda x: x.h < cut_at)))

    drawn = cut(candidates(_cutoff(n, sizes.u)))
    short = drawn.groupBy("round").count().where(F.col("count") < n).count()
    if short or drawn.select("round").distinct().count() < rounds:
        drawn = candidates("g")
    ranked = grouped_row_numbers(drawn, "round", [F.asc("h"), F.asc(id_col)], "__n")
    return ranked.where(F.col("__n") <= n).select(id_col, "round")


def stratified_split(df: DataFrame, label: str, seed: int | str, shares: tuple[float, float] = (0.6, 0.2),
                     id_col: str = "biz_id") -> DataFrame:
    """``split`` in train / val / test, cut at the shares inside each class."""
    keyed = df.withColumn("__h", place(id_col, f"split:{seed}"))
    ranked = cut(grouped_row_numbers(keyed, label, [F.asc("__h"), F.asc(id_col)], "__n"))
    sizes = F.broadcast(ranked.groupBy(label).agg(F.count("*").alias("__c")))     # one row per class
    out = ranked.join(sizes, label)
    a, b = F.round(F.col("__c") * shares[0]), F.round(F.col("__c") * (shares[0] + shares[1]))
    return out.withColumn(
        "split", F.when(F.col("__n") <= a, "train").when(F.col("__n") <= b, "val").otherwise("test")
    ).drop("__h", "__n", "__c")


def folds(df: DataFrame, k: int, seed: int | str, id_col: str = "biz_id") -> DataFrame:
    """``fold`` 0..k-1, sizes equal to within one row."""
    ranked = row_numbers(df.withColumn("__h", place(id_col, f"fold:{seed}")), [F.asc("__h"), F.asc(id_col)], "__n")
    return ranked.withColumn("fold", ((F.col("__n") - 1) % k).cast("int")).drop("__h", "__n")
