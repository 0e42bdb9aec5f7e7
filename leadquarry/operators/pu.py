"""Rankers that learn from positives and unlabelled rows.

``train`` tables hold ``id, y_train`` and optionally ``positive_weight``; rankers return
``(id, score)`` for every row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadquarry.operators.sampling import pseudo_negatives, sample_n
from leadquarry.session import cut

MIN_NEGATIVE_WEIGHT = 0.05      # fixed value


def _weight(train: DataFrame) -> Column:
    return F.col("positive_weight") if "positive_weight" in train.columns else F.lit(1.0)


def naive_scores(prepared, train: DataFrame, label: str = "y_train") -> DataFrame:
    """Every unlabelled row taken as negative."""
    return prepared.fit_score(train.select(prepared.id_col, F.col(label).alias("y"), F.lit(1.0).alias("w")))


def negative_weight(pi_hat: float | None) -> float:
    return 1.0 if pi_hat is None else max(MIN_NEGATIVE_WEIGHT, 1.0 - pi_hat)


def bagging(prepared, train: DataFrame, seed: int = 42, rounds: int = 50, multiple: int = 3,
            priors: Sequence[float | None] = (None,), weighted: bool = True,
            negatives: DataFrame | None = None) -> list[DataFrame]:
    """Out-of-bag mean scores ``(id, score, n_rounds)``, one table per entry of ``priors``.

    ``None`` is plain bagging; a prior weights the pseudo-negatives by one minus it.  All
    entries share one drawn sample.  Positives train every round and are always out of bag.  A
    row that was a pseudo-negative in every round has a null score and ``n_rounds`` 0.
    """
    id_col = prepared.id_col
    if negatives is None:
        negatives = cut(pseudo_negatives(train, seed, rounds, multiple, id_col=id_col))
    w = _weight(train) if weighted else F.lit(1.0)
    positives = train.where("y_train = 1").select(id_col, w.cast("double").alias("w"))
    return prepared.fit_score_rounds(positives, negatives, rounds, [negative_weight(p) for p in priors])


def reliable_negatives(base_scores: DataFrame, train: DataFrame, threshold: float, id_col: str = "biz_id") -> DataFrame:
    """Unlabelled ids whose base score lies strictly below the threshold."""
    return (
        train.where("y_train = 0").select(id_col)
        .join(base_scores.where(F.col("score") < threshold).select(id_col), id_col)
    )


def retrain(prepared, train: DataFrame, negatives: DataFrame) -> DataFrame:
    """Weighted positives against reliable negatives; scores for all rows."""
    id_col = prepared.id_col
    labels = train.where("y_train = 1").select(id_col, F.lit(1).alias("y"), _weight(train).cast("double").alias("w")).unionByName(
        negatives.select(id_col, F.lit(0).alias("y"), F.lit(1.0).alias("w")))
    return prepared.fit_score(labels)


def corrected(score: Column, c_hat: float) -> Column:
    """Score divided by the labelling probability, clipped to [0, 1]; unchanged if c <= 0."""
    return score if c_hat <= 0 else F.least(F.lit(1.0), F.greatest(F.lit(0.0), score / F.lit(c_hat)))


def elkan_noto(prepared, train: DataFrame, seed: int = 42, fraction: float = 0.2) -> tuple[DataFrame, float]:
    """Nested split of the training positives, one fit, c = mean score of the hidden part."""
    import math
    id_col = prepared.id_col
    positives = train.where("y_train = 1").select(id_col)
    n = math.ceil(fraction * positives.count() - 1e-9)
    hidden = cut(sample_n(positives, n, f"c-estimation:{seed}", id_col))
    labels = train.join(hidden.withColumn("h", F.lit(1)), id_col, "left").select(
        id_col, F.when(F.col("h").isNull(), F.col("y_train")).otherwise(0).alias("y"), F.lit(1.0).alias("w"))
    raw = cut(prepared.fit_score(labels))
    c = raw.join(hidden, id_col, "left_semi").agg(F.avg("score")).first()[0] or 0.0
    return raw.withColumn("score", corrected(F.col("score"), c)), c


def over_seeds(score_fn: Callable[[int], DataFrame], seeds: Sequence[int]) -> DataFrame:
    """Long ``(id, seed, score)`` of any seeded ranker."""
    out = None
    for s in seeds:
        part = cut(score_fn(s).withColumn("seed", F.lit(s)))
        out = part if out is None else out.unionByName(part)
    return out
