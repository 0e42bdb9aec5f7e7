"""Base learners behind one small interface.

``prepare`` turns a feature table into a compact checkpointed form once; every fit and every
score then reads that form.

* ``Scorecard``: binned log-odds.  All bagging rounds are fitted in one aggregation and scored
  in one pass over the rows, so fifty rounds cost about as much as one.
* ``TreesOrLinear``: any MLlib classifier (boosted trees as in the original method, forest,
  tree, logistic), one distributed fit per round.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier)
from pyspark.ml.feature import Bucketizer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadquarry.operators.rank import exact_quantiles_by_column, prefix_sums
from leadquarry.session import bare, cut

#: Weights of a scorecard up to this number are sent to the scoring tasks; more stay a table.
BROADCAST_WEIGHTS = 4_000_000
#: Category codes up to this number are sent to the coding tasks; more are joined by shuffle.
BROADCAST_CODES = 200_000


def split_types(df: DataFrame, columns: Sequence[str]) -> tuple[list[str], list[str]]:
    types = dict(df.dtypes)
    text = [c for c in columns if types[c] in ("string", "boolean")]
    return [c for c in columns if c not in text], text


def frequent_categories(df: DataFrame, columns: Sequence[str], limit: int) -> dict[str, list[str]]:
    """The ``limit - 1`` most frequent values of each column (ties: smaller value first).

    Counted in one pass over long rows and pruned per task by the top-n limit."""
    if not columns:
        return {}
    from pyspark.sql import Window
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")).select("x.*")
    counts = long.where(F.col("v").isNotNull()).groupBy("c", "v").agg(F.count("*").alias("n"))
    w = Window.partitionBy("c").orderBy(F.desc("n"), F.asc("v"))
    top = counts.withColumn("r", F.row_number().over(w)).where(F.col("r") < limit).orderBy("c", "r").collect()
    return {c: [x.v for x in top if x.c == c] for c in columns}


def category_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(c, v, code): every value of each column, numbered from 0 by falling frequency, then by value."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")).select("x.*")
    counts = long.where(F.col("v").isNotNull()).groupBy("c", "v").agg(F.count("*").alias("n")).withColumn("one", F.lit(1))
    return prefix_sums(counts, "c", [F.desc("n"), F.asc("v")], ["one"]).select("c", "v", F.col("one_before").cast("int").alias("code"))


def with_codes(df: DataFrame, columns: Sequence[str], codes: DataFrame, few: bool, id_col: str) -> DataFrame:
    """Adds ``__b_<column>``: the value's code, null for missing values.

    Large code tables are joined by shuffle; missing values get keys of their own that match
    nothing, so that they do not meet in one task."""
    for c in columns:
        own = codes.where(F.col("c") == c).select(F.col("v").alias("__v"), F.col("code").alias(f"__b_{c}"))
        key = F.col(c).cast("string")
        if not few:
            key = F.coalesce(key, F.concat(F.lit("\u0000"), (F.xxhash64(id_col) % 1024).cast("string")))
        df = df.withColumn("__k", key).join(F.broadcast(own) if few else own, F.col("__k") == F.col("__v"), "left").drop("__k", "__v")
    return df


class Scorecard:
    """Naive-Bayes style scorecard: per feature and bin a smoothed log-odds weight.

    Numbers are cut at exact quantiles, every category is a bin of its own."""

    def __init__(self, bins: int = 10):
        self.bins = bins

    def prepare(self, features: DataFrame, columns: Sequence[str], id_col: str = "biz_id") -> "PreparedScorecard":
        numeric, text = split_types(features, columns)
        probs = [i / self.bins for i in range(1, self.bins)]
        edges_of = exact_quantiles_by_column(features, numeric, probs, discrete=True)
        splits, sizes, out = [], [], features
        for c in numeric:
            edges = sorted({e for e in edges_of[c] if e is not None} or {0.0})
            splits.append([-math.inf, *edges, math.inf])
            sizes.append(len(edges) + 2)                # one bin more for missing
            out = out.withColumn(f"__x_{c}", F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))))
        if numeric:
            out = Bucketizer(splitsArray=splits, inputCols=[f"__x_{c}" for c in numeric],
                             outputCols=[f"__b_{c}" for c in numeric], handleInvalid="keep").transform(out)
        coded = []
        if text:
            codes = cut(category_codes(features, text))
            n_values = {r.c: r["count"] for r in codes.groupBy("c").count().collect()}
            out = with_codes(out, text, codes, sum(n_values.values()) <= BROADCAST_CODES, id_col)
            coded = [F.coalesce(f"__b_{c}", F.lit(n_values.get(c, 0))).cast("int") for c in text]
            sizes += [n_values.get(c, 0) + 1 for c in text]
        binned = out.select(id_col, F.array(*[F.col(f"__b_{c}").cast("int") for c in numeric], *coded).alias("bins"))
        return PreparedScorecard(cut(binned), [*numeric, *text], sizes, id_col)


class PreparedScorecard:
    def __init__(self, binned: DataFrame, columns: list[str], sizes: list[int], id_col: str):
        self.binned, self.columns, self.sizes, self.id_col = binned, columns, sizes, id_col

    def _weights(self, negatives: DataFrame, rounds: int, positives: DataFrame) -> tuple[DataFrame, np.ndarray]:
        """Table ``(pos, bin, w)`` of weights per round, and the intercepts.

        A bin that no training row has gets the feature's empty weight.  The intercepts hold the
        empty weights of all features, the table holds what its bins differ by, so absent bins
        add nothing.  Counts come as ``(pos, bin, w)`` and ``(pos, bin, round, w)``."""
        p_total = positives.where("pos = 0").agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
        n_total = np.zeros(rounds)
        for r in negatives.where("pos = 0").groupBy("round").agg(F.sum("w").alias("w")).collect():   # one row per round
            n_total[r["round"]] = r.w
        size = np.array(self.sizes, dtype=float)[:, None]
        empty = np.log(1 / (p_total + size)) - np.log(1 / (n_total[None, :] + size))
        intercept = np.log(max(p_total, 1e-12) / np.maximum(n_total, 1e-12)) + empty.sum(axis=0)
        per_round = negatives.groupBy("pos", "bin").agg(F.map_from_entries(F.collect_list(F.struct("round", "w"))).alias("n"))
        both = positives.select("pos", "bin", F.col("w").alias("p")).join(per_round, ["pos", "bin"], "full")
        more = F.transform(F.sequence(F.lit(0), F.lit(rounds - 1)), lambda r: F.log1p(F.coalesce(F.col("p"), F.lit(0.0)))
                           - F.log1p(F.coalesce(F.element_at(F.col("n"), r), F.lit(0.0)).cast("double")))
        return cut(both.select("pos", "bin", more.alias("w"))), intercept

    def _count(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        return (
            rows.join(self.binned, self.id_col).select(*keys, "w", F.posexplode("bins").alias("pos", "bin"))
            .groupBy(*keys, "pos", "bin").agg(F.sum(F.col("w").cast("double")).alias("w"))
        )

    def _score(self, rows: DataFrame, weights: DataFrame, intercept: np.ndarray) -> DataFrame:
        """Mean sigmoid over the rounds outside ``skip``: in one pass where the counted weights are
        few enough to be sent to the tasks, else by a join on the bins."""
        if weights.count() * len(intercept) > BROADCAST_WEIGHTS:
            return self._score_joined(rows, weights, intercept)
        id_col, starts = self.id_col, np.cumsum([0, *self.sizes])
        found = weights.toPandas()                     # bounded by the count above
        slots = starts[found["pos"].to_numpy(int)] + found["bin"].to_numpy(int)
        order = np.argsort(slots)
        table = np.stack(found["w"].to_numpy())[order] if len(found) else np.zeros((0, len(intercept)))
        shared = rows.sparkSession.sparkContext.broadcast((slots[order], np.vstack([table, np.zeros(len(intercept))]), intercept, starts))

        def run(batches):
            keys, w, b0, first = shared.value
            for pdf in batches:
                if not len(pdf):
                    continue
                wanted = np.stack(pdf["bins"].to_numpy()) + first[None, :-1]
                at = np.searchsorted(keys, wanted)
                at[(at == len(keys)) | (np.append(keys, -1)[at] != wanted)] = len(keys)     # the row of zeros
                z = np.tile(b0, (len(pdf), 1))
                for f in range(at.shape[1]):
                    z += w[at[:, f]]
                p = 1.0 / (1.0 + np.exp(-z))
                keep = np.ones_like(p)
                for i, skip in enumerate(pdf["skip"]):
                    if skip is not None and len(skip):
                        keep[i, np.asarray(skip, dtype=int)] = 0
                used = keep.sum(axis=1)
                score = np.where(used > 0, (p * keep).sum(axis=1) / np.maximum(used, 1), np.nan)
                yield pd.DataFrame({id_col: pdf[id_col], "score": score, "n_rounds": used.astype("int64")})

        out = rows.mapInPandas(run, f"{id_col} long, score double, n_rounds long")
        return out.withColumn("score", F.when(F.col("n_rounds") > 0, F.col("score")))

    def _score_joined(self, rows: DataFrame, weights: DataFrame, intercept: np.ndarray) -> DataFrame:
        rounds = len(intercept)
        long = rows.select(self.id_col, F.posexplode("bins").alias("pos", "bin")).join(weights, ["pos", "bin"], "left")
        sums = long.groupBy(self.id_col).agg(*[F.coalesce(F.sum(F.col("w")[r]), F.lit(0.0)).alias(f"z{r}") for r in range(rounds)])
        p = F.array(*[1 / (1 + F.exp(-(F.col(f"z{r}") + float(intercept[r])))) for r in range(rounds)])
        skipped = F.coalesce("skip", F.array().cast("array<int>"))
        used = F.array_except(F.sequence(F.lit(0), F.lit(rounds - 1)), skipped)
        total = F.aggregate(used, F.lit(0.0), lambda a, r: a + F.get("p", r))
        return rows.select(self.id_col, "skip").join(sums.select(self.id_col, p.alias("p")), self.id_col).select(
            self.id_col, F.try_divide(total, F.size(used)).alias("score"), F.size(used).cast("long").alias("n_rounds"))

    def fit_score(self, labels: DataFrame) -> DataFrame:
        """``labels`` = ``(id, y, w)`` training rows; scores for every row."""
        counts = cut(self._count(labels, ["y"]))
        w, b0 = self._weights(counts.where("y = 0").withColumn("round", F.lit(0)), 1, counts.where("y = 1"))
        rows = self.binned.withColumn("skip", F.lit(None).cast("array<int>"))
        return self._score(rows, w, b0).select(self.id_col, "score")

    def fit_score_rounds(self, positives: DataFrame, negatives: DataFrame, rounds: int,
                         negative_weights: Sequence[float]) -> list[DataFrame]:
        """Out-of-bag mean scores, one table per negative weight; the negatives are counted once."""
        counts = cut(self._count(negatives.withColumn("w", F.lit(1.0)), ["round"]))
        positive = cut(self._count(positives, []))
        skips = negatives.groupBy(self.id_col).agg(F.collect_list("round").alias("skip"))   # at most one per round
        rows = cut(self.binned.join(skips, self.id_col, "left"))
        out = []
        for nw in negative_weights:
            w, b0 = self._weights(counts.withColumn("w", F.col("w") * nw), rounds, positive)
            out.append(self._score(rows, w, b0))
        return out


def boosted_trees(seed: int = 42, iterations: int = 200) -> GBTClassifier:
    return GBTClassifier(maxIter=iterations, stepSize=0.05, maxDepth=5, minInstancesPerNode=20, maxBins=64,
                         seed=seed, featuresCol="features", labelCol="y", weightCol="w")


def random_forest(seed: int = 42, trees: int = 100, depth: int = 10, min_leaf: int = 1) -> RandomForestClassifier:
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf, maxBins=64,
                                  seed=seed, featuresCol="features", labelCol="y", weightCol="w")


def decision_tree(seed: int = 42, depth: int = 8, min_leaf: int = 30) -> DecisionTreeClassifier:
    return DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=min_leaf, maxBins=64, seed=seed,
                                  featuresCol="features", labelCol="y", weightCol="w", leafCol="leaf")


def logistic(seed: int = 42, reg: float = 0.01) -> LogisticRegression:
    return LogisticRegression(maxIter=100, regParam=reg, featuresCol="features", labelCol="y", weightCol="w")


def assemble(features: DataFrame, columns: Sequence[str], id_col: str = "biz_id", scale: bool = False) -> DataFrame:
    """``(id, features vector)``: every category indexed by frequency, exact medians for missing
    numbers with a missing flag beside each."""
    numeric, text = split_types(features, columns)
    df = features.select(
        id_col, *[F.col(c).cast("double").alias(c) for c in numeric],
        *[F.coalesce(F.col(c).cast("string"), F.lit("__NA__")).alias(c) for c in text])
    missing = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in numeric]).first() if numeric else {}
    holes = [c for c in numeric if missing[c]]
    medians = exact_quantiles_by_column(df, holes, [0.5])
    df = df.withColumns({f"{c}_missing": F.col(c).isNull().cast("double") for c in holes})
    df = df.withColumns({c: F.coalesce(F.col(c), F.lit(medians[c][0] if medians[c][0] is not None else 0.0)) for c in holes})
    stages = []
    if text:
        stages.append(StringIndexer(inputCols=text, outputCols=[f"{c}__i" for c in text], handleInvalid="keep"))
    inputs = [*numeric, *[f"{c}_missing" for c in holes], *[f"{c}__i" for c in text]]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features" if not scale else "raw"))
    if scale:
        stages.append(StandardScaler(inputCol="raw", outputCol="features", withMean=True))
    return Pipeline(stages=stages).fit(df).transform(df).select(id_col, "features")


def wide_enough(estimator, vectors: DataFrame):
    """Raises a tree learner's number of bins to the largest category count of the features."""
    if estimator.hasParam("maxBins"):
        attrs = vectors.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
        most = max((len(a.get("vals", ())) for a in attrs.get("nominal", ())), default=0)
        if most > estimator.getMaxBins():
            estimator = estimator.copy({estimator.maxBins: most})
    return estimator


class TreesOrLinear:
    """Adapter for an MLlib classifier factory ``make(seed) -> estimator``."""

    def __init__(self, make: Callable[..., object] = boosted_trees, seed: int = 42, scale: bool = False):
        self.make, self.seed, self.scale = make, seed, scale

    def prepare(self, features: DataFrame, columns: Sequence[str], id_col: str = "biz_id") -> "PreparedVectors":
        vectors = assemble(features, columns, id_col, self.scale)
        make = self.make
        return PreparedVectors(cut(vectors), lambda seed: wide_enough(make(seed), vectors), self.seed, id_col)


class PreparedVectors:
    def __init__(self, vectors: DataFrame, make, seed: int, id_col: str):
        self.vectors, self.make, self.seed, self.id_col = vectors, make, seed, id_col

    def _fit(self, labels: DataFrame, seed: int):
        return bare(self.make(seed).fit(self.vectors.join(labels, self.id_col)), self.vectors.sparkSession)

    def _proba(self, model, df: DataFrame) -> DataFrame:
        keep = [c for c in df.columns]
        return model.transform(df).select(*keep, vector_to_array("probability")[1].alias("score"))

    def fit_score(self, labels: DataFrame) -> DataFrame:
        return self._proba(self._fit(labels, self.seed), self.vectors).select(self.id_col, "score")

    def fit_score_rounds(self, positives: DataFrame, negatives: DataFrame, rounds: int,
                         negative_weights: Sequence[float]) -> list[DataFrame]:
        skips = negatives.groupBy(self.id_col).agg(F.collect_list("round").alias("skip"))
        base = cut(self.vectors.join(skips, self.id_col, "left"))
        pos = cut(positives.select(self.id_col, F.lit(1).alias("y"), "w"))
        negatives = cut(negatives)
        out = []
        for nw in negative_weights:
            acc = base.withColumn("total", F.lit(0.0)).withColumn("n_rounds", F.lit(0).cast("long"))
            for r in range(rounds):
                neg = negatives.where(F.col("round") == r).select(self.id_col, F.lit(0).alias("y"), F.lit(float(nw)).alias("w"))
                model = self._fit(pos.unionByName(neg), self.seed + r)
                scored = self._proba(model, acc)
                oob = F.coalesce(~F.array_contains("skip", r), F.lit(True))
                acc = scored.select(
                    self.id_col, "features", "skip",
                    (F.col("total") + F.when(oob, F.col("score")).otherwise(0.0)).alias("total"),
                    (F.col("n_rounds") + oob.cast("long")).alias("n_rounds"))
                if r % 10 == 9:                            # keep the plan short
                    acc = cut(acc)
            out.append(acc.select(self.id_col, F.try_divide("total", "n_rounds").alias("score"), "n_rounds"))
        return out
