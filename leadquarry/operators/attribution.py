"""Attribution of tree scores to features, row by row.

Path-dependent Shapley values: a feature that is not known sends a row down both branches, weighted by
the training rows that went each way.  A leaf contributes to the features on its path alone, so its
share is a polynomial in as many factors as the path has features; all rows of a batch are worked out
together.  The model goes to the tasks as a table of paths, whose size is the model's, not the data's.

Attributions and the base value add up to the model's score of the row: the margin (half the log-odds)
of boosted trees, the probability of a forest.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadquarry.session import shared_folder

#: Paths of at most so many features are tabled by pattern: 2 to that power rows of numbers.
PATTERN_FEATURES = 8
#: Conditions whose outcome for a batch is kept beside it, a byte a row each.
KEPT_CONDITIONS = 256


@dataclass(frozen=True)
class Path:
    """A leaf: its value, and per feature on the way to it the conditions and the share of training rows that meet them."""
    value: float
    features: tuple[int, ...]
    shares: tuple[float, ...]
    conditions: tuple[tuple, ...]  # per feature: (split values, go left, categorical) of each split


def _node_rows(model, spark) -> list[list[dict]]:
    """The nodes of every tree by their number, as the model writes them."""
    path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    model.write().save(path)
    rows = spark.read.parquet(f"{path}/data").collect()  # the model itself
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    trees: dict[int, dict[int, dict]] = {}
    for r in rows:
        d = r.asDict(recursive=True)
        node = d.get("nodeData", d)
        trees.setdefault(d.get("treeID", 0), {})[node["id"]] = node
    return [[t[i] for i in sorted(t)] for _, t in sorted(trees.items())]


def tree_paths(model, spark) -> tuple[list[Path], float]:
    """All leaves of a boosted or forest model, and the mean score over the training rows that they imply."""
    boosted = isinstance(model, GBTClassificationModel)
    weights = list(model.treeWeights) if boosted else [1.0 / len(model.trees)] * len(model.trees)
    found: list[Path] = []

    def cover(node: dict) -> float:
        stats = node["impurityStats"]
        return stats[0] if boosted else sum(stats)

    def value(node: dict) -> float:
        return node["prediction"] if boosted else node["impurityStats"][1] / sum(node["impurityStats"])
    for nodes, weight in zip(_node_rows(model, spark), weights):
        todo = [(0, {})]
        while todo:
            at, way = todo.pop()
            node = nodes[at]
            if node["leftChild"] < 0:
                found.append(Path(weight * value(node), tuple(way), tuple(w[0] for w in way.values()), tuple(w[1] for w in way.values())))
                continue
            split = node["split"]
            f, cut = split["featureIndex"], tuple(split["leftCategoriesOrThreshold"])
            for child, left in ((node["leftChild"], True), (node["rightChild"], False)):
                share, conditions = way.get(f, (1.0, ()))
                share *= cover(nodes[child]) / cover(node)
                todo.append((child, way | {f: (share, (*conditions, (cut, left, split["numCategories"] >= 0)))}))
    return found, sum(p.value * math.prod(p.shares) for p in found)


def _meets(x: np.ndarray, conditions: tuple) -> np.ndarray:
    out = np.ones(len(x), bool)
    for cut, left, categorical in conditions:
        out &= (np.isin(x, cut) if categorical else x <= cut[0]) == left
    return out


def _added(p: Path, met: np.ndarray) -> np.ndarray:
    """What the path adds to each of its features; ``met`` has a row per feature: 1 where it is met, else 0."""
    d, n = met.shape
    size = np.array([math.factorial(k) * math.factorial(d - 1 - k) / math.factorial(d) for k in range(d)])
    out = np.zeros((d, n))
    for i in range(d):
        # Coefficient k: the weight of all sets of k other features being known.
        known = np.zeros((d, n))
        known[0] = 1.0
        for j in range(d):
            if j != i:
                known[1:], known[0] = known[1:] * p.shares[j] + known[:-1] * met[j], known[0] * p.shares[j]
        out[i] = p.value * (met[i] - p.shares[i]) * (size @ known)
    return out


def pattern_tables(paths: list[Path]) -> list[np.ndarray | None]:
    """Per path what it adds by the pattern of features that a row meets (bit i: feature i); none for long paths."""
    return [_added(p, (np.arange(1 << len(p.features)) >> np.arange(len(p.features))[:, None] & 1).astype(float))
            if len(p.features) <= PATTERN_FEATURES else None for p in paths]


def path_attributions(paths: list[Path], x: np.ndarray, tables: list[np.ndarray | None] | None = None) -> np.ndarray:
    """One row of attributions per row of ``x``.

    A path sees of a row only which of its features are met, so what it adds is looked up by that pattern."""
    columns, out = np.ascontiguousarray(x.T), np.zeros(x.shape[::-1])
    met_by: dict[tuple, np.ndarray] = {}  # paths of a tree, which follow one another, share most of their conditions
    for p, table in zip(paths, pattern_tables(paths) if tables is None else tables):
        if len(met_by) > KEPT_CONDITIONS:
            met_by.clear()
        met = []
        for f, conditions in zip(p.features, p.conditions):
            if (f, conditions) not in met_by:
                met_by[f, conditions] = _meets(columns[f], conditions)
            met.append(met_by[f, conditions])
        if table is None:
            for f, added in zip(p.features, _added(p, np.array(met, float).reshape(-1, len(x)))):
                out[f] += added
            continue
        pattern = np.zeros(len(x), np.uint8)
        for i, m in enumerate(met):
            pattern |= m.view(np.uint8) << np.uint8(i)
        pattern = pattern.astype(np.intp)
        for f, by_pattern in zip(p.features, table):
            out[f] += by_pattern.take(pattern)
    return np.ascontiguousarray(out.T)


def attributions(model, vectors: DataFrame, id_col: str = "biz_id", features: str = "features") -> DataFrame:
    """``(id, base, score, attribution array)`` of every row; null features or values are not allowed, as in the model."""
    paths, base = tree_paths(model, vectors.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = pattern_tables(paths)
        for pdf in batches:
            x = np.array(pdf["x"].tolist(), float).reshape(len(pdf), -1)
            found = path_attributions(paths, x, tables) if len(pdf) else x
            yield pd.DataFrame({id_col: pdf[id_col], "base": base, "score": base + found.sum(1), "attribution": list(found)})

    kind = dict(vectors.dtypes)[id_col]
    return vectors.select(id_col, vector_to_array(features).alias("x")).mapInPandas(
        run, f"{id_col} {kind}, base double, score double, attribution array<double>")


def attribution_summary(attributed: DataFrame, names: list[str], top: int = 20) -> DataFrame:
    """feature, mean_abs, mean: the ``top`` features by mean absolute attribution."""
    long = attributed.select(F.posexplode("attribution").alias("slot", "a"))
    named = F.array(*[F.lit(n) for n in names])
    return (
        long.groupBy("slot").agg(F.avg(F.abs("a")).alias("mean_abs"), F.avg("a").alias("mean"))
        .select(F.get(named, F.col("slot")).alias("feature"), "mean_abs", "mean")
        .orderBy(F.desc("mean_abs"), "feature").limit(top)
    )
