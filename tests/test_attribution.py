"""Attributions against all subsets of features, and against the model's own scores."""

import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import functions as F

from leadquarry.operators import attribution as A


@pytest.fixture(scope="module")
def vectors(spark):
    rng, rows = random.Random(4), []
    for i in range(400):
        x = [rng.random(), rng.randrange(4), rng.gauss(0, 1), rng.random(), rng.random()]
        c = rng.choice("abcd")
        rows.append((i, *map(float, x), c, float(x[0] + 0.3 * x[1] * (c in "ab") + 0.2 * x[2] + rng.gauss(0, 0.3) > 0.8)))
    df = spark.createDataFrame(rows, "biz_id long, a double, b double, c double, d double, e double, k string, label double").coalesce(2)
    df = StringIndexer(inputCol="k", outputCol="ki").fit(df).transform(df)
    return VectorAssembler(inputCols=["a", "b", "c", "d", "e", "ki"], outputCol="features").transform(df).select("biz_id", "features", "label").cache()


def by_subsets(paths, x):
    """Shapley values by definition: the expected score given each subset of the six features."""
    def expected(known):
        return sum(p.value * math.prod(float(A._meets(x[None, f], c)[0]) if f in known else s
                                       for f, s, c in zip(p.features, p.shares, p.conditions)) for p in paths)
    n, out = len(x), np.zeros(len(x))
    for f in range(n):
        rest = [g for g in range(n) if g != f]
        for k in range(n):
            w = math.factorial(k) * math.factorial(n - 1 - k) / math.factorial(n)
            out[f] += w * sum(expected({*s, f}) - expected(set(s)) for s in combinations(rest, k))
    return out


@pytest.mark.parametrize("make", [
    lambda: GBTClassifier(maxIter=6, maxDepth=4, seed=1), lambda: RandomForestClassifier(numTrees=5, maxDepth=5, seed=2)])
def test_attributions(spark, vectors, make):
    model = make().fit(vectors)
    got = {r.biz_id: r for r in A.attributions(model, vectors).collect()}
    boosted = isinstance(make(), GBTClassifier)
    own = "rawPrediction" if boosted else "probability"
    for r in model.transform(vectors).collect():
        assert got[r.biz_id].base + sum(got[r.biz_id].attribution) == pytest.approx(float(r[own][1]), abs=1e-9)
    paths, base = A.tree_paths(model, spark)
    for r in vectors.where("biz_id < 5").collect():
        assert got[r.biz_id].attribution == pytest.approx(by_subsets(paths, r.features.toArray()), abs=1e-9)
    summary = A.attribution_summary(A.attributions(model, vectors), list("abcdek")).collect()
    assert len(summary) == 6 and summary[0].mean_abs >= summary[-1].mean_abs > -1 and {s.feature for s in summary[:3]} & {"a", "b"}
    assert A.attributions(model, vectors.where(F.lit(False))).collect() == []


def test_a_path_is_worked_out_per_pattern_and_not_per_row(monkeypatch):
    """Short paths cost their patterns however many rows there are; long ones give the same by the rows."""
    rng, worked = random.Random(9), []

    def path(depth):
        way = {}
        for f in rng.sample(range(10), depth):
            cut = (1.0, 3.0) if f >= 8 else (rng.random(),)
            way[f] = (rng.random(), ((cut, rng.random() < 0.5, f >= 8),))
        return A.Path(rng.gauss(0, 1), tuple(way), tuple(w[0] for w in way.values()), tuple(w[1] for w in way.values()))
    paths = [path(d) for d in (0, 1, 3, 5, 5, 5)]
    x = np.array([[*(rng.random() for _ in range(8)), *(float(rng.randrange(5)) for _ in range(2))] for _ in range(3000)])
    plain = A._added
    monkeypatch.setattr(A, "_added", lambda p, met: worked.append(met.shape[1]) or plain(p, met))
    got = A.path_attributions(paths, x)
    assert sum(worked) <= sum(1 << len(p.features) for p in paths) < len(x)
    monkeypatch.setattr(A, "PATTERN_FEATURES", -1)
    assert A.pattern_tables(paths) == [None] * len(paths) and (A.path_attributions(paths, x) == got).all()
    want = np.zeros(10)
    for p in paths:
        met = np.array([A._meets(x[:1, f], c)[0] for f, c in zip(p.features, p.conditions)], float).reshape(-1, 1)
        for f, a in zip(p.features, plain(p, met)):
            want[f] += a[0]
    assert got[0] == pytest.approx(want, abs=1e-12)
