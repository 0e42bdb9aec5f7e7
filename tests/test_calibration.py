"""Sigmoid calibration: the fitted curve, missing scores, and its place in a bundle."""

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler

from leadquarry.operators import calibrate, supervised
from leadquarry.sources import tables


def labelled(spark):
    rng = np.random.default_rng(3)
    score = rng.random(400)
    label = (rng.random(400) < 1 / (1 + np.exp(-(6 * score - 3)))).astype(float)
    return score, label, spark.createDataFrame([(float(s), float(y)) for s, y in zip(score, label)], "score double, label double")


def newton(score, label):
    """Slope and offset by Newton steps on the smoothed targets."""
    p, n = label.sum(), (1 - label).sum()
    target = np.where(label == 1, (p + 1) / (p + 2), 1 / (n + 2))
    x, w = np.stack([score, np.ones_like(score)], 1), np.zeros(2)
    for _ in range(50):
        q = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve(x.T @ (x * (q * (1 - q))[:, None]), x.T @ (target - q))
    return w


def test_sigmoid_equals_newton(spark):
    score, label, rows = labelled(spark)
    slope, offset = newton(score, label)
    asked = spark.createDataFrame([(i, i / 10) for i in range(11)] + [(99, None)], "id long, score double")
    got = {r.id: r.calibrated for r in calibrate.sigmoid(asked, rows).collect()}
    assert got.pop(99) is None and len(got) == 11
    for i, value in got.items():
        assert abs(value - 1 / (1 + np.exp(-(slope * i / 10 + offset)))) < 1e-5


def test_bundle_keeps_the_kind_of_calibration(spark, tmp_path):
    _, _, rows = labelled(spark)
    model = Pipeline(stages=[VectorAssembler(inputCols=["score"], outputCol="features")]).fit(rows)
    asked = spark.createDataFrame([(i, i / 10) for i in range(11)], "id long, prob double")
    for kind, fit in supervised.CALIBRATIONS.items():
        made = fit(rows)
        tables.save_bundle(model, {}, str(tmp_path / kind), made)
        _, back, meta = tables.load_bundle(spark, str(tmp_path / kind))
        assert meta["calibration"] == kind
        one, two = (supervised.apply_calibration(m, asked).orderBy("id").collect() for m in (made, back))
        assert one == two and one[0].prob_client < one[-1].prob_client
        assert set(one[0].asDict()) == {"id", "prob", "prob_client"}
    tables.save_bundle(model, {}, str(tmp_path / "none"))
    assert tables.load_bundle(spark, str(tmp_path / "none"))[1] is None


def test_missing_probabilities_stay_rows(spark):
    _, _, rows = labelled(spark)
    asked = spark.createDataFrame([(1, None), (2, 0.5)], "id long, prob double")
    done = supervised.apply_calibration(calibrate.fit_sigmoid(rows), asked)
    got = {r.id: r.prob_client for r in done.collect()}
    assert got[1] is None and 0 < got[2] < 1
