"""Models fitted by MLlib score rows in a session that has observed a frame before."""

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from leadquarry.operators import calibrate, learners, supervised


@pytest.fixture
def observed(spark):
    seen = Observation()
    spark.range(10).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 10
    return spark


def rows(spark, n=300):
    rng = np.random.default_rng(4)
    x = rng.random(n)
    y = (rng.random(n) < x).astype(int)
    return spark.createDataFrame([(i, float(a), "uv"[i % 2], int(b)) for i, (a, b) in enumerate(zip(x, y))],
                                 "biz_id long, x double, category string, predicted_customer int")


def test_sigmoid(observed):
    df = rows(observed).select("biz_id", F.col("x").alias("score"), F.col("predicted_customer").cast("double").alias("label"))
    assert calibrate.sigmoid(df, df).where("calibrated between 0 and 1").count() == 300


@pytest.mark.parametrize("family, grid", [("LogisticRegression", [{"C": 1.0}]), ("RandomForest", [{"trees": 3, "depth": 3, "min_leaf": 2}])])
def test_tuned_families(observed, family, grid):
    df = rows(observed)
    schema = supervised.FeatureSchema(["x", "category"], ["x"], ["category"], [], [], [])
    make, _, weights, scale, one_hot = supervised.model_specs(supervised.class_weights(df))[family]
    best = supervised.tune(family, (make, grid, weights, scale, one_hot), df, df, schema)
    assert supervised.positive_probability(best.model, df).where("prob between 0 and 1").count() == 300
    assert len(supervised.native_importance(best.model, best.model.transform(df))) == 4


def test_logistic_learner(observed):
    df = rows(observed)
    prepared = learners.TreesOrLinear(learners.logistic, scale=True).prepare(df, ["x"])
    labels = df.select("biz_id", F.col("predicted_customer").alias("y"), F.lit(1.0).alias("w"))
    assert prepared.fit_score(labels).where("score between 0 and 1").count() == 300
