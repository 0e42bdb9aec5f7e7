"""Operators against brute force, and independence from partitioning and skew."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leadquarry.functions import similarity as sim
from leadquarry.operators import calibrate, evaluate, fuzzy, rank, sampling, spatial


def plain_lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def set_ratio(x, y):
    tx, ty = set(x.split()), set(y.split())
    if not tx or not ty:
        return 0.0
    i, a, b = (" ".join(sorted(s)) for s in (tx & ty, tx - ty, ty - tx))
    if i and (not a or not b):
        return 100.0
    g = 1 if i else 0
    fa, fb = len(i) + g + len(a), len(i) + g + len(b)
    score = 100 - 100 * (len(a) + len(b) - 2 * plain_lcs(a, b)) / (fa + fb)
    if i:
        score = max(score, 100 - 100 * (g + len(a)) / (len(i) + fa), 100 - 100 * (g + len(b)) / (len(i) + fb))
    return score


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("abcé ", max_size=150), st.text("abcé ", max_size=150)), min_size=1, max_size=8))
def test_lcs_equals_dynamic_programming(pairs):
    left, right = [p[0] for p in pairs], [p[1] for p in pairs]
    assert sim.lcs_lengths(left, right).tolist() == [plain_lcs(a, b) for a, b in pairs]


WORDS = ["bar", "barr", "cafe", "dar", "hotel", "hotels", "sidi", "x", "zarrouk", "zarouk", "zz", "grand", "h" * 70]


def name(rng, extra=()):
    return " ".join(rng.choice([*WORDS, *extra]) for _ in range(rng.randint(1, 4)))


@pytest.mark.parametrize("scorer", ["token_set_ratio", "token_sort_ratio"])
def test_fuzzy_join_equals_all_pairs(spark, scorer):
    """A third of the rows share one name, names share hot words, and a query shares no letter."""
    rng = random.Random(5)
    pool = list({name(rng) for _ in range(120)})
    rows = [(i, rng.choice(pool) if i % 3 else "grand hotel") for i in range(240)]
    queries = [*{name(rng, ("qq", "hotal")) for _ in range(40)}, "wwww"]

    def sort_ratio(a, b):
        sa, sb = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
        return 100 - 100 * (len(sa) + len(sb) - 2 * plain_lcs(sa, sb)) / (len(sa) + len(sb))
    score = set_ratio if scorer == "token_set_ratio" else sort_ratio
    cache = {(q, n): score(q, n) for q in queries for n in {r[1] for r in rows}}
    want = {q: sorted((-cache[q, n], i) for i, n in rows)[:2] for q in queries}
    names = fuzzy.distinct_names(spark.createDataFrame(rows, "biz_id long, norm string").repartition(5))
    got = {}
    for r in fuzzy.fuzzy_top2(spark.createDataFrame([(q,) for q in queries], "norm string"), names, scorer).collect():
        got.setdefault(r.norm, {})[r.place] = (-r.score, r.biz_id)
    assert {q: [v[1], v[2]] for q, v in got.items()} == want


def test_few_pairs_are_scored(spark):
    """A third of all names hold one word; the bounds leave a small part of all pairs to score."""
    rng = random.Random(8)
    sound = lambda: "".join(rng.choice("bcdfglmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(2, 5)))
    stock = [sound() for _ in range(2500)]
    rows = [(i, " ".join([*(["societe"] if i % 3 == 0 else []), *rng.sample(stock, rng.randint(1, 3))])) for i in range(4000)]
    asked = [" ".join([*(["societe"] if i % 3 == 0 else []), *rng.sample(stock, 2)]) for i in range(200)]
    names = fuzzy.distinct_names(spark.createDataFrame(rows, "biz_id long, norm string"))
    queries, sets = fuzzy.prepared(spark.createDataFrame([(q,) for q in set(asked)], "norm string"), names, True)
    pairs = fuzzy.candidates(queries, sets, True)
    assert pairs.count() == pairs.distinct().count() < 0.1 * queries.count() * sets.count()


def haversine(p, q):
    dp, dl = math.radians(q[0] - p[0]) / 2, math.radians(q[1] - p[1]) / 2
    h = math.sin(dp) ** 2 + math.cos(math.radians(p[0])) * math.cos(math.radians(q[0])) * math.sin(dl) ** 2
    return 2 * 6371000 * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize("leaf", [512, 16])
def test_distance_joins_equal_brute_force(spark, monkeypatch, leaf):
    """Dense cluster, repeated coordinates, poles, antimeridian and far singles."""
    monkeypatch.setattr(spatial, "LEAF_PAIRS", leaf)
    monkeypatch.setattr(spatial, "LEAF_SIDE", 64 if leaf == 512 else 4)
    if leaf == 16:
        monkeypatch.setattr(spatial, "PARENTS_PER_TASK", 20)
        monkeypatch.setattr(spatial, "PAIRS_PER_TASK", 2000)
        monkeypatch.setattr(spatial, "START_PAIRS", 50)
    rng = random.Random(3)
    pts = []
    for i in range(240):
        r = rng.random()
        if r < .35:
            p = (36.8 + rng.gauss(0, .01), 10.18 + rng.gauss(0, .01))
        elif r < .55:
            p = (36.8, 10.18)
        elif r < .75:
            p = (rng.uniform(-85, 85), rng.uniform(-180, 180))
        elif r < .9:
            p = (70 + rng.uniform(-.02, .02), rng.choice([-1, 1]) * (180 - rng.random() * .03))
        else:
            p = (89.99 + rng.random() * .01, rng.uniform(-180, 180))
        pts.append((i, rng.choice("ab"), *p, int(rng.random() < .2)))
    df = spark.createDataFrame(pts, "biz_id long, search_category string, latitude double, longitude double, is_customer int")
    got = {r.biz_id: r.competitor_density for r in spatial.competitor_density(df).collect()}
    for p in pts:
        assert got[p[0]] == sum(q[0] != p[0] and q[1] == p[1] and haversine(p[2:4], q[2:4]) <= 2000 for q in pts)
    near = {r.biz_id: r for r in spatial.customer_proximity(df).collect()}
    customers = [p for p in pts if p[4]]
    for p in pts:
        d = [haversine(p[2:4], q[2:4]) for q in customers if q[0] != p[0]]
        assert abs(near[p[0]].customer_nearest_km - min(d) / 1000) < 1e-6
        assert near[p[0]].customers_within_5km == sum(x <= 5000 for x in d)


def test_proximity_needs_two_customers(spark):
    df = spark.createDataFrame([(1, 10.0, 10.0, 1), (2, 10.0, 10.1, 0)], "biz_id long, latitude double, longitude double, is_customer int")
    rows = spatial.customer_proximity(df).collect()
    assert all(r.customer_nearest_km is None and r.customers_within_5km == 0 for r in rows)


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_ranks_do_not_depend_on_partitions(spark, parts):
    """Half of the rows tie on one score."""
    df = spark.range(500).select(F.col("id").alias("biz_id"), F.when(F.col("id") % 2 == 0, 0.5).otherwise(
        F.col("id") * 7919 % 100 / 100.0).alias("score")).repartition(parts, F.rand(1))
    got = {r.biz_id: r["rank"] for r in rank.ranked_list(df, "score", label=None).collect()}
    rows = sorted(((0.5 if i % 2 == 0 else i * 7919 % 100 / 100.0), i) for i in range(500))
    want = {i: n + 1 for n, (_, i) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])))}
    assert got == want


def test_small_examples(spark):
    s = spark.createDataFrame([(1, "m", 1.0), (2, "m", 1.0), (3, "m", 2.0)], "biz_id long, method string, score double")
    assert {r.biz_id: r.score for r in rank.ensemble(s).collect()} == {1: 0.5, 2: 0.5, 3: 1.0}
    p = spark.createDataFrame([(1, "m", .9, 0), (2, "m", .8, 1), (3, "m", .7, 0), (4, "m", .6, 1)], "biz_id long, method string, score double, target int")
    r = evaluate.recall_at_k(p, [2, 100]).orderBy("k").collect()
    assert (r[0].hits, r[0].precision, r[0].recall) == (1, .5, .5) and (r[1].hits, r[1].recall) == (2, 1.0)
    a = evaluate.area_metrics(p.selectExpr("method AS model", "score AS prob", "target AS label")).first()
    assert a.pr_auc == 0.5


def test_ensemble_ignores_monotone_transforms(spark):
    s = spark.range(60).select(F.col("id").alias("biz_id"), F.lit("a").alias("method"), (F.col("id") * 37 % 20 / 20.0).alias("score"))
    t = s.withColumn("score", F.exp(F.col("score") * 3))
    assert sorted(rank.ensemble(s).collect()) == sorted(rank.ensemble(t).collect())


@pytest.mark.parametrize("one", [10_000, 0])
def test_isotonic_fit_by_ranges_equals_one_pass(spark, monkeypatch, one):
    """A distinct score per row, long violating stretches across borders, ties, and scores outside the fit."""
    monkeypatch.setattr(calibrate, "ONE_RANGE", one)
    rng = random.Random(6)
    data = [(i / 1000, float(rng.random() < (0.2 if 300 < i < 700 else i / 1000))) for i in range(1000)] + [(0.5, 1.0)] * 50
    means = {}
    for s, y in data:
        means.setdefault(s, []).append(y)
    stack = []
    for s in sorted(means):
        stack.append([s, s, len(means[s]), sum(means[s])])
        while len(stack) > 1 and stack[-2][3] * stack[-1][2] >= stack[-1][3] * stack[-2][2]:
            _, hi, w, wy = stack.pop()
            stack[-1][1:] = [hi, stack[-1][2] + w, stack[-1][3] + wy]
    xs = [x for lo, hi, *_ in stack for x in ((lo, hi) if hi > lo else (lo,))]
    ys = [wy / w for lo, hi, w, wy in stack for _ in ((lo, hi) if hi > lo else (lo,))]
    asked = [-1.0, 2.0, *[i / 777 for i in range(800)], *[s for s, _ in data]]
    rows = spark.createDataFrame(data, "score double, label double").repartition(3)
    probe = spark.createDataFrame([(i, s) for i, s in enumerate(asked)] + [(-1, None)], "id long, score double")
    got = {r.id: r.calibrated for r in calibrate.isotonic(probe, rows, parts=7).collect()}
    assert got.pop(-1) is None and len(got) == len(asked)
    assert [got[i] for i in range(len(asked))] == pytest.approx(list(np.interp(asked, xs, ys)))


def test_isotonic_example(spark):
    rows = spark.createDataFrame([(.1, 0.), (.2, 1.), (.2, 0.), (.3, 0.), (.5, 1.)], "score double, label double")
    probe = spark.createDataFrame([(0.0,), (.25,), (.4,), (.9,)], "score double")
    got = [r.calibrated for r in calibrate.isotonic(probe, rows).orderBy("score").collect()]
    assert got == pytest.approx([0, 1 / 3, 2 / 3, 1])


def test_samples_are_exact_and_repeatable(spark):
    df = spark.range(1000).select(F.col("id").alias("biz_id"), (F.col("id") % 20 == 0).cast("int").alias("is_customer"))
    train = sampling.holdout_split(df.repartition(7), 1)
    assert train.where("is_holdout").count() == 10 and train.where("y_train = 1").count() == 40
    again = sampling.holdout_split(df.coalesce(1), 1)
    assert sorted(train.collect()) == sorted(again.collect())
    neg = sampling.pseudo_negatives(train, 1, rounds=5)
    sizes = {r["round"]: r["count"] for r in neg.groupBy("round").count().collect()}
    assert sizes == {i: 120 for i in range(5)}
    assert neg.join(train.where("y_train = 1"), "biz_id").count() == 0
    whole = sampling.pseudo_negatives(train, 1, rounds=2, multiple=24)      # the whole pool
    assert whole.count() == 2 * 960
    with pytest.raises(ValueError):
        sampling.pseudo_negatives(train, 1, rounds=2, multiple=25)


def test_quantiles_with_one_hot_value(spark):
    df = spark.range(900).select(F.when(F.col("id") < 600, 1.0).otherwise(F.col("id").cast("double")).alias("v"))
    assert rank.exact_quantiles(df, "v", [0.0, 0.5, 0.9, 1.0]) == pytest.approx([1.0, 1.0, 809.1, 899.0])
    assert rank.exact_quantiles(df.where("v < 0"), "v", [0.5]) == [None]
