"""Positive-unlabelled learners, priors, calibration."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from leadquarry import fixtures as fx
from leadquarry.checks import sqltext as S
from leadquarry.checks.features import _SCALARS, labeled, rounded
from leadquarry.checks.ranking import DOCS, SCORES, docs, long_scores
from leadquarry.checks.registry import query
from leadquarry.operators import attribution
from leadquarry.operators import calibrate as C
from leadquarry.operators import evaluate as E
from leadquarry.operators import features as FT
from leadquarry.operators import learners as LE
from leadquarry.operators import prior as PR
from leadquarry.operators import pu
from leadquarry.operators import sampling as SA
from leadquarry.session import cut

NUMERIC = ["rating", "log_reviews", "email_count", "name_length", "digital_presence_count"]
TEXT = ["category", "search_category", "governorate"]
COLUMNS = NUMERIC + TEXT

# ---- the scorecard in SQL --------------------------------------------------------------

_VALS = " UNION ALL ".join(f"SELECT biz_id, '{c}' AS f, ({_SCALARS[c]})::DOUBLE AS x FROM labeled" for c in NUMERIC)
_CATS = " UNION ALL ".join(f"SELECT biz_id, '{c}' AS f, coalesce({c}, 'Unknown') AS v FROM labeled" for c in TEXT)
_PROBS = "[" + ", ".join(str(i / 10) for i in range(1, 10)) + "]"


def _h(salt: str) -> str:
    return f"md5(concat(biz_id, ':', '{salt}'))"


SCORECARD = f"""{S.LABELED},
vals AS ({_VALS}), edges AS (SELECT f, list_distinct(quantile_disc(x, {_PROBS})) AS e FROM vals WHERE x IS NOT NULL GROUP BY f),
cats AS ({_CATS}), codes AS (SELECT f, v, row_number() OVER (PARTITION BY f ORDER BY count(*) DESC, v) - 1 AS code FROM cats GROUP BY f, v),
bins AS MATERIALIZED (SELECT biz_id, f, CASE WHEN x IS NULL THEN len(e) + 1 ELSE len(list_filter(e, lambda q: q <= x)) END AS bin, len(e) + 2 AS size FROM vals JOIN edges USING (f)
  UNION ALL SELECT biz_id, cats.f, coalesce(code, n), n + 1 FROM cats LEFT JOIN codes ON codes.f = cats.f AND codes.v = cats.v
    JOIN (SELECT f, count(*) AS n FROM codes GROUP BY f) m ON m.f = cats.f),
slots AS (SELECT DISTINCT f, bin, size FROM bins),
held AS (SELECT biz_id FROM labeled WHERE is_customer = 1 QUALIFY row_number() OVER (ORDER BY {_h('holdout:42')}, biz_id) <= ceil(0.2 * (SELECT sum(is_customer) FROM labeled))),
train AS MATERIALIZED (SELECT l.biz_id, is_customer, CASE WHEN match_confidence = 'borderline' THEN 0.5::DOUBLE ELSE 1.0 END AS w, h.biz_id IS NOT NULL AS is_holdout,
  CASE WHEN is_customer = 1 AND h.biz_id IS NULL THEN 1 ELSE 0 END AS y_train FROM labeled l LEFT JOIN held h USING (biz_id))"""


def fit_sql(name: str, labels: str) -> str:
    """CTEs that fit the scorecard on ``labels(biz_id, y, w)`` and score every row as ``name``."""
    return f"""{name}_l AS ({labels}), {name}_t AS (SELECT coalesce(sum(w) FILTER (WHERE y = 1), 0) AS p, coalesce(sum(w) FILTER (WHERE y = 0), 0) AS n FROM {name}_l),
{name}_c AS (SELECT f, bin, coalesce(sum(w) FILTER (WHERE y = 1), 0) AS p, coalesce(sum(w) FILTER (WHERE y = 0), 0) AS n FROM bins JOIN {name}_l USING (biz_id) GROUP BY f, bin),
{name}_w AS (SELECT s.f, s.bin, ln((coalesce(c.p, 0) + 1) / (t.p + s.size)) - ln((coalesce(c.n, 0) + 1) / (t.n + s.size)) AS wt
  FROM slots s CROSS JOIN {name}_t t LEFT JOIN {name}_c c ON c.f = s.f AND c.bin = s.bin),
{name} AS MATERIALIZED (SELECT biz_id, 1 / (1 + exp(-(sum(wt) + max(ln(greatest(t.p, 1e-12) / greatest(t.n, 1e-12)))))) AS score FROM bins JOIN {name}_w w ON w.f = bins.f AND w.bin = bins.bin CROSS JOIN {name}_t t GROUP BY biz_id)"""


def bag_sql(name: str, seed: int, neg_weight: float, rounds: int = 50) -> str:
    return f"""{name}_neg AS MATERIALIZED (SELECT biz_id, round FROM train, (SELECT unnest(range({rounds})) AS round) r WHERE y_train = 0
  QUALIFY row_number() OVER (PARTITION BY round ORDER BY md5(concat(biz_id, ':neg:{seed}:', round)), biz_id) <= 3 * (SELECT sum(y_train) FROM train)),
{name}_pt AS (SELECT sum(w) AS p FROM train WHERE y_train = 1), {name}_pc AS (SELECT f, bin, sum(w) AS p FROM bins JOIN train USING (biz_id) WHERE y_train = 1 GROUP BY f, bin),
{name}_nt AS (SELECT round, count(*) * {neg_weight}::DOUBLE AS n FROM {name}_neg GROUP BY round),
{name}_nc AS (SELECT round, f, bin, count(*) * {neg_weight}::DOUBLE AS n FROM bins JOIN {name}_neg USING (biz_id) GROUP BY round, f, bin),
{name}_w AS MATERIALIZED (SELECT nt.round, s.f, s.bin, ln((coalesce(pc.p, 0) + 1) / (pt.p + s.size)) - ln((coalesce(nc.n, 0) + 1) / (nt.n + s.size)) AS wt
  FROM slots s CROSS JOIN {name}_nt nt CROSS JOIN {name}_pt pt LEFT JOIN {name}_pc pc ON pc.f = s.f AND pc.bin = s.bin
  LEFT JOIN {name}_nc nc ON nc.f = s.f AND nc.bin = s.bin AND nc.round = nt.round),
{name}_all AS (SELECT biz_id, w.round, 1 / (1 + exp(-(sum(wt) + max(ln(pt.p / nt.n))))) AS s FROM bins JOIN {name}_w w ON w.f = bins.f AND w.bin = bins.bin
  JOIN {name}_nt nt ON nt.round = w.round CROSS JOIN {name}_pt pt GROUP BY biz_id, w.round),
{name} AS MATERIALIZED (SELECT a.biz_id, avg(s) AS score, count(*) AS n_rounds FROM {name}_all a LEFT JOIN {name}_neg g ON g.biz_id = a.biz_id AND g.round = a.round WHERE g.biz_id IS NULL GROUP BY a.biz_id)"""


_NAIVE = fit_sql("naive", "SELECT biz_id, y_train AS y, 1.0::DOUBLE AS w FROM train")


def setup(spark, sf, learner=None):
    f = cut(FT.scalar_features(labeled(spark, sf)).select("biz_id", *COLUMNS, "positive_weight", "is_customer"))
    prepared = (learner or LE.Scorecard()).prepare(f, COLUMNS)
    train = cut(SA.holdout_split(f.select("biz_id", "is_customer", "positive_weight"), 42))
    return f, prepared, train


@query("pu_naive_scores", f"{SCORECARD}, {_NAIVE} SELECT biz_id, round(score, 6) AS score FROM naive")
def naive(spark, sf):
    _, prepared, train = setup(spark, sf)
    return rounded(pu.naive_scores(prepared, train))


@query("pu_bagging_scores", f"{SCORECARD}, {bag_sql('bag', 42, 1.0)} SELECT biz_id, round(score, 6) AS score, n_rounds FROM bag")
def bagging(spark, sf):
    _, prepared, train = setup(spark, sf)
    return rounded(pu.bagging(prepared, train)[0])


@query("pu_prior_corrected_scores", f"{SCORECARD}, {bag_sql('bag', 42, 0.65)} SELECT biz_id, round(score, 6) AS score, n_rounds FROM bag")
def prior_corrected(spark, sf):
    _, prepared, train = setup(spark, sf)
    return rounded(pu.bagging(prepared, train, priors=(0.35,))[0])


@query("pu_two_step_scores", f"""{SCORECARD}, {_NAIVE}, thr AS (SELECT quantile_cont(score, 0.05) AS t FROM naive JOIN train USING (biz_id) WHERE y_train = 1),
{fit_sql('two', 'SELECT biz_id, 1 AS y, w FROM train WHERE y_train = 1 UNION ALL SELECT n.biz_id, 0, 1.0 FROM naive n JOIN train USING (biz_id), thr WHERE y_train = 0 AND score < t')}
SELECT biz_id, round(score, 6) AS score FROM two""")
def two_step(spark, sf):
    from leadquarry.operators.rank import exact_quantiles
    _, prepared, train = setup(spark, sf)
    base = cut(pu.naive_scores(prepared, train))
    t = exact_quantiles(base.join(train.where("y_train = 1"), "biz_id", "left_semi"), "score", [0.05])[0]
    return rounded(pu.retrain(prepared, train, cut(pu.reliable_negatives(base, train, t))))


@query("reliable_negatives", f"{SCORECARD} SELECT biz_id FROM train WHERE y_train = 0 AND (biz_id * 7919 % 1000) / 1e3::DOUBLE < 0.25")
def reliable(spark, sf):
    train = SA.holdout_split(labeled(spark, sf).select("biz_id", "is_customer"), 42)
    scores = train.select("biz_id", (F.col("biz_id") * 7919 % 1000 / 1e3).alias("score"))
    return pu.reliable_negatives(scores, train, 0.25)


_EN = f"""{SCORECARD}, hid AS (SELECT biz_id FROM train WHERE y_train = 1 QUALIFY row_number() OVER (ORDER BY {_h('c-estimation:42')}, biz_id) <= ceil(0.2 * (SELECT sum(y_train) FROM train))),
{fit_sql('en', 'SELECT biz_id, CASE WHEN biz_id IN (SELECT biz_id FROM hid) THEN 0 ELSE y_train END AS y, 1.0::DOUBLE AS w FROM train')},
cc AS (SELECT avg(score) AS c FROM en WHERE biz_id IN (SELECT biz_id FROM hid))"""


@query("pu_elkan_noto_scores", f"{_EN} SELECT biz_id, round(least(1, greatest(0, score / c)), 6)::DOUBLE AS score FROM en, cc")
def elkan_noto(spark, sf):
    _, prepared, train = setup(spark, sf)
    return rounded(pu.elkan_noto(prepared, train)[0])


@query("labelling_corrected_scores", "SELECT o_orderkey AS biz_id, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (o_orderkey * 7919 % 1000) / 1e3::DOUBLE / 0.4)), 6) AS score FROM orders")
def corrected(spark, sf):
    o = fx.table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("biz_id"), F.round(pu.corrected(F.col("o_orderkey") * 7919 % 1000 / 1e3, 0.4), 6).alias("score"))


@query("oob_mean_scores", f"""WITH {SCORES}, r AS (SELECT biz_id, score, CASE method WHEN 'A' THEN 0 WHEN 'B' THEN 1 ELSE 2 END AS round FROM scores)
  SELECT biz_id, round(avg(score), 6) AS score, count(*) AS n_rounds FROM r WHERE NOT (biz_id % 5 = round AND biz_id % 2 = 0) GROUP BY biz_id""")
def oob(spark, sf):
    rounds = F.when(F.col("method") == "A", 0).when(F.col("method") == "B", 1).otherwise(2)
    s = long_scores(spark, sf).select("biz_id", "score", rounds.alias("round"))
    neg = s.where((F.col("biz_id") % 5 == F.col("round")) & (F.col("biz_id") % 2 == 0)).select("biz_id", "round")
    return rounded(E.oob_mean(s, neg))


SEEDS = [42, 43, 44, 45, 46]
_BAGS = ", ".join(bag_sql(f"s{seed}", seed, 1.0) for seed in SEEDS)
_RUNS = " UNION ALL ".join(f"SELECT biz_id, score FROM s{seed}" for seed in SEEDS)


@query("seed_stability_of_bagging", f"{SCORECARD}, {_BAGS} SELECT biz_id, round(avg(score), 6) AS score_mean, round(stddev_pop(score), 6) AS score_std FROM ({_RUNS}) x GROUP BY biz_id")
def seeds(spark, sf):
    _, prepared, train = setup(spark, sf)
    runs = pu.over_seeds(lambda s: pu.bagging(prepared, train, s)[0].select("biz_id", "score"), SEEDS)
    return rounded(E.stability_by_row(runs))


# ---- priors ----------------------------------------------------------------------------

def _prior_row(spark, p: PR.Prior):
    return rounded(spark.createDataFrame([(p.pi_hat, p.c_hat, p.threshold)], "pi_hat double, c_hat double, threshold double"))


_PI = "greatest(0, least(0.99, least(p / c, 0.99) * (1 - c) / (1 - p)))"


@query("prior_spy", f"""{SCORECARD}, sp AS (SELECT biz_id FROM train WHERE y_train = 1 QUALIFY row_number() OVER (ORDER BY {_h('spy:42')}, biz_id) <= greatest(floor(0.15 * (SELECT sum(y_train) FROM train)), 20)),
{fit_sql('m', 'SELECT biz_id, CASE WHEN biz_id IN (SELECT biz_id FROM sp) THEN 0 ELSE y_train END AS y, 1.0::DOUBLE AS w FROM train')},
t AS (SELECT quantile_cont(score, 0.05) AS thr, avg(score) AS c FROM m WHERE biz_id IN (SELECT biz_id FROM sp))
SELECT round(avg(CASE WHEN score > thr THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS pi_hat, round(max(c), 6) AS c_hat, round(max(thr), 6) AS threshold FROM m JOIN train USING (biz_id), t WHERE y_train = 0""")
def prior_spy(spark, sf):
    _, prepared, train = setup(spark, sf)
    return _prior_row(spark, PR.spy_prior(prepared, train))


_HOLD = f"""{SCORECARD}, {fit_sql('m', 'SELECT biz_id, y_train AS y, 1.0::DOUBLE AS w FROM train WHERE NOT is_holdout')},
hc AS (SELECT avg(least(1, greatest(1e-6, score))) AS c, greatest(quantile_cont(score, 0.05), 1e-4) AS thr FROM m JOIN train USING (biz_id) WHERE is_holdout),
pp AS (SELECT sum(y_train) / count(*)::DOUBLE AS p FROM train)"""


@query("prior_holdout", f"{_HOLD} SELECT round({_PI}, 6)::DOUBLE AS pi_hat, round(c, 6) AS c_hat, round(thr, 6) AS threshold FROM hc, pp")
def prior_holdout(spark, sf):
    _, prepared, train = setup(spark, sf)
    return _prior_row(spark, PR.holdout_prior(prepared, train))


_LEAVES = f"""{DOCS}, lv AS (SELECT (biz_id % 3)::INT AS fold, (biz_id * 31 % 17)::BIGINT AS leaf, is_customer AS y FROM docs),
bf AS (SELECT fold, greatest(0, coalesce(max(f - sqrt(greatest(0, (1 - f) * ln(2) / n))) FILTER (WHERE n >= 15), 0)) AS bound FROM (SELECT fold, leaf, count(*) AS n, avg(y) AS f FROM lv GROUP BY fold, leaf) x GROUP BY fold)"""


@query("leaf_lower_bounds", f"WITH {_LEAVES} SELECT fold, round(bound, 6)::DOUBLE AS bound FROM bf")
def leaf_bounds(spark, sf):
    lv = docs(spark, sf).select((F.col("biz_id") % 3).cast("int").alias("fold"), (F.col("biz_id") * 31 % 17).alias("leaf"), F.col("is_customer").alias("y"))
    return rounded(PR.leaf_lower_bounds(lv, min_leaf=15))


@query("prior_robust", f"""{_HOLD}, {_NAIVE}, lv AS (SELECT (biz_id % 5)::INT AS fold, biz_id * 31 % 7 AS leaf, y_train AS y FROM train),
tb AS (SELECT greatest(avg(bound), 1e-3) AS c FROM (SELECT fold, greatest(0, coalesce(max(f - sqrt(greatest(0, (1 - f) * ln(2) / n))) FILTER (WHERE n >= 30), 0)) AS bound
  FROM (SELECT fold, leaf, count(*) AS n, avg(y) AS f FROM lv GROUP BY fold, leaf) x GROUP BY fold) y),
tt AS (SELECT greatest(quantile_cont(score, 0.05), 1e-4) AS thr FROM naive JOIN train USING (biz_id) WHERE y_train = 1),
hp AS (SELECT {_PI} AS pi FROM hc, pp), tp AS (SELECT {_PI} AS pi FROM tb, pp)
SELECT round(least(hp.pi, tp.pi), 6)::DOUBLE AS pi_hat, round((hc.c + tb.c) / 2, 6)::DOUBLE AS c_hat, round((hc.thr + tt.thr) / 2, 6)::DOUBLE AS threshold FROM hc, tb, tt, hp, tp""")
def prior_robust(spark, sf):
    """Both estimators and their mix; leaves are given so that every step has an SQL twin."""
    _, prepared, train = setup(spark, sf)
    base = cut(pu.naive_scores(prepared, train))
    leaves = train.select((F.col("biz_id") % 5).cast("int").alias("fold"), (F.col("biz_id") * 31 % 7).alias("leaf"), F.col("y_train").alias("y"))
    tree = PR.tree_prior_from_leaves(leaves, base, train)
    return _prior_row(spark, PR.robust_prior(PR.holdout_prior(prepared, train), tree))


@query("prior_comparison_table")
def prior_table(spark, sf):
    f, prepared, train = setup(spark, sf)
    spy, held = PR.spy_prior(prepared, train), PR.holdout_prior(prepared, train)
    tree = PR.tree_prior(LE.assemble(f, COLUMNS), cut(pu.naive_scores(prepared, train)), train)
    return PR.comparison_table(spark, spy, held, tree, PR.robust_prior(held, tree))


# ---- calibration -----------------------------------------------------------------------

_ISO_ROWS = "SELECT (o_orderkey * 7919 % 60) / 60.0::DOUBLE AS score, CASE WHEN o_orderkey * 31 % 97 < (o_orderkey * 7919 % 60) + 10 THEN 1 ELSE 0 END AS label FROM orders"


def _iso_rows(spark, sf):
    k = F.col("o_orderkey")
    return fx.table(spark, sf, "orders").select(
        (k * 7919 % 60 / 60.0).alias("score"), F.when(k * 31 % 97 < (k * 7919 % 60) + 10, 1.0).otherwise(0.0).alias("label"))


@query("isotonic_calibration", f"""WITH r AS ({_ISO_ROWS}), g AS (SELECT score, row_number() OVER (ORDER BY score) AS i, count(*) AS n, sum(label) AS y FROM r GROUP BY score),
  cum AS (SELECT *, sum(n) OVER (ORDER BY i) AS cn, sum(y) OVER (ORDER BY i) AS cy FROM g),
  seg AS (SELECT a.i AS j, b.i AS k, (b.cy - a.cy + a.y) / (b.cn - a.cn + a.n)::DOUBLE AS m FROM cum a JOIN cum b ON b.i >= a.i),
  low AS (SELECT g.i, seg.j, min(m) AS m FROM g JOIN seg ON seg.j <= g.i AND seg.k >= g.i GROUP BY g.i, seg.j)
  SELECT round(g.score, 6) AS score, round(max(low.m), 6) AS calibrated FROM g JOIN low ON low.i = g.i GROUP BY g.i, g.score""")
def isotonic(spark, sf):
    rows = cut(_iso_rows(spark, sf))
    return rounded(C.isotonic(rows.select("score").distinct(), rows).select("score", "calibrated"))


@query("sigmoid_calibration")
def sigmoid(spark, sf):
    rows = cut(_iso_rows(spark, sf))
    return C.sigmoid(rows.select("score").distinct(), rows).select("score", "calibrated")


@query("calibration_fit_rows", f"""{SCORECARD} SELECT biz_id, (biz_id * 7919 % 1000) / 1e3::DOUBLE AS score, label FROM (
  SELECT biz_id, 1.0::DOUBLE AS label FROM train WHERE is_holdout UNION ALL SELECT biz_id, 0.0 FROM train WHERE y_train = 0 AND (biz_id * 7919 % 1000) / 1e3::DOUBLE < 0.25) x""")
def calibration_rows(spark, sf):
    train = cut(SA.holdout_split(labeled(spark, sf).select("biz_id", "is_customer"), 42))
    s = train.select("biz_id", (F.col("biz_id") * 7919 % 1000 / 1e3).alias("score"))
    return C.calibration_rows(s, train.where("is_holdout"), pu.reliable_negatives(s, train, 0.25))


# ---- MLlib learners --------------------------------------------------------------------

@query("boosted_trees_bagging")
def boosted(spark, sf):
    _, prepared, train = setup(spark, sf, LE.TreesOrLinear(lambda s: LE.boosted_trees(s, 10)))
    return pu.bagging(prepared, train, rounds=2)[0]


def _attributed(spark, sf):
    """Published boosted trees on all labels, and the attributions of every row."""
    _, prepared, train = setup(spark, sf, LE.TreesOrLinear(LE.boosted_trees))
    model = prepared._fit(train.select("biz_id", F.col("y_train").alias("y"), F.lit(1.0).alias("w")), 42)
    attrs = prepared.vectors.schema["features"].metadata["ml_attr"]["attrs"]
    names = [a["name"] for a in sorted((a for g in attrs.values() for a in g), key=lambda a: a["idx"])]
    return attribution.attributions(model, prepared.vectors), names


@query("tree_attributions")
def tree_attributions(spark, sf):
    rows, names = _attributed(spark, sf)
    named = F.array(*[F.lit(n) for n in names])
    return rows.select("biz_id", "base", "score", F.posexplode("attribution").alias("slot", "attribution")).select(
        "biz_id", "base", "score", named[F.col("slot")].alias("feature"), "attribution")


@query("tree_attribution_summary")
def tree_attribution_summary(spark, sf):
    return attribution.attribution_summary(*_attributed(spark, sf))


@query("logistic_two_step")
def logistic(spark, sf):
    from leadquarry.operators.rank import exact_quantiles
    _, prepared, train = setup(spark, sf, LE.TreesOrLinear(LE.logistic))
    base = cut(pu.naive_scores(prepared, train))
    t = exact_quantiles(base.join(train.where("y_train = 1"), "biz_id", "left_semi"), "score", [0.5])[0]
    return pu.retrain(prepared, train, cut(pu.reliable_negatives(base, train, t)))


# ---- presets ---------------------------------------------------------------------------

def _preset(version: str, **kw):
    from leadquarry.plans import presets

    def run(spark, sf):
        return presets.run(fx.purchases(spark, sf), fx.businesses(spark, sf), presets.Config(version=version, **kw))[2]
    return run


@query("preset_v1_ranked")
def preset_v1(spark, sf):
    return _preset("v1")(spark, sf).ranked


@query("preset_v2_comparison")
def preset_v2(spark, sf):
    return _preset("v2")(spark, sf).comparison


@query("preset_v3_ranked")
def preset_v3(spark, sf):
    return _preset("v3")(spark, sf).ranked


@query("experiments_comparison")
def experiments(spark, sf):
    from leadquarry.plans import presets
    f = cut(FT.build_features(labeled(spark, sf), "v1"))
    return presets.run_experiments(f, presets.Config(version="v1"))["comparison"]
