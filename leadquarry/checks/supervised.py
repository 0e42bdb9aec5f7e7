"""Supervised stage and file sources."""

from __future__ import annotations

import uuid


from pyspark.sql import functions as F

from leadquarry import fixtures as fx
from leadquarry.checks import sqltext as S
from leadquarry.checks.features import labeled, rounded
from leadquarry.checks.ranking import PREDS, preds
from leadquarry.checks.registry import query
from leadquarry.operators import evaluate as E
from leadquarry.operators import supervised as SU
from leadquarry.operators.sampling import stratified_split
from leadquarry.plans import supervised_stage
from leadquarry.session import cut, ensure_checkpoint_dir
from leadquarry.sources import tables

# the ranked list as the supervised stage sees it: scores derived from the key
RANKED = f"""{S.LABELED}, ranked AS (SELECT * EXCLUDE (is_customer), is_customer AS is_known_customer, (biz_id * 7919 % 1000) / 1e3::DOUBLE AS pu_score_prior_corr,
  CASE WHEN is_customer = 1 THEN 'x' END AS only_known, 'tn' AS country FROM labeled)"""


def ranked(spark, sf):
    return labeled(spark, sf).withColumnRenamed("is_customer", "is_known_customer").withColumns({
        "pu_score_prior_corr": F.col("biz_id") * 7919 % 1000 / 1e3,
        "only_known": F.when(F.col("is_known_customer") == 1, "x"), "country": F.lit("tn")})


def _nn(c):
    return f"CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END AS has_{c}"


@query("presence_flags_not_null", f"{RANKED} SELECT biz_id, {_nn('website')}, {_nn('email')}, {_nn('phone')} FROM ranked")
def flags(spark, sf):
    return SU.presence_flags(ranked(spark, sf)).select("biz_id", "has_website", "has_email", "has_phone")


@query("pseudo_label", f"{RANKED} SELECT biz_id, CASE WHEN is_known_customer = 1 OR pu_score_prior_corr >= 0.5 THEN 1 ELSE 0 END AS predicted_customer FROM ranked")
def pseudo(spark, sf):
    return SU.pseudo_label(ranked(spark, sf)).select("biz_id", "predicted_customer")


_SCREEN = ["category", "rating", "website", "only_known", "country", "rne"]
_SCREEN_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", coalesce(min({c}) = max({c}), true) AS is_constant,
    round(CASE WHEN min({c} IS NOT NULL) <> max({c} IS NOT NULL) THEN abs(corr(({c} IS NOT NULL)::INT, is_known_customer)) END, 6) AS presence_correlation FROM ranked""" for c in _SCREEN)


@query("column_screen", f"{RANKED} {_SCREEN_SQL}")
def screen(spark, sf):
    return rounded(SU.column_screen(ranked(spark, sf), _SCREEN))


@query("feature_schema")
def schema(spark, sf):
    s = SU.identify_columns(SU.pseudo_label(SU.presence_flags(ranked(spark, sf))))
    rows = [(k, c) for k in ("numeric", "categorical", "leakage", "identifiers", "constant") for c in getattr(s, k)]
    return spark.createDataFrame(rows, "kind string, column string")


@query("rare_category_buckets", f"""{S.FIX}, n AS (SELECT governorate AS v, row_number() OVER (ORDER BY count(*) DESC, governorate) AS r FROM businesses WHERE governorate IS NOT NULL GROUP BY governorate)
  SELECT biz_id, CASE WHEN f IN (SELECT v FROM n WHERE r <= 9) THEN f ELSE 'infrequent' END AS governorate FROM (
  SELECT biz_id, coalesce(governorate, (SELECT v FROM n WHERE r = 1)) AS f FROM businesses) x""")
def rare(spark, sf):
    return SU.collapse_rare(fx.businesses(spark, sf).select("biz_id", "governorate"), ["governorate"], 10)


_SPLIT_B = f"""{S.FIX}, sp AS (SELECT *, CASE WHEN n <= round(0.6 * c) THEN 'train' WHEN n <= round(0.8 * c) THEN 'val' ELSE 'test' END AS split FROM (
  SELECT *, row_number() OVER (PARTITION BY search_category IS NULL ORDER BY md5(concat(biz_id, ':split:42')), biz_id) AS n, count(*) OVER (PARTITION BY search_category IS NULL) AS c FROM businesses) x),
  med AS (SELECT median(rating) AS mr, median(latitude) AS ml FROM sp WHERE split = 'train'),
  filled AS (SELECT biz_id, split, coalesce(rating, mr) AS rating, coalesce(latitude, ml) AS latitude, CASE WHEN rating IS NULL THEN 1.0::DOUBLE ELSE 0.0 END AS rating_missing,
    CASE WHEN latitude IS NULL THEN 1.0::DOUBLE ELSE 0.0 END AS latitude_missing FROM sp, med)"""
_NUM = ["rating", "latitude", "rating_missing", "latitude_missing"]


def _split_b(spark, sf):
    b = fx.businesses(spark, sf).withColumn("y", F.col("search_category").isNull().cast("int"))
    b = cut(stratified_split(b, "y", 42).select("biz_id", "split", "rating", "latitude"))
    return b.where("split = 'train'"), b


@query("numeric_preparation", f"{_SPLIT_B} SELECT biz_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in _NUM) + " FROM filled")
def numeric(spark, sf):
    train, df = _split_b(spark, sf)
    return rounded(SU.prepare_numeric(train, df, ["rating", "latitude"]).select("biz_id", *_NUM))


@query("numeric_preparation_scaled", f"{_SPLIT_B}, st AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _NUM) +
       " FROM filled WHERE split = 'train') SELECT biz_id, " + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in _NUM) + " FROM filled, st")
def numeric_scaled(spark, sf):
    train, df = _split_b(spark, sf)
    return rounded(SU.prepare_numeric(train, df, ["rating", "latitude"], scale=True).select("biz_id", *_NUM))


@query("aligned_columns", f"{S.FIX} SELECT biz_id, rating, NULL::DOUBLE AS employees, category FROM businesses")
def aligned(spark, sf):
    return SU.align_columns(fx.businesses(spark, sf), ["rating", "employees", "category"], keep=["biz_id"])


@query("threshold_decision", f"WITH {PREDS} SELECT model, biz_id, CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END AS predicted_client FROM preds")
def decision(spark, sf):
    return SU.decide(preds(spark, sf), "prob").select("model", "biz_id", "predicted_client")


@query("calibration_summary", f"""WITH {PREDS}, m AS (SELECT round(avg((prob - label) * (prob - label)), 6) AS a, round(avg((prob * prob - label) * (prob * prob - label)), 6) AS b FROM preds WHERE model = 'A')
  SELECT 'brier_before' AS metric, a AS value FROM m UNION ALL SELECT 'brier_after', b FROM m""")
def cal_summary(spark, sf):
    p = preds(spark, sf).where("model = 'A'").withColumn("prob_calibrated", F.col("prob") * F.col("prob"))
    return rounded(SU.calibration_summary(p))


# ---- fitted models ---------------------------------------------------------------------

def _trained(spark, sf, only=None):
    """Every family, or those of ``only``, over its whole published grid."""
    df = SU.pseudo_label(SU.presence_flags(ranked(spark, sf).drop("match_confidence")))
    return SU.train_models(df, lambda weights: {k: v for k, v in SU.model_specs(weights).items() if only is None or k in only})


@query("supervised_model_comparison")
def supervised(spark, sf):
    result, _ = _trained(spark, sf)
    return E.model_comparison(result.test_predictions)


@query("supervised_scored_businesses")
def scored(spark, sf):
    """Train, save the bundle, load it again and score every business as a new row."""
    result, data = _trained(spark, sf, ["LogisticRegression"])
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/bundle-{uuid.uuid4().hex}"
    types = dict(data.dtypes)
    tables.save_bundle(result.best.model, {"columns": result.schema.features, "types": types, "threshold": SU.THRESHOLD}, path,
                       result.calibrator)
    model, calibrator, meta = tables.load_bundle(spark, path)
    out = SU.score_rows(model, calibrator, fx.businesses(spark, sf), meta["columns"], meta["types"], threshold=meta["threshold"])
    return out.select("biz_id", "prob_client", "predicted_client")


@query("supervised_run_summary")
def run_summary(spark, sf):
    """The whole stage with its sinks; the metrics of its summary as rows."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/stage-{uuid.uuid4().hex}"
    family = "LogisticRegression"
    reports = supervised_stage.run(ranked(spark, sf).drop("match_confidence"), folder, lambda weights: {family: SU.model_specs(weights)[family]})
    facts = [(f"{part}.{k}", float(v)) for part in ("test", "known_customers") for row in reports.summary[part]
             for k, v in row.items() if isinstance(v, (int, float))]
    return spark.createDataFrame(facts + [(f"rows.{k}", float(v)) for k, v in reports.summary["rows"].items()], "metric string, value double")


@query("supervised_sigmoid_scores")
def sigmoid_scores(spark, sf):
    """The whole stage with sigmoid calibration: every business scored from the bundle as read back."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/stage-{uuid.uuid4().hex}"
    family = "LogisticRegression"
    reports = supervised_stage.run(ranked(spark, sf).drop("match_confidence"), folder,
                                   lambda weights: {family: SU.model_specs(weights)[family]}, calibration="sigmoid")
    return reports.scored.select("biz_id", "prob_client", "predicted_client")


@query("permutation_importance")
def importance(spark, sf):
    result, data = _trained(spark, sf, ["LogisticRegression"])
    return SU.permutation_importance(result.best.model, data.where("split = 'test'"), result.schema.features)


@query("native_importance")
def native(spark, sf):
    result, data = _trained(spark, sf, ["RandomForest"])
    rows = SU.native_importance(result.best.model, result.best.model.transform(data.where("split = 'test'")))
    return spark.createDataFrame(rows, "feature string, importance double")


# ---- files -----------------------------------------------------------------------------

def _shared(spark, name):
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}.csv"


@query("csv_round_trip", f"{S.FIX} SELECT biz_id::VARCHAR AS biz_id, name, address, phone, email, latitude, rating, reviews FROM businesses")
def csv_round_trip(spark, sf):
    path = _shared(spark, "businesses")
    tables.write_table(fx.businesses(spark, sf), path)
    return tables.read_businesses(spark, path).select("biz_id", "name", "address", "phone", "email", "latitude", "rating", "reviews")


@query("header_below_titles", f"{S.FIX} SELECT account_contact_name, phone, source_file FROM purchases")
def titled(spark, sf):
    path = _shared(spark, "purchases")
    p = fx.purchases(spark, sf).select("purchase_id", F.col("account_contact_name"), "phone", "source_file")
    line = F.to_csv(F.struct("account_contact_name", "phone", "source_file"))
    body = p.select((F.col("purchase_id") + 3).alias("i"), line.alias("value"))
    head = spark.createDataFrame([(0, "Customer export"), (1, "2024"), (2, "account_contact_name,phone,source_file")], "i long, value string")
    head.unionByName(body).coalesce(1).sortWithinPartitions("i").select("value").write.text(path)
    return tables.read_below_titles(spark, path, "account_contact_name")
