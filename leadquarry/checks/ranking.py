"""Sampling, global ranks, top-k and model metrics over scores derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadquarry import fixtures as fx
from leadquarry.checks import sqltext as S
from leadquarry.checks.features import labeled, rounded
from leadquarry.checks.registry import query
from leadquarry.operators import evaluate as E
from leadquarry.operators import rank as R
from leadquarry.operators import sampling as SA
from leadquarry.plans.presets import ranked_whole

KS = [100, 500, 1000, 2000, 3000, 5000]
METHODS = {"A": 7919, "B": 7927, "C": 104729}
_K_LIST = ", ".join(map(str, KS))

# long scores with planned ties; the target is a property of the order
SCORES = "scores AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS method, o_orderkey AS biz_id, (o_orderkey * {p} % 1000) / 1e3::DOUBLE AS score, "
    f"CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS target FROM orders" for m, p in METHODS.items()) + ")"
RANKED = f"{SCORES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY score DESC, biz_id) AS rk FROM scores)"


def _topk(ks: str) -> str:
    return f"""{RANKED}, ks AS (SELECT unnest({ks}) AS k), met AS (SELECT method, k, count(*) FILTER (WHERE rk <= k AND target = 1) AS hits,
  count(*) FILTER (WHERE rk <= k AND target = 1) / k::DOUBLE AS precision, count(*) FILTER (WHERE rk <= k AND target = 1) / sum(target)::DOUBLE AS recall
  FROM ranked, ks GROUP BY method, k)"""


TOPK = _topk(f"[{_K_LIST}]")


def long_scores(spark, sf):
    o = fx.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    per = F.array(*[F.struct(F.lit(m).alias("method"), (k * p % 1000 / 1e3).alias("score")) for m, p in METHODS.items()])
    return o.select(k.alias("biz_id"), F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias("target"),
                    F.inline(per)).select("method", "biz_id", "score", "target")


def preds(spark, sf):
    return long_scores(spark, sf).select(F.col("method").alias("model"), "biz_id", F.col("score").alias("prob"),
                                         F.col("target").alias("label"), (F.col("biz_id") % 5 == 0).cast("int").alias("known"))


# ---- ranks -----------------------------------------------------------------------------

@query("ranked_list", """SELECT row_number() OVER (ORDER BY (o_orderkey * 7919 % 1000) DESC, o_orderkey) AS rank, o_orderkey AS biz_id FROM orders""")
def ranked(spark, sf):
    s = long_scores(spark, sf).where("method = 'A'").select("biz_id", "score")
    return R.ranked_list(s, "score", label=None).select("rank", "biz_id")


@query("average_tie_ranks", f"WITH {SCORES} SELECT method, round(score, 6) AS score, count(*) AS n, avg(rr) AS avg_rank FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY score, biz_id) AS rr FROM scores) x GROUP BY method, score")
def average_ranks(spark, sf):
    return rounded(R.average_ranks(long_scores(spark, sf)))


_AVG = f"{SCORES}, r AS (SELECT *, rank() OVER (PARTITION BY method ORDER BY score) + (count(*) OVER (PARTITION BY method, score) - 1) / 2.0 AS ar, count(*) OVER (PARTITION BY method) AS m FROM scores)"


@query("rank_ensemble", f"WITH {_AVG} SELECT biz_id, round(avg(ar / m::DOUBLE), 6) AS score FROM r GROUP BY biz_id")
def rank_ensemble(spark, sf):
    return rounded(R.ensemble(long_scores(spark, sf)))


@query("weighted_rank_ensemble", f"WITH {_AVG} SELECT biz_id, round(sum(ar / m::DOUBLE * CASE method WHEN 'A' THEN 3.0::DOUBLE WHEN 'B' THEN 2.0 ELSE 1.0 END) / 6, 6) AS score FROM r GROUP BY biz_id")
def weighted_ensemble(spark, sf):
    return rounded(R.ensemble(long_scores(spark, sf), {"A": 3, "B": 2, "C": 1}))


_SCORED = f"{S.LABELED}, scored AS (SELECT *, (biz_id * 7919 % 1000) / 1e3::DOUBLE AS prob FROM labeled)"


def _scored(spark, sf):
    return labeled(spark, sf).withColumn("prob", F.col("biz_id") * 7919 % 1000 / 1e3)


def _top_segment(segment):
    @query(f"top_50_by_{segment}", f"""{_SCORED} SELECT {segment}, biz_id, prob, row_number() OVER (PARTITION BY {segment} ORDER BY prob DESC, biz_id) AS segment_rank
      FROM scored WHERE is_customer = 0 AND {segment} IS NOT NULL QUALIFY segment_rank <= 50""")
    def run(spark, sf):
        top = R.top_per_segment(_scored(spark, sf).where("is_customer = 0"), segment, "prob")
        return top.select(segment, "biz_id", "prob", F.col("segment_rank").cast("long").alias("segment_rank"))


_top_segment("governorate")
_top_segment("search_category")


@query("top_10_non_customers", f"{_SCORED} SELECT biz_id, prob FROM scored WHERE is_customer = 0 ORDER BY prob DESC, biz_id LIMIT 10")
def top10(spark, sf):
    return R.head(_scored(spark, sf).where("is_customer = 0"), "prob").select("biz_id", "prob")


@query("review_sort", f"{_SCORED} SELECT biz_id, prob, row_number() OVER (ORDER BY prob DESC, biz_id) AS place FROM scored")
def review_sort(spark, sf):
    return R.row_numbers(_scored(spark, sf), [F.desc("prob"), F.asc("biz_id")], "place").select("biz_id", "prob", "place")


@query("decile_hit_rates", f"""{_SCORED}, d AS (SELECT *, ntile(10) OVER (ORDER BY prob DESC, biz_id) AS decile FROM scored),
  h AS (SELECT decile, count(*) AS n, sum(is_customer)::BIGINT AS hits, avg(is_customer) AS rate FROM d GROUP BY decile)
  SELECT decile, n, hits, round(rate, 6) AS hit_rate, rate <= lag(rate) OVER (ORDER BY decile) AS not_rising FROM h""")
def deciles(spark, sf):
    from leadquarry.plans.validation import decile_hit_rates
    return rounded(decile_hit_rates(_scored(spark, sf), "prob", "is_customer"))


@query("exact_quantiles", " UNION ALL ".join(
    f"SELECT {q}::DOUBLE AS q, round(quantile_cont(o_totalprice, {q}), 6) AS value FROM orders" for q in (0.05, 0.5, 0.95)))
def quantiles(spark, sf):
    qs = [0.05, 0.5, 0.95]
    vs = R.exact_quantiles(fx.table(spark, sf, "orders"), "o_totalprice", qs)
    return rounded(spark.createDataFrame(list(zip(qs, vs)), "q double, value double"))


# ---- sampling --------------------------------------------------------------------------

_H = "md5(concat({0}, ':', '{1}'))"


def docs(spark, sf):
    """Documents as rows, quality 1 as positives, the rest unlabelled."""
    d = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("biz_id"))
    q = fx.table(spark, sf, "labels").select(F.col("doc_id").alias("biz_id"), "quality")
    return d.join(q, "biz_id", "left").select("biz_id", F.when(F.col("quality") == 1, 1).otherwise(0).alias("is_customer"))


DOCS = "docs AS (SELECT d.doc_id AS biz_id, CASE WHEN l.quality = 1 THEN 1 ELSE 0 END AS is_customer FROM documents d LEFT JOIN labels l USING (doc_id))"
SPLIT = f"""{DOCS}, held AS (SELECT biz_id FROM docs WHERE is_customer = 1 QUALIFY row_number() OVER (ORDER BY {_H.format('biz_id', 'holdout:42')}, biz_id)
   <= ceil(0.2 * (SELECT sum(is_customer) FROM docs))),
 train AS (SELECT d.*, h.biz_id IS NOT NULL AS is_holdout, CASE WHEN is_customer = 1 AND h.biz_id IS NULL THEN 1 ELSE 0 END AS y_train FROM docs d LEFT JOIN held h USING (biz_id))"""


@query("holdout_split", f"WITH {SPLIT} SELECT biz_id, is_customer, is_holdout, y_train FROM train")
def holdout(spark, sf):
    return SA.holdout_split(docs(spark, sf), 42).select("biz_id", "is_customer", "is_holdout", "y_train")


@query("nested_c_estimation_split", f"""WITH {SPLIT} SELECT biz_id FROM train WHERE y_train = 1
  QUALIFY row_number() OVER (ORDER BY {_H.format('biz_id', 'c-estimation:42')}, biz_id) <= ceil(0.2 * (SELECT sum(y_train) FROM train))""")
def nested(spark, sf):
    import math
    pos = SA.holdout_split(docs(spark, sf), 42).where("y_train = 1").select("biz_id")
    return SA.sample_n(pos, math.ceil(0.2 * pos.count()), "c-estimation:42")


@query("spy_sample", f"""WITH {SPLIT} SELECT biz_id FROM train WHERE y_train = 1
  QUALIFY row_number() OVER (ORDER BY {_H.format('biz_id', 'spy:42')}, biz_id) <= greatest(floor(0.15 * (SELECT sum(y_train) FROM train)), 20)""")
def spy(spark, sf):
    return SA.spies(SA.holdout_split(docs(spark, sf), 42), 42)


@query("pseudo_negative_rounds", f"""{_SCORED}, rr AS (SELECT unnest(range(50)) AS round) SELECT biz_id, round::INT AS round FROM labeled, rr WHERE is_customer = 0
  QUALIFY row_number() OVER (PARTITION BY round ORDER BY md5(concat(biz_id, ':neg:42:', round)), biz_id) <= 3 * (SELECT sum(is_customer) FROM labeled)""")
def negatives(spark, sf):
    return SA.pseudo_negatives(labeled(spark, sf), 42, label="is_customer").select("biz_id", "round")


@query("stratified_split", f"""WITH {DOCS} SELECT biz_id, is_customer, CASE WHEN n <= round(0.6 * c) THEN 'train' WHEN n <= round(0.8 * c) THEN 'val' ELSE 'test' END AS split FROM (
  SELECT *, row_number() OVER (PARTITION BY is_customer ORDER BY {_H.format('biz_id', 'split:42')}, biz_id) AS n, count(*) OVER (PARTITION BY is_customer) AS c FROM docs) x""")
def stratified(spark, sf):
    return SA.stratified_split(docs(spark, sf), "is_customer", 42).select("biz_id", "is_customer", "split")


@query("class_balance", f"""WITH {DOCS} SELECT split, count(*) AS n, sum(is_customer)::BIGINT AS positives, round(avg(is_customer), 6) AS rate FROM (
  SELECT *, CASE WHEN n <= round(0.6 * c) THEN 'train' WHEN n <= round(0.8 * c) THEN 'val' ELSE 'test' END AS split FROM (
  SELECT *, row_number() OVER (PARTITION BY is_customer ORDER BY {_H.format('biz_id', 'split:42')}, biz_id) AS n, count(*) OVER (PARTITION BY is_customer) AS c FROM docs) x) y GROUP BY split""")
def balance(spark, sf):
    return rounded(E.class_balance(SA.stratified_split(docs(spark, sf), "is_customer", 42), "is_customer"))


@query("k_folds", f"SELECT doc_id AS biz_id, ((row_number() OVER (ORDER BY {_H.format('doc_id', 'fold:42')}, doc_id) - 1) % 5)::INT AS fold FROM documents")
def k_folds(spark, sf):
    return SA.folds(docs(spark, sf), 5, 42).select("biz_id", "fold")


@query("plain_sample", f"SELECT o_orderkey AS biz_id FROM orders QUALIFY row_number() OVER (ORDER BY {_H.format('o_orderkey', 'sample:42')}, o_orderkey) <= 5000")
def plain_sample(spark, sf):
    return SA.sample_n(fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("biz_id")), 5000, "sample:42")


# ---- recall at k -----------------------------------------------------------------------

@query("recall_at_k", f"WITH {TOPK} SELECT method, k, hits, round(precision, 6) AS precision, round(recall, 6) AS recall FROM met")
def recall_at_k(spark, sf):
    return rounded(E.recall_at_k(long_scores(spark, sf), KS))


@query("recall_pivot", f"WITH {TOPK} SELECT k, " + ", ".join(f"round(max(recall) FILTER (WHERE method = '{m}'), 3) AS {m}" for m in METHODS) + " FROM met GROUP BY k")
def recall_pivot(spark, sf):
    return E.recall_pivot(E.recall_at_k(long_scores(spark, sf), KS), list(METHODS))


@query("side_by_side_lift", f"""WITH {TOPK} SELECT a.k, round(a.recall, 6) AS recall_a, round(b.recall, 6) AS recall_b, a.hits AS hits_a, b.hits AS hits_b,
  round(a.recall - b.recall, 6) AS diff FROM met a JOIN met b ON a.k = b.k AND a.method = 'A' AND b.method = 'B'""")
def side_by_side(spark, sf):
    return rounded(E.side_by_side(E.recall_at_k(long_scores(spark, sf), KS), "A", "B"))


@query("recall_curve", f"WITH {_topk('range(50, 6001, 50)')} SELECT method, k::INT AS k, hits, round(precision, 6) AS precision, round(recall, 6) AS recall FROM met")
def recall_curve(spark, sf):
    return rounded(E.recall_at_k(long_scores(spark, sf), E.CURVE_KS))


@query("stability_population", f"WITH {TOPK} SELECT k, round(avg(recall), 6) AS recall_mean, round(stddev_pop(recall), 6) AS recall_std, round(avg(precision), 6) AS precision_mean, round(stddev_pop(precision), 6) AS precision_std FROM met GROUP BY k")
def stability_pop(spark, sf):
    return rounded(E.stability_by_k(E.recall_at_k(long_scores(spark, sf), KS)))


@query("stability_sample", f"WITH {TOPK} SELECT k, round(avg(recall), 6) AS recall_mean, round(stddev_samp(recall), 6) AS recall_std, round(avg(precision), 6) AS precision_mean, round(stddev_samp(precision), 6) AS precision_std FROM met GROUP BY k")
def stability_samp(spark, sf):
    return rounded(E.stability_by_k(E.recall_at_k(long_scores(spark, sf), KS), True))


@query("stability_formatted", f"""WITH {TOPK} SELECT k, format('{{:.3f}} ± {{:.3f}}', avg(recall), stddev_samp(recall)) AS recall_at_k,
  format('{{:.4f}} ± {{:.4f}}', avg(precision), stddev_samp(precision)) AS precision_at_k FROM met GROUP BY k""")
def stability_text(spark, sf):
    return E.formatted_stability(E.stability_by_k(E.recall_at_k(long_scores(spark, sf), KS), True))


@query("stability_curve_band", f"WITH {_topk('range(50, 6001, 50)')} SELECT k::INT AS k, round(avg(recall), 6) AS recall_mean, round(stddev_pop(recall), 6) AS recall_std FROM met GROUP BY k")
def stability_curve(spark, sf):
    return rounded(E.stability_by_k(E.recall_at_k(long_scores(spark, sf), E.CURVE_KS)).select("k", "recall_mean", "recall_std"))


@query("stability_by_row", f"WITH {SCORES} SELECT biz_id, round(avg(score), 6) AS score_mean, round(stddev_pop(score), 6) AS score_std FROM scores GROUP BY biz_id")
def stability_rows(spark, sf):
    return rounded(E.stability_by_row(long_scores(spark, sf)))


@query("score_join_back", f"WITH {SCORES} SELECT o_orderkey AS biz_id, o_orderstatus, a.score AS score_a, b.score AS score_b FROM orders o JOIN scores a ON a.biz_id = o_orderkey AND a.method = 'A' JOIN scores b ON b.biz_id = o_orderkey AND b.method = 'B'")
def join_back(spark, sf):
    wide = long_scores(spark, sf).groupBy("biz_id").pivot("method", ["A", "B"]).agg(F.first("score"))
    o = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("biz_id"), "o_orderstatus")
    return o.join(wide.withColumnsRenamed({"A": "score_a", "B": "score_b"}), "biz_id")


@query("ranked_list_parity", """SELECT c_custkey AS biz_id, 0 AS is_known_customer, n AS score, row_number() OVER (ORDER BY n DESC NULLS LAST, c_custkey) AS rank
  FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey""")
def list_parity(spark, sf):
    """Customers ranked by their orders: those without any stay, and the rows are held against the rows that went in."""
    labeled = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("biz_id"), F.lit(0).alias("is_customer"))
    scores = fx.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("biz_id")).agg(F.count("*").alias("score"))
    ranked = ranked_whole(labeled, labeled.join(scores, "biz_id", "left"), "score")
    return ranked.select("biz_id", "is_known_customer", "score", "rank")


# ---- model metrics ---------------------------------------------------------------------

PREDS = SCORES + ", preds AS (SELECT method AS model, biz_id, score AS prob, target AS label, CASE WHEN biz_id % 5 = 0 THEN 1 ELSE 0 END AS known FROM scores)"
GROUPS = f"""{PREDS}, g AS (SELECT model, prob, count(*) AS n, sum(label) AS pos FROM preds GROUP BY model, prob),
 cum AS (SELECT *, sum(n) OVER w AS seen, sum(pos) OVER w AS tp, sum(pos) OVER (PARTITION BY model) AS P, sum(n - pos) OVER (PARTITION BY model) AS NN
   FROM g WINDOW w AS (PARTITION BY model ORDER BY prob DESC))"""
AREAS = f"""{GROUPS}, areas AS (SELECT model, sum((n - pos) * (tp - pos + pos / 2.0::DOUBLE)) / max(P * NN) AS roc_auc,
 sum(pos / P::DOUBLE * tp / seen) AS pr_auc FROM cum GROUP BY model)"""
TM = """tm AS (SELECT model, tp, fp, fn, tn, (tp + tn) / (tp + fp + fn + tn)::DOUBLE AS accuracy, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS precision,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END AS f1,
  (CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END + CASE WHEN tn + fp > 0 THEN tn / (tn + fp)::DOUBLE ELSE 0 END) / 2 AS balanced_accuracy, brier, log_loss
  FROM (SELECT model, count(*) FILTER (WHERE prob >= 0.5 AND label = 1) AS tp, count(*) FILTER (WHERE prob >= 0.5 AND label = 0) AS fp,
   count(*) FILTER (WHERE prob < 0.5 AND label = 1) AS fn, count(*) FILTER (WHERE prob < 0.5 AND label = 0) AS tn, avg((prob - label) * (prob - label)) AS brier,
   avg(CASE WHEN label = 1 THEN -ln(least(greatest(prob, 2.220446049250313e-16), 1 - 2.220446049250313e-16)) ELSE -ln(1 - least(greatest(prob, 2.220446049250313e-16), 1 - 2.220446049250313e-16)) END) AS log_loss
   FROM preds GROUP BY model) x)"""
_NINE = ["accuracy", "precision", "recall", "f1", "balanced_accuracy", "roc_auc", "pr_auc", "brier", "log_loss"]


@query("confusion_matrix", f"""WITH {PREDS} SELECT model, l.label, p.predicted, count(*) FILTER (WHERE preds.label = l.label AND (CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END) = p.predicted) AS n
  FROM preds, (VALUES (0), (1)) l(label), (VALUES (0), (1)) p(predicted) GROUP BY ALL""")
def confusion(spark, sf):
    return E.confusion(preds(spark, sf))


@query("roc_auc_and_average_precision", f"WITH {AREAS} SELECT model, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc FROM areas")
def areas(spark, sf):
    return rounded(E.area_metrics(preds(spark, sf)))


@query("threshold_metrics", f"WITH {PREDS}, {TM} SELECT model, " + ", ".join(f"round({c}, 6) AS {c}" for c in _NINE if "auc" not in c) + " FROM tm")
def threshold(spark, sf):
    return rounded(E.threshold_metrics(preds(spark, sf)))


@query("model_comparison", f"WITH {AREAS}, {TM} SELECT model, " + ", ".join(f"round({c}, 6) AS {c}" for c in _NINE) + " FROM tm JOIN areas USING (model)")
def comparison(spark, sf):
    return rounded(E.model_comparison(preds(spark, sf)))


@query("curve_points", f"WITH {GROUPS} SELECT model, round(prob, 6) AS threshold, round((seen - tp) / NN::DOUBLE, 6) AS fpr, round(tp / P::DOUBLE, 6) AS tpr, round(tp / seen::DOUBLE, 6) AS precision FROM cum")
def curves(spark, sf):
    return rounded(E.curve_points(preds(spark, sf)))


@query("known_customer_check", f"""WITH {PREDS} SELECT model, count(*) FILTER (WHERE known = 1) AS n_known, round(avg(CASE WHEN prob >= 0.5 THEN 1.0 ELSE 0.0 END) FILTER (WHERE known = 1), 6) AS known_recall,
  round(avg(prob) FILTER (WHERE known = 1), 6) AS known_mean_proba FROM preds GROUP BY model""")
def known_check(spark, sf):
    return rounded(E.known_customer_check(preds(spark, sf).withColumnRenamed("known", "is_known_customer")))


_EDGES = "[" + ", ".join(f"(SELECT quantile_cont(prob, {i / 10}) FROM pa)" for i in range(1, 10)) + "]"


@query("reliability_bins", f"""WITH {PREDS}, pa AS (SELECT * FROM preds WHERE model = 'A'), e AS (SELECT {_EDGES} AS edges)
  SELECT len(list_filter(edges, lambda x: x < prob))::INT AS bin, count(*) AS n, round(avg(prob), 6) AS mean_predicted, round(avg(label), 6) AS fraction_positive FROM pa, e GROUP BY 1""")
def reliability(spark, sf):
    return rounded(E.reliability_bins(preds(spark, sf).where("model = 'A'")))


@query("score_histogram", f"""WITH {SCORES}, s AS (SELECT target, score FROM scores WHERE method = 'B'), sp AS (SELECT target, min(score) AS lo, max(score) AS hi, count(*) AS total FROM s GROUP BY target),
  c AS (SELECT s.target, least(floor((score - lo) / (hi - lo) * 40), 39)::INT AS bin, count(*) AS c FROM s JOIN sp ON s.target = sp.target GROUP BY 1, 2)
  SELECT sp.target, b.bin::INT AS bin, round(lo + b.bin * ((hi - lo) / 40), 6) AS left_edge, coalesce(c, 0) AS n, round(coalesce(c, 0) / (total * ((hi - lo) / 40)), 6) AS density
  FROM sp JOIN (SELECT unnest(range(40)) AS bin) b ON true LEFT JOIN c ON c.target = sp.target AND c.bin = b.bin""")
def score_histogram(spark, sf):
    return rounded(E.histogram(long_scores(spark, sf).where("method = 'B'"), "target"))
