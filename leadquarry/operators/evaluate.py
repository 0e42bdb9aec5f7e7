"""Ranking and threshold metrics over long ``(method, id, score, target)`` tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadquarry.operators.rank import exact_quantiles, grouped_row_numbers, prefix_sums
from leadquarry.operators.sampling import sample_n
from leadquarry.session import cut

EPS = 2.220446049250313e-16      # fixed value: clip of log-loss probabilities
CURVE_KS = list(range(50, 6001, 50))


# ---- top-k -----------------------------------------------------------------------------

def recall_at_k(scores: DataFrame, ks: Sequence[int], method: str = "method", id_col: str = "biz_id") -> DataFrame:
    """hits, precision and recall of the ``k`` best rows per method; ties go to the lower id.

    One distributed ranking serves every method and every k.  Only target rows are counted:
    each falls into the first k that covers it and the small (method, k) table is accumulated.
    """
    ks = sorted(set(ks))
    ranked = grouped_row_numbers(
        scores.select(method, id_col, "score", "target"), method, [F.desc_nulls_last("score"), F.asc(id_col)])
    k_array = F.array(*[F.lit(k) for k in ks])
    slot = F.size(F.filter(k_array, lambda k: k < F.col("rank")))
    per_slot = (
        ranked.groupBy(method, F.when(F.col("target") == 1, slot).otherwise(len(ks)).alias("slot"))
        .agg(F.count_if(F.col("target") == 1).alias("c"))
    )
    # every k at or after the slot gets the slot's hits; slot == len(ks) feeds only the total
    spread = per_slot.select(
        method, "c", "slot",
        F.explode(F.transform(k_array, lambda k, i: F.struct(k.alias("k"), i.alias("i")))).alias("x"))
    out = spread.groupBy(method, F.col("x.k").alias("k")).agg(
        F.sum(F.when(F.col("x.i") >= F.col("slot"), F.col("c")).otherwise(0)).alias("hits"),
        F.sum("c").alias("total"))
    return out.select(
        method, "k", "hits", (F.col("hits") / F.col("k")).alias("precision"),
        F.when(F.col("total") > 0, F.col("hits") / F.col("total")).otherwise(0.0).alias("recall"))


def recall_pivot(metrics: DataFrame, methods: Sequence[str], digits: int = 3) -> DataFrame:
    """k rows x one recall column per method."""
    return metrics.groupBy("k").pivot("method", list(methods)).agg(F.round(F.first("recall"), digits))


def side_by_side(metrics: DataFrame, a: str, b: str) -> DataFrame:
    """Recall and hits of two methods per k and the difference ``a - b``."""
    def pick(m: str, c: str) -> Column:
        return F.max(F.when(F.col("method") == m, F.col(c)))
    out = metrics.where(F.col("method").isin(a, b)).groupBy("k").agg(
        pick(a, "recall").alias("recall_a"), pick(b, "recall").alias("recall_b"),
        pick(a, "hits").alias("hits_a"), pick(b, "hits").alias("hits_b"))
    return out.withColumn("diff", F.col("recall_a") - F.col("recall_b"))


# ---- stability over seeds --------------------------------------------------------------

def stability_by_k(metrics: DataFrame, sample_std: bool = False) -> DataFrame:
    """Mean and std over seeds of recall (and precision): population std, or sample std."""
    std = F.stddev_samp if sample_std else F.stddev_pop
    return metrics.groupBy("k").agg(
        F.avg("recall").alias("recall_mean"), std("recall").alias("recall_std"),
        F.avg("precision").alias("precision_mean"), std("precision").alias("precision_std"))


def formatted_stability(stability: DataFrame) -> DataFrame:
    return stability.select(
        "k", F.format_string("%.3f ± %.3f", "recall_mean", "recall_std").alias("recall_at_k"),
        F.format_string("%.4f ± %.4f", "precision_mean", "precision_std").alias("precision_at_k"))


def stability_by_row(scores: DataFrame, id_col: str = "biz_id") -> DataFrame:
    """Mean and population std of a row's score over seeds, from long ``(id, seed, score)``."""
    return scores.groupBy(id_col).agg(F.avg("score").alias("score_mean"), F.stddev_pop("score").alias("score_std"))


def oob_mean(scores: DataFrame, negatives: DataFrame, id_col: str = "biz_id") -> DataFrame:
    """Mean over the rounds in which a row was not a pseudo-negative, from long rows."""
    return (
        scores.join(negatives.select(id_col, "round"), [id_col, "round"], "left_anti")
        .groupBy(id_col).agg(F.avg("score").alias("score"), F.count("*").alias("n_rounds"))
    )


# ---- threshold-free metrics ------------------------------------------------------------

def score_counts(preds: DataFrame, model: str = "model") -> DataFrame:
    """Rows and positives per distinct score with exclusive running sums from the top."""
    counts = preds.groupBy(model, "prob").agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("pos"))
    return prefix_sums(counts, model, [F.desc("prob")], ["n", "pos"])


def area_metrics(preds: DataFrame, model: str = "model", counts: DataFrame | None = None) -> DataFrame:
    """ROC-AUC (ties one half) and average precision (step sum over distinct scores)."""
    c = counts if counts is not None else cut(score_counts(preds, model))
    totals = c.groupBy(model).agg(F.sum("pos").alias("total_pos"), (F.sum("n") - F.sum("pos")).alias("total_neg"))
    j = c.join(F.broadcast(totals), model)              # one row per model
    neg = F.col("n") - F.col("pos")
    won = F.sum(neg * (F.col("pos_before") + F.col("pos") / 2))
    ap = F.sum(F.col("pos") / F.col("total_pos") * (F.col("pos_before") + F.col("pos")) / (F.col("n_before") + F.col("n")))
    return j.groupBy(model).agg(
        F.try_divide(won, F.first("total_pos") * F.first("total_neg")).alias("roc_auc"), ap.alias("pr_auc"))


def curve_points(preds: DataFrame, model: str = "model") -> DataFrame:
    """One ROC and PR point per distinct score: threshold, fpr, tpr (= recall), precision."""
    c = cut(score_counts(preds, model))
    totals = c.groupBy(model).agg(F.sum("pos").alias("total_pos"), (F.sum("n") - F.sum("pos")).alias("total_neg"))
    tp = F.col("pos_before") + F.col("pos")
    seen = F.col("n_before") + F.col("n")
    return c.join(F.broadcast(totals), model).select(
        model, F.col("prob").alias("threshold"), F.try_divide(seen - tp, F.col("total_neg")).alias("fpr"),
        F.try_divide(tp, F.col("total_pos")).alias("tpr"), (tp / seen).alias("precision"))


# ---- threshold metrics -----------------------------------------------------------------

def confusion(preds: DataFrame, threshold: float = 0.5, model: str = "model") -> DataFrame:
    """All four cells per model, empty ones included."""
    p = F.when(F.col("prob") >= threshold, 1).otherwise(0)
    cells = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("predicted"),
                               F.count_if((F.col("label") == a) & (p == b)).alias("n")) for a in (0, 1) for b in (0, 1)])
    return preds.groupBy(model).agg(cells.alias("cells")).select(model, F.inline("cells"))


def threshold_metrics(preds: DataFrame, threshold: float = 0.5, model: str = "model") -> DataFrame:
    """accuracy, precision, recall, f1, balanced accuracy, Brier score and log-loss."""
    hit = F.col("prob") >= threshold
    y = F.col("label") == 1
    clipped = F.least(F.greatest(F.col("prob"), F.lit(EPS)), F.lit(1 - EPS))
    c = preds.groupBy(model).agg(
        F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"),
        F.count_if(~hit & y).alias("fn"), F.count_if(~hit & ~y).alias("tn"),
        F.avg((F.col("prob") - F.col("label")) * (F.col("prob") - F.col("label"))).alias("brier"),
        F.avg(F.when(y, -F.ln(clipped)).otherwise(-F.ln(1 - clipped))).alias("log_loss"))

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    rec, spec = ratio(tp, tp + fn), ratio(tn, tn + fp)
    return c.select(
        model, ((tp + tn) / (tp + fp + fn + tn)).alias("accuracy"), ratio(tp, tp + fp).alias("precision"),
        rec.alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ((rec + spec) / 2).alias("balanced_accuracy"), "brier", "log_loss")


def model_comparison(preds: DataFrame, threshold: float = 0.5, model: str = "model") -> DataFrame:
    """The nine metrics per model."""
    return threshold_metrics(preds, threshold, model).join(area_metrics(preds, model), model).select(
        model, "accuracy", "precision", "recall", "f1", "balanced_accuracy", "roc_auc", "pr_auc", "brier", "log_loss")


def known_customer_check(preds: DataFrame, threshold: float = 0.5, model: str = "model") -> DataFrame:
    """Verified positives only: how many, their recall and mean probability."""
    known = F.col("is_known_customer") == 1
    return preds.groupBy(model).agg(
        F.count_if(known).alias("n_known"),
        F.avg(F.when(known, F.when(F.col("prob") >= threshold, 1.0).otherwise(0.0))).alias("known_recall"),
        F.avg(F.when(known, F.col("prob"))).alias("known_mean_proba"))


def class_balance(df: DataFrame, label: str, split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(F.count("*").alias("n"), F.sum(label).cast("long").alias("positives"),
                                 F.avg(label).alias("rate"))


# ---- distributions ---------------------------------------------------------------------

def reliability_bins(preds: DataFrame, n_bins: int = 10) -> DataFrame:
    """Quantile bins: mean probability and share of positives (equal edges merge)."""
    edges = exact_quantiles(preds, "prob", [i / n_bins for i in range(1, n_bins)])
    inner = F.array(*[F.lit(e) for e in edges])
    b = F.size(F.filter(inner, lambda e: e < F.col("prob")))
    return preds.groupBy(b.alias("bin")).agg(
        F.count("*").alias("n"), F.avg("prob").alias("mean_predicted"), F.avg("label").alias("fraction_positive"))


def held_out_distribution(scores: DataFrame, train: DataFrame, sampled: int, seed: int | str, id_col: str = "biz_id",
                          bins: int = 40) -> DataFrame:
    """Score histograms of the held-out positives and of a sample of the unlabelled rows.

    ``train`` has ``is_holdout`` and ``y_train``; the sample has exactly ``sampled`` rows, or all if fewer."""
    held = scores.join(train.where("is_holdout").select(id_col), id_col).select("score", F.lit("held_out").alias("part"))
    rest = scores.join(train.where("y_train = 0 AND NOT is_holdout").select(id_col), id_col)
    rest = sample_n(rest, sampled, f"distribution:{seed}", id_col).select("score", F.lit("unlabelled").alias("part"))
    return histogram(cut(held.unionByName(rest)), "part", bins=bins)


def histogram(scores: DataFrame, group: str, value: str = "score", bins: int = 40) -> DataFrame:
    """Equal-width density histogram per group, empty bins included."""
    span = scores.groupBy(group).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("total"))
    flat = F.col("lo") == F.col("hi")
    span = span.select(group, "total", F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
                       F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    span = cut(span)                                     # one row per group
    at = F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    counts = (
        scores.where(F.col(value).isNotNull()).join(F.broadcast(span), group)
        .groupBy(group, F.least(at, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("c"))
    )
    frame = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = (F.col("hi") - F.col("lo")) / bins
    n = F.coalesce("c", F.lit(0))
    return frame.join(counts, [group, "bin"], "left").select(
        group, "bin", (F.col("lo") + F.col("bin") * width).alias("left_edge"), n.alias("n"),
        (n / (F.col("total") * width)).alias("density"))
