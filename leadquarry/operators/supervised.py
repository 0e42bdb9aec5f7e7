"""Supervised scoring on pseudo-labels: schema screens, preparation, tuning, calibration."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadquarry.functions.features import not_null
from leadquarry.operators.calibrate import apply_sigmoid, fit_isotonic, fit_sigmoid
from leadquarry.operators.evaluate import area_metrics
from leadquarry.operators.learners import frequent_categories, split_types, wide_enough
from leadquarry.operators.rank import exact_quantiles, exact_quantiles_by_column
from leadquarry.operators.sampling import place
from leadquarry.session import bare, cut

# --- fixed values ----------------------------------------------------------------------
TARGET, KNOWN = "predicted_customer", "is_known_customer"
ID_TEXT = ["name", "address", "phone", "website", "email", "place_url", "plus_code", "scraped_at", "hours"]
CATEGORICAL = ["category", "search_category", "governorate"]
LEAKAGE_PATTERNS = [r"pu_score", r"^prob_", r"^rank$", r"^rank_", r"^pred_proba", r"^propensity", r"^match_"]
MAX_PRESENCE_CORRELATION = 0.98
THRESHOLD = 0.5
LOGISTIC_GRID = [{"C": 0.1}, {"C": 1.0}, {"C": 3.0}]
FOREST_GRID = [{"trees": 300, "depth": 30, "min_leaf": 1}, {"trees": 500, "depth": 16, "min_leaf": 2},
               {"trees": 500, "depth": 30, "min_leaf": 5}]
BOOSTED_GRID = [{"iterations": 400, "step": 0.05, "depth": 5}, {"iterations": 700, "step": 0.03, "depth": 5},
                {"iterations": 500, "step": 0.05, "depth": 6}]
# ---------------------------------------------------------------------------------------


#: Grid points that are fitted at the same time.
FITS_SIDE_BY_SIDE = 3


# ---- data preparation ------------------------------------------------------------------

def presence_flags(df: DataFrame) -> DataFrame:
    """``has_*`` = not null, only where the flag does not exist yet."""
    new = {f"has_{c}": not_null(F.col(c)) for c in ("website", "email", "phone")
           if c in df.columns and f"has_{c}" not in df.columns}
    return df.withColumns(new) if new else df


def pseudo_label(df: DataFrame) -> DataFrame:
    """Known customer, or prior-corrected score of at least one half; kept if present."""
    if TARGET in df.columns:
        return df
    if KNOWN not in df.columns and "pu_score_prior_corr" not in df.columns:
        raise ValueError(f"the target needs {KNOWN} or pu_score_prior_corr")
    known = F.coalesce(F.col(KNOWN).cast("int"), F.lit(0)) if KNOWN in df.columns else F.lit(0)
    score = F.coalesce(F.col("pu_score_prior_corr"), F.lit(0.0)) if "pu_score_prior_corr" in df.columns else F.lit(0.0)
    return df.withColumn(TARGET, F.when((known == 1) | (score >= 0.5), 1).otherwise(0))


@dataclass
class FeatureSchema:
    features: list[str]
    numeric: list[str]
    categorical: list[str]
    leakage: list[str]
    identifiers: list[str]
    constant: list[str]


def leaky_names(columns: Sequence[str]) -> list[str]:
    rx = [re.compile(p, re.I) for p in LEAKAGE_PATTERNS]
    return [c for c in columns if c not in (TARGET, KNOWN) and any(r.search(c) for r in rx)]


def column_screen(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: constant or all missing (min = max), and the correlation of its presence with
    the known label.  One aggregation for all columns."""
    known = F.coalesce(F.col(KNOWN).cast("double"), F.lit(0.0)) if KNOWN in df.columns else None
    items = []
    for c in columns:
        present = F.col(c).isNotNull().cast("double")
        r = F.lit(None).cast("double")
        if known is not None:                              # Pearson r of two 0/1 columns from counts
            n, p, k = F.count(F.lit(1)), F.sum(present), F.sum(known)
            r = F.abs(F.try_divide(n * F.sum(present * known) - p * k, F.sqrt((n * p - p * p) * (n * k - k * k))))
        items.append(F.struct(
            F.lit(c).alias("column"),
            F.coalesce(F.min(F.col(c).cast("string")) == F.max(F.col(c).cast("string")), F.lit(True)).alias("is_constant"),
            r.alias("presence_correlation")))
    return df.agg(F.array(*items).alias("x")).select(F.inline("x"))


def identify_columns(df: DataFrame, id_cols: Sequence[str] = ("biz_id",)) -> FeatureSchema:
    """Feature discovery: leakage by name, identifiers, constants, leakage by presence."""
    leakage = leaky_names(df.columns)
    identifiers = [c for c in ID_TEXT if c in df.columns]
    drop = {*leakage, *identifiers, *id_cols, TARGET, KNOWN}
    candidates = [c for c in df.columns if c not in drop]
    screen = {r.column: r for r in column_screen(df, candidates).collect()}       # one row per column
    constant = [c for c in candidates if screen[c].is_constant]
    label_like = [c for c in candidates if c not in constant
                  and (screen[c].presence_correlation or 0.0) > MAX_PRESENCE_CORRELATION]
    features = [c for c in candidates if c not in constant and c not in label_like]
    numeric, text = split_types(df, features)
    categorical = [c for c in features if c in text or c in CATEGORICAL]
    return FeatureSchema(features, [c for c in numeric if c not in CATEGORICAL], categorical,
                         sorted({*leakage, *label_like}), sorted(identifiers), constant)


def align_columns(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), types: dict[str, str] | None = None) -> DataFrame:
    """Exactly ``columns`` in order: absent ones null, extra ones dropped."""
    types = types or {}
    return df.select(*keep, *[
        F.col(c) if c in df.columns else F.lit(None).cast(types.get(c, "double")).alias(c) for c in columns])


# ---- preparation as tables -------------------------------------------------------------

def collapse_rare(df: DataFrame, columns: Sequence[str], limit: int = 30, infrequent: str = "infrequent") -> DataFrame:
    """Most-frequent fill, then values outside the top ``limit - 1`` become one bucket.

    A column with at most ``limit`` values keeps them all."""
    kept, out = kept_categories(df, columns, limit), {}
    for c in columns:
        filled = F.coalesce(F.col(c).cast("string"), F.lit(kept[c][0] if kept[c] else infrequent))
        out[c] = F.when(filled.isin(kept[c]), filled).otherwise(infrequent)
    return df.withColumns(out)


def prepare_numeric(train: DataFrame, df: DataFrame, columns: Sequence[str], scale: bool = False) -> DataFrame:
    """Median fill from the training rows, a missing flag for columns with holes in training,
    optionally standardised by training mean and population std (flags included)."""
    stats = train.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    holes = [c for c in columns if stats[c]]
    medians = {c: exact_quantiles(train, c, [0.5])[0] for c in columns}

    def fill(t: DataFrame) -> DataFrame:
        t = t.withColumns({f"{c}_missing": F.col(c).isNull().cast("double") for c in holes})
        return t.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c])) for c in columns})
    out = fill(df)
    if not scale:
        return out
    cols = [*columns, *[f"{c}_missing" for c in holes]]
    m = fill(train).agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return out.withColumns({c: (F.col(c) - m[f"m_{c}"]) / (m[f"s_{c}"] or 1.0) for c in cols})


def kept_categories(train: DataFrame, columns: Sequence[str], limit: int = 30) -> dict[str, list[str]]:
    """Values that keep a column of their own: all of at most ``limit``, else the ``limit - 1`` most frequent."""
    top = frequent_categories(train, columns, limit + 2)   # enough to see whether there are more
    return {c: v if len(v) <= limit else v[: limit - 1] for c, v in top.items()}


def prep_stages(train: DataFrame, schema: FeatureSchema, scale: bool, one_hot: bool) -> list:
    """MLlib stages that turn raw columns into ``features``; usable on new rows.

    The same rules as :func:`prepare_numeric` and :func:`collapse_rare`: exact medians of the
    training rows, population deviations, rare values as one bucket.  Without one-hot every
    training category keeps its index, and unseen values count as missing ones."""
    numeric, text = schema.numeric, schema.categorical
    holes_row = train.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in numeric]).first() if numeric else {}
    holes = [c for c in numeric if holes_row[c]]
    medians = {c: m[0] if m[0] is not None else 0.0 for c, m in exact_quantiles_by_column(train, numeric, [0.5]).items()}

    def quoted(v: str) -> str:
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    values = {f"{c}__n": f"coalesce(CAST(`{c}` AS DOUBLE), {medians[c]!r}D)" for c in numeric}
    values |= {f"{c}__m": f"CAST(`{c}` IS NULL AS DOUBLE)" for c in holes}
    if scale and values:
        m = train.selectExpr(*[f"{e} AS `{n}`" for n, e in values.items()]).agg(
            *[f(c).alias(f"{k}_{c}") for c in values for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        values = {n: f"({e} - {m[f'm_{n}']!r}D) / {(m[f's_{n}'] or 1.0)!r}D" for n, e in values.items()}
    exprs = [f"{e} AS `{n}`" for n, e in values.items()]
    kept = kept_categories(train, text) if one_hot else {}
    for c in text:
        value = f"CAST(`{c}` AS STRING)"
        if one_hot:
            among, fill = ", ".join(quoted(v) for v in kept[c]) or "''", quoted(kept[c][0]) if kept[c] else "'__rare__'"
            value = f"CASE WHEN `{c}` IS NULL THEN {fill} WHEN {value} IN ({among}) THEN {value} ELSE '__rare__' END"
        exprs.append(f"{value} AS `{c}__t`")
    stages: list = [SQLTransformer(statement=f"SELECT *, {', '.join(exprs)} FROM __THIS__")]
    if text:
        idx = [f"{c}__i" for c in text]
        stages.append(StringIndexer(inputCols=[f"{c}__t" for c in text], outputCols=idx, handleInvalid="keep"))
        if one_hot:
            stages.append(OneHotEncoder(inputCols=idx, outputCols=[f"{c}__v" for c in text], dropLast=False))
    cats = [f"{c}__v" if one_hot else f"{c}__i" for c in text]
    stages.append(VectorAssembler(inputCols=[*values, *cats], outputCol="features"))
    return stages


# ---- models ----------------------------------------------------------------------------

def class_weights(train: DataFrame) -> dict[str, float]:
    n = train.agg(F.count_if(F.col(TARGET) == 1).alias("p"), F.count_if(F.col(TARGET) == 0).alias("n")).first()
    if not n.p or not n.n:
        raise ValueError("the target has a single class")
    total = n.p + n.n
    return {"balanced_1": total / (2 * n.p), "balanced_0": total / (2 * n.n), "ratio": max(n.n / n.p, 1.0), "n": total}


def model_specs(weights: dict[str, float], seed: int = 42) -> dict[str, tuple]:
    """name -> (make(**params), grid, (weight of 1, weight of 0), scale, one-hot)."""
    common = {"featuresCol": "features", "labelCol": TARGET, "weightCol": "__w"}

    def lr(C: float):
        return LogisticRegression(maxIter=2000, elasticNetParam=0.0, standardization=False,
                                  regParam=1.0 / (C * weights["n"]), **common)

    def rf(trees: int, depth: int, min_leaf: int):
        return RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf, maxBins=64,
                                      seed=seed, **common)

    def gbt(iterations: int, step: float, depth: int):
        return GBTClassifier(maxIter=iterations, stepSize=step, maxDepth=depth, maxBins=64, minInstancesPerNode=20,
                             subsamplingRate=0.9, featureSubsetStrategy="0.9", seed=seed, **common)
    balanced = (weights["balanced_1"], weights["balanced_0"])
    return {
        "LogisticRegression": (lr, LOGISTIC_GRID, balanced, True, True),
        "RandomForest": (rf, FOREST_GRID, balanced, False, True),
        "BoostedTrees": (gbt, BOOSTED_GRID, (weights["ratio"], 1.0), False, False),
    }


def positive_probability(model: PipelineModel, df: DataFrame, out: str = "prob") -> DataFrame:
    return model.transform(df).select(*df.columns, vector_to_array("probability")[1].alias(out))


@dataclass
class Tuned:
    name: str
    params: dict
    val_ap: float
    model: PipelineModel


def tune(name: str, spec: tuple, train: DataFrame, val: DataFrame, schema: FeatureSchema) -> Tuned:
    """Fit each grid point on train, keep the best average precision on validation."""
    make, grid, (w1, w0), scale, one_hot = spec
    prep = Pipeline(stages=prep_stages(train, schema, scale, one_hot)).fit(train)
    ready = cut(prep.transform(train).select(
        TARGET, "features", F.when(F.col(TARGET) == 1, F.lit(w1)).otherwise(F.lit(w0)).alias("__w")))
    val_ready = cut(prep.transform(val).select(F.col(TARGET).alias("label"), "features"))
    with ThreadPoolExecutor(FITS_SIDE_BY_SIDE) as pool:    # independent fits on the same rows
        fits = list(pool.map(lambda params: wide_enough(make(**params), ready).fit(ready), grid))
    best = None
    for params, fitted in zip(grid, fits):
        fitted = bare(fitted, train.sparkSession)
        preds = fitted.transform(val_ready).select(
            F.lit(name).alias("model"), "label", vector_to_array("probability")[1].alias("prob"))
        ap = area_metrics(preds).first().pr_auc or 0.0
        if best is None or ap > best.val_ap:
            best = Tuned(name, params, ap, PipelineModel(stages=[*prep.stages, fitted]))
    return best


def predictions(tuned: Sequence[Tuned], df: DataFrame, id_col: str = "biz_id") -> DataFrame:
    """Long ``(model, id, label, prob, is_known_customer)``."""
    known = F.col(KNOWN) if KNOWN in df.columns else F.lit(0)
    out = None
    for t in tuned:
        part = positive_probability(t.model, df).select(
            F.lit(t.name).alias("model"), id_col, F.col(TARGET).alias("label"), "prob",
            F.coalesce(known.cast("int"), F.lit(0)).alias(KNOWN))
        out = part if out is None else out.unionByName(part)
    return out


CALIBRATIONS = {"isotonic": fit_isotonic, "sigmoid": fit_sigmoid}


def calibrated_scorer(best: Tuned, val: DataFrame, calibration: str = "isotonic"):
    """Isotonic or sigmoid model on the validation probabilities of the best classifier."""
    rows = positive_probability(best.model, val).select(F.col("prob").alias("score"), F.col(TARGET).cast("double").alias("label"))
    return CALIBRATIONS[calibration](rows)


def apply_calibration(model, df: DataFrame, score: str = "prob", out: str = "prob_client") -> DataFrame:
    scored = df.withColumn("score", F.col(score))
    done = (apply_sigmoid(model, scored) if isinstance(model, PipelineModel) else model.transform(scored)).drop("score")
    clipped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), "calibrated"))
    return done.withColumn(out, F.when(F.col("calibrated").isNotNull(), clipped)).drop("calibrated")


def decide(df: DataFrame, prob: str = "prob_client", out: str = "predicted_client", threshold: float = THRESHOLD) -> DataFrame:
    return df.withColumn(out, F.when(F.col(prob) >= threshold, 1).otherwise(0))


def calibration_summary(before_after: DataFrame) -> DataFrame:
    """Brier score of ``prob`` and ``prob_calibrated`` against ``label`` as two metric rows."""
    p, q, y = F.col("prob"), F.col("prob_calibrated"), F.col("label")
    one = before_after.agg(F.avg((p - y) * (p - y)).alias("brier_before"), F.avg((q - y) * (q - y)).alias("brier_after"))
    return one.unpivot([], ["brier_before", "brier_after"], "metric", "value")


# ---- importance ------------------------------------------------------------------------

def native_importance(model: PipelineModel, transformed: DataFrame, top: int = 20) -> list[tuple[str, float]]:
    """|coefficient| or tree importance per vector slot, largest first."""
    last = model.stages[-1]
    values = last.coefficients if hasattr(last, "coefficients") else last.featureImportances
    attrs = transformed.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    names = {a["idx"]: a["name"] for group in attrs.values() for a in group}
    scored = [(names.get(i, str(i)), abs(float(values[i]))) for i in range(len(values))]
    return sorted(scored, key=lambda x: -x[1])[:top]


def permutation_importance(model: PipelineModel, df: DataFrame, columns: Sequence[str], seed: int = 42,
                           top: int = 20, id_col: str = "biz_id") -> DataFrame:
    """Loss of average precision when one raw column is shuffled between rows.

    All columns are shuffled by the same cyclic shift along a hash order: each row takes the
    values of the row before it, so one sort serves every column and no row is gathered.
    """
    from leadquarry.operators.rank import row_numbers
    n = df.count()
    order = cut(row_numbers(df.withColumn("__h", place(id_col, f"perm:{seed}")), [F.asc("__h"), F.asc(id_col)], "__n"))
    donor = order.select(
        F.when(F.col("__n") == n, 1).otherwise(F.col("__n") + 1).alias("__n"),
        *[F.col(c).alias(f"__d_{c}") for c in columns])
    pairs = cut(order.join(donor, "__n"))
    frames = positive_probability(model, order.select(*df.columns)).select(
        F.lit("").alias("model"), F.col(TARGET).alias("label"), "prob")
    for c in columns:
        shuffled = pairs.select(*[F.col(f"__d_{c}").alias(c) if x == c else F.col(x) for x in df.columns])
        frames = frames.unionByName(positive_probability(model, shuffled).select(
            F.lit(c).alias("model"), F.col(TARGET).alias("label"), "prob"))
    areas = cut(area_metrics(frames))                     # one row per column
    base = areas.where("model = ''").first().pr_auc
    return (
        areas.where("model <> ''").select(F.col("model").alias("feature"), (F.lit(base) - F.col("pr_auc")).alias("ap_drop"))
        .orderBy(F.desc("ap_drop"), F.asc("feature")).limit(top)
    )


# ---- the stage -------------------------------------------------------------------------

@dataclass
class SupervisedResult:
    schema: FeatureSchema
    tuned: list[Tuned]
    best: Tuned
    test_predictions: DataFrame
    calibrator: object


def train_models(df: DataFrame, specs: Callable[[dict], dict[str, tuple]] = model_specs, seed: int = 42,
                 id_col: str = "biz_id", calibration: str = "isotonic") -> tuple[SupervisedResult, DataFrame]:
    """Flags, target, screens, split, tuning, selection and calibration.

    ``specs`` makes the model families from the class weights of the training rows.  Returns the
    result and the split table."""
    from leadquarry.operators.sampling import stratified_split
    df = cut(pseudo_label(presence_flags(df)))
    schema = identify_columns(df, (id_col,))
    data = cut(stratified_split(df, TARGET, seed, id_col=id_col))
    train, val, test = (data.where(F.col("split") == s) for s in ("train", "val", "test"))
    tuned = [tune(name, spec, train, val, schema) for name, spec in specs(class_weights(train)).items()]
    best = max(tuned, key=lambda t: t.val_ap)
    result = SupervisedResult(schema, tuned, best, cut(predictions(tuned, test, id_col)), calibrated_scorer(best, val, calibration))
    return result, data


def score_rows(model: PipelineModel, calibrator, df: DataFrame, columns: Sequence[str], types: dict[str, str],
               id_col: str = "biz_id", threshold: float = THRESHOLD) -> DataFrame:
    """Probability and decision for new raw rows: flags recreated, columns aligned.

    Without a calibrator the model's own probability decides."""
    df = presence_flags(df)
    rest = [c for c in df.columns if c not in columns]
    aligned = align_columns(df, columns, keep=rest, types=types)
    scored = positive_probability(model, aligned)
    scored = scored.withColumnRenamed("prob", "prob_client") if calibrator is None else apply_calibration(calibrator, scored).drop("prob")
    return decide(scored, threshold=threshold)
