"""The supervised stage as one run: from a scored table to a bundle, reports and scored rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadquarry.operators import evaluate as E
from leadquarry.operators import supervised as S
from leadquarry.session import cut
from leadquarry.sources import tables


@dataclass
class Reports:
    comparison: DataFrame          # nine metrics per model
    known_customers: DataFrame     # recall and mean probability on verified positives
    calibration: DataFrame         # Brier score before and after
    confusion: DataFrame
    reliability: DataFrame
    importance: DataFrame          # drop of average precision per column
    scored: DataFrame              # every row with probability and decision
    summary: dict


def run(df: DataFrame, folder: str | None = None, specs: Callable[[dict], dict[str, tuple]] = S.model_specs,
        seed: int = 42, id_col: str = "biz_id", calibration: str = "isotonic") -> Reports:
    """Trains, evaluates on the test rows, saves the bundle and scores the whole table.

    ``calibration`` is "isotonic" or "sigmoid".  With a ``folder`` every report is written there, the bundle under ``bundle`` and the summary
    as ``run_summary.json``; the scored table then comes from the bundle as read back."""
    spark = df.sparkSession
    result, data = S.train_models(df, specs, seed, id_col, calibration)
    best, test = result.best, data.where("split = 'test'")
    of_best = result.test_predictions.where(F.col("model") == best.name)
    calibrated = S.apply_calibration(result.calibrator, of_best, out="prob_calibrated")
    model, calibrator, threshold, types = best.model, result.calibrator, S.THRESHOLD, dict(data.dtypes)
    meta = {"best": best.name, "params": best.params, "columns": result.schema.features, "types": types, "threshold": threshold}
    if folder:
        tables.save_bundle(model, meta, f"{folder}/bundle", calibrator)
        model, calibrator, meta = tables.load_bundle(spark, f"{folder}/bundle")
    scored = S.score_rows(model, calibrator, df, meta["columns"], meta["types"], id_col, meta["threshold"])
    reports = Reports(
        cut(E.model_comparison(result.test_predictions)), cut(E.known_customer_check(result.test_predictions)),
        cut(S.calibration_summary(calibrated)), cut(E.confusion(result.test_predictions)), cut(E.reliability_bins(of_best)),
        cut(S.permutation_importance(best.model, test, result.schema.features)), scored, {})
    rows = lambda t: [r.asDict() for r in t.collect()]  # noqa: E731  a row per model or metric
    reports.summary |= {
        "best": best.name, "params": best.params, "calibration_method": calibration, "validation_pr_auc": {t.name: t.val_ap for t in result.tuned},
        "rows": {r.split: r.n for r in data.groupBy("split").agg(F.count("*").alias("n")).collect()}, "threshold": threshold,
        "leakage": result.schema.leakage, "constant": result.schema.constant,
        "test": rows(reports.comparison), "known_customers": rows(reports.known_customers), "calibration": rows(reports.calibration)}
    if folder:
        for name in ("comparison", "known_customers", "calibration", "confusion", "reliability", "importance", "scored"):
            tables.write_table(getattr(reports, name), f"{folder}/{name}.parquet")
        tables.write_json(spark, reports.summary, f"{folder}/run_summary.json")
    return reports
