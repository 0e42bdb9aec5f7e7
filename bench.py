"""Headline stages at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from leadquarry import fixtures as fx  # noqa: E402
from leadquarry.operators import evaluate, pu, spatial, supervised  # noqa: E402
from leadquarry.operators.features import FEATURES_V1, build_features, scalar_features  # noqa: E402
from leadquarry.operators.learners import Scorecard  # noqa: E402
from leadquarry.operators.sampling import holdout_split  # noqa: E402
from leadquarry.plans import presets  # noqa: E402
from leadquarry.session import cut, local_session  # noqa: E402


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, memory="20g", app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name, fn):
        start = time.time()
        out = fn()
        times[name] = round(time.time() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
        return out

    def sink(df):
        df.write.format("noop").mode("overwrite").save()

    config = presets.Config(version="v3")
    b, p = cut(fx.businesses(spark, sf)), cut(fx.purchases(spark, sf))

    def linkage():
        linked = presets.link_stage(p, b, config)
        sink(linked.review)
        return cut(linked.labeled)
    labeled = timed("linkage_v3", linkage)
    features = timed("features_v2", lambda: cut(build_features(labeled)))
    scalars = cut(scalar_features(labeled))
    timed("competitor_density", lambda: sink(spatial.competitor_density(scalars)))
    v1 = cut(build_features(labeled, "v1"))

    def one_seed():
        prepared = Scorecard().prepare(v1, FEATURES_V1)
        train = cut(holdout_split(v1.select("biz_id", "is_customer"), 42))
        sink(pu.bagging(prepared, train, 42, weighted=False)[0])
    timed("bagging_one_seed_50_rounds", one_seed)

    def scoring():
        s = presets.score_stage(features, labeled, config)
        for df in (s.comparison, s.ranked, s.stability, s.priors, s.top_by_governorate, s.top_by_search_category):
            sink(df)
        return s
    s = timed("scoring_v3_five_seeds", scoring)
    timed("stability_curve", lambda: sink(evaluate.recall_at_k(
        s.scores.join(features.select("biz_id", features.is_customer.alias("target")), "biz_id"), evaluate.CURVE_KS)))

    def logistic():
        df = supervised.pseudo_label(supervised.presence_flags(s.ranked.drop("match_confidence", "match_reason")))
        family = "LogisticRegression"
        result, _ = supervised.train_models(df, lambda weights: {family: supervised.model_specs(weights)[family]})
        sink(evaluate.model_comparison(result.test_predictions))
    timed("supervised_logistic_grid", logistic)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
