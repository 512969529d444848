"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then BENCH_RUNS times (default 2); the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import functions as F

from lapcast.catalog import QUERIES
from lapcast.catalog import forecasts, preparation, proofs
from lapcast.catalog.registry import BY_TYPE, EVENTS, ITEMS, performances, table
from lapcast.operators import dependence, forecast, pinball, runs
from lapcast.operators.evaluate import evaluate
from lapcast.operators.windows import windows
from lapcast.plans.bands import band_report, empirical_bands
from lapcast.plans.cleaning import clean_performances
from lapcast.session import build_session, written


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(cpus, int(cpus) if cpus.isdigit() else 8, "lapcast-bench")
    spark.sparkContext.setLogLevel("ERROR")
    events, items = table(spark, sf, "events"), table(spark, sf, "lineitem")

    raw = written(performances(spark, sf), "bench-raw")
    made, names, _ = forecasts.feature_windows(spark, sf)
    scored = written(empirical_bands(events, EVENTS), "bench-bands")
    model = forecast.fit_quantile_forecaster(made, names, rounds=1)

    def done(df):
        df.write.format("noop").mode("overwrite").save()

    cases = {
        "cleaning_pipeline": lambda: done(clean_performances(raw, preparation._LIMITS).table),
        "gaps_lineitem": lambda: done(QUERIES["w1_days_since_last"](spark, sf)),
        "windows_events_20_3": lambda: done(windows(events, EVENTS, ["value", "event_id"], ["user_id"], ["event_id"])),
        "windows_lineitem_5_3": lambda: done(windows(items, ITEMS, ["l_extendedprice"], ["l_quantity"], ["l_linenumber"], length=5)),
        "serving_windows": lambda: done(QUERIES["w5_serving_windows"](spark, sf)),
        "acf_and_ljung_box": lambda: [
            done(dependence.acf(p, BY_TYPE)) or done(dependence.ljung_box(p, BY_TYPE))
            for p in [dependence.lag_products(events, BY_TYPE).persist()]
        ],
        "empirical_bands_report": lambda: done(band_report(events, EVENTS)),
        "evaluation_report": lambda: done(evaluate(scored, ["horizon"])),
        "regression_round": lambda: forecast._gram(made, model, 0.05),
        "regression_fit_10_rounds": lambda: forecast.fit_quantile_forecaster(made, names, rounds=10),
        "regression_score": lambda: done(forecast.predict(made, model, ["user_id", "origin_ts"])),
        "trimmed_outliers": lambda: done(QUERIES["f7_trimmed_outliers"](spark, sf)),
        "frequent_series": lambda: done(QUERIES["f6_trainable_series"](spark, sf)),
        "exact_split": lambda: done(QUERIES["x2_exact_split"](spark, sf)),
        "early_stop": lambda: done(runs.early_stop(forecasts.curves(spark, sf), 7, 1e-4)),
        "median_stop": lambda: done(runs.median_stop(forecasts.curves(spark, sf))),
        "live_windows": lambda: done(QUERIES["r1_live_windows"](spark, sf)),
        "exact_fit_pass": lambda: pinball.fit_exact(made, names, tolerance=1e-5, passes=5),
        "search_30_settings_scan": lambda: proofs.searched(spark, sf, 30, 1),
        "density_of_prices": lambda: done(QUERIES["a13_density_of_prices"](spark, sf)),
        "long_lags_500": lambda: done(QUERIES["t1_long_autocorrelation"](spark, sf)),
    }
    chosen = sys.argv[1:] or list(cases)
    seconds = {}
    for name in chosen:
        cases[name]()
        spark.catalog.clearCache()
        took = []
        for _ in range(repeats):
            start = time.perf_counter()
            cases[name]()
            took.append(time.perf_counter() - start)
            spark.catalog.clearCache()
        seconds[name] = round(statistics.median(took), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    facts = {"event_rows": events.count(), "windows": made.count(), "band_rows": scored.agg(F.count("y")).first()[0]}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf, **facts}))
    spark.stop()


if __name__ == "__main__":
    main()
