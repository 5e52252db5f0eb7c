"""Benchmark: headline queries and one full forecasting run.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Prints one JSON line. Each query is executed in full with the ``noop``
sink (every row computed, nothing collected). ``value`` is the wall time of
the end-to-end forecasting run (features, baseline and boosted walk-forward
CV, production fits, 30-day recursive forecast, comparison tables), the
counterpart of the original's "pipeline run time".
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["load_summary", "feature_frame", "baseline_cv", "model_comparison",
            "all_baseline_forecasts", "naive_forecast", "describe_sales", "boosted_cv",
            "recursive_forecast"]


def _run(df):
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    from demand_engine import get_spark
    from demand_engine.plans import reports as R
    from demand_engine.plans.catalog import AS_OF, QUERIES
    from demand_engine.plans.fixture import fill_store
    from demand_engine.plans.forecast_run import run_forecast
    from demand_engine.sources.store import latest_forecasts
    from demand_engine.sources.tables import sales_daily

    conf = {"spark.driver.memory": "16g", "spark.eventLog.enabled": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="run-ckpt-", dir="/tmp")}
    if os.environ.get("BENCH_EVENTLOG") == "1":   # stage times: tools/stage_times.py
        log_dir = tempfile.mkdtemp(prefix="run-events-", dir="/tmp")
        conf.update({"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir})
        print(f"event log: {log_dir}", file=sys.stderr)
    spark = get_spark(f"local[{CPUS}]", int(CPUS), extra_conf=conf)
    times = {}
    # warm-up: JVM, parquet footers, codegen caches
    _run(QUERIES["load_summary"](spark, SF_DIR))
    for name in HEADLINE:
        t0 = time.perf_counter()
        _run(QUERIES[name](spark, SF_DIR))
        times[name] = round(time.perf_counter() - t0, 3)
        print(name, times[name], file=sys.stderr, flush=True)

    def forecasting_run(series: str) -> float:
        t0 = time.perf_counter()
        res = run_forecast(sales_daily(spark, SF_DIR, series),
                           model_path=tempfile.mkdtemp(prefix="run-models-", dir="/tmp"),
                           retrain=True)
        for df in (res.comparison, res.summary, res.improvement, res.totals, res.forecasts):
            _run(df)
        secs = round(time.perf_counter() - t0, 3)
        for df in (res.features, res.baseline_cv, res.boosted_cv):
            df.unpersist()
        return secs

    # the store: writing it is one time, each report over the written tables another
    root = tempfile.mkdtemp(prefix="run-store-", dir="/tmp")
    t0 = time.perf_counter()
    store = fill_store(spark, SF_DIR, root)
    times["store_build"] = round(time.perf_counter() - t0, 3)
    print("store_build", times["store_build"], file=sys.stderr, flush=True)
    items, sales, fc = (store.read(t) for t in ("drugs", "sales_daily", "forecasts_daily"))
    for name, report in (("risk_ranking", lambda: R.risk_ranking(items, fc)),
                         ("item_stats", lambda: R.item_stats(items, sales, fc, AS_OF)),
                         ("chart_series", lambda: R.chart_series(sales, fc, AS_OF)),
                         ("latest_forecasts", lambda: latest_forecasts(fc))):
        t0 = time.perf_counter()
        _run(report())
        times[f"report_{name}"] = round(time.perf_counter() - t0, 3)
    total = forecasting_run("p_type")                 # 6 item series
    times["forecasting_run"] = total
    print("forecasting_run", total, file=sys.stderr, flush=True)
    # same run keyed by supplier: ~1,000 series (~160x the series, ~36x the rows at sf0.1)
    times["forecasting_run_many_series"] = forecasting_run("l_suppkey")
    sf = os.path.basename(SF_DIR.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "forecasting_run_seconds", "value": total, "unit": "sec",
                      "queries": times, "sf": sf, "cpus": int(CPUS)}))


if __name__ == "__main__":
    main()
