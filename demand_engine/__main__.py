"""Command line: ``python -m demand_engine run|view-sales ...``.

    python -m demand_engine run --csv sales.csv --store /shared/wh --models /shared/models [--retrain]
    python -m demand_engine run --sf-dir /shared/tables --series p_type --store /shared/wh
    python -m demand_engine view-sales --store /shared/wh [--code R03]

On a cluster, submit with ``spark-submit -m demand_engine ...``-style launchers;
the master and the checkpoint folder come from the submit configuration.
"""

from __future__ import annotations

import argparse
from dataclasses import replace

from .config import DEFAULT
from .session import get_spark


def _run(args) -> None:
    from .plans.forecast_run import run_forecast
    from .sources.store import ParquetStore
    from .sources.tables import sales_daily
    from .sources.wide import load_raw_sales, wide_to_long

    spark = get_spark(args.master)
    sales = (wide_to_long(load_raw_sales(spark, args.csv)) if args.csv
             else sales_daily(spark, args.sf_dir, args.series))
    cfg = replace(DEFAULT, horizon=args.horizon, holiday_country=args.country,
                  gbt_max_iter=args.max_rounds)
    store = ParquetStore(spark, args.store) if args.store else None
    res = run_forecast(sales, cfg, store=store, model_path=args.models, retrain=args.retrain)
    ordered = res.comparison.orderBy("drug_code", "model_rank")
    if args.report:
        ordered.write.mode("overwrite").json(args.report)
    else:  # every row, one partition at a time
        print("\t".join(ordered.columns))
        for row in ordered.toLocalIterator():
            print("\t".join(map(str, row)))
    res.summary.orderBy("model_rank").show(truncate=False)
    res.improvement.show(truncate=False)
    res.totals.show()
    for df in (res.features, res.baseline_cv, res.boosted_cv):
        df.unpersist()


def _view_sales(args) -> None:
    from .plans.reports import describe_sales, view_sales
    from .sources.store import ParquetStore

    spark = get_spark(args.master)
    st = ParquetStore(spark, args.store)
    sales, items = st.read("sales_daily"), st.read("drugs")
    if sales is None or items is None:
        print("No sales data found in the store.")
        return
    view = view_sales(sales, items, args.code)
    view.limit(10).show()
    describe_sales(view_sales(sales, items, args.code, ordered=False),
                   by=None if args.code else "drug_code").show(truncate=False)


def main(argv=None) -> None:
    p = argparse.ArgumentParser(prog="demand_engine")
    p.add_argument("--master", default=None, help="e.g. local[8]; default: from spark-submit")
    sub = p.add_subparsers(dest="cmd", required=True)
    r = sub.add_parser("run", help="evaluate, train or load, forecast, store")
    src = r.add_mutually_exclusive_group(required=True)
    src.add_argument("--csv", help="wide sales CSV (date column + one column per item)")
    src.add_argument("--sf-dir", help="folder with the lineitem/part parquet tables")
    r.add_argument("--series", default="p_type", help="series column for --sf-dir")
    r.add_argument("--store", help="store root folder (shared storage on a cluster)")
    r.add_argument("--report", help="folder for the per-series comparison (JSON); printed if absent")
    r.add_argument("--models", help="model folder; reused unless --retrain")
    r.add_argument("--retrain", action="store_true")
    r.add_argument("--horizon", type=int, default=DEFAULT.horizon)
    r.add_argument("--max-rounds", type=int, default=DEFAULT.gbt_max_iter,
                   help="boosting rounds at most (patience usually stops earlier)")
    r.add_argument("--country", default=DEFAULT.holiday_country)
    r.set_defaults(fn=_run)
    v = sub.add_parser("view-sales", help="first rows and summary of stored sales")
    v.add_argument("--store", required=True)
    v.add_argument("--code", default=None)
    v.set_defaults(fn=_view_sales)
    args = p.parse_args(argv)
    args.fn(args)


if __name__ == "__main__":
    main()
