"""A filled store derived from the given tables, for reports and checks.

items  = distinct series codes, ids in code order;
sales  = the daily sales series keyed by item id;
forecasts = two runs of baseline forecasts, each 30 days after a cutoff:
  run 1 (``RUN_1``): Naive, training up to 45 days before each series ends;
  run 2 (``RUN_2``): Moving Average and Seasonal Naive, up to 30 days before.
The runs overlap by about two weeks so that "latest" queries have to choose.
"""

from __future__ import annotations

import datetime as _dt
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, MOVING_AVERAGE, NAIVE, SEASONAL_NAIVE
from ..operators.baselines import baseline_forecasts
from ..operators.folds import train_test_split
from ..sources import store
from ..sources.tables import sales_daily
from ..sources.wide import item_metadata

# The two run timestamps and cutoffs of the history fixture.
RUN_1 = _dt.datetime(2024, 1, 1, 6, 0, 0)
RUN_2 = _dt.datetime(2024, 2, 1, 6, 0, 0)
RUN_1_DAYS_BACK = 45
RUN_2_DAYS_BACK = 30
RUNS = ((RUN_1, RUN_1_DAYS_BACK, (NAIVE,)),
        (RUN_2, RUN_2_DAYS_BACK, (MOVING_AVERAGE, SEASONAL_NAIVE)))


class DemoStore:
    """The store's tables as frames, each built when a query first asks for it
    and dropped with the query: nothing is kept for the next one."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.sales_long = sales_daily(spark, sf_dir)

    @cached_property
    def items(self) -> DataFrame:
        return store.upsert_items(None, item_metadata(self.sales_long))

    @cached_property
    def sales(self) -> DataFrame:
        return store.sales_records(self.sales_long, self.items)

    @cached_property
    def forecasts(self) -> DataFrame:
        return forecast_history(self.sales_long, self.items)


def forecast_history(sales_long: DataFrame, items: DataFrame) -> DataFrame:
    runs = None
    for ts, back, models in RUNS:
        train = train_test_split(sales_long, back).filter("is_train").drop("is_train")
        fc = (baseline_forecasts(train, DEFAULT.horizon, DEFAULT, models=models)
              .withColumn("run_timestamp", store.ntz(ts)))
        runs = fc if runs is None else runs.unionByName(fc)
    hist = store.forecast_records(runs, items, F.col("model_name"), F.col("run_timestamp"))
    return store.with_sequential_id(
        hist, ["run_timestamp", "model_name", "drug_id", "forecast_date"], 1).select(
        "id", "drug_id", "forecast_date", "run_timestamp", "predicted_demand",
        "lower_ci", "upper_ci", "model_name")


def demo_store(spark: SparkSession, sf_dir: str) -> DemoStore:
    return DemoStore(spark, sf_dir)


def fill_store(spark: SparkSession, sf_dir: str, root: str) -> store.ParquetStore:
    """Write the same tables through :class:`ParquetStore` under ``root``."""
    st = store.ParquetStore(spark, root)
    long = sales_daily(spark, sf_dir)
    st.upsert_items(item_metadata(long))
    st.upsert_sales(long)
    for ts, back, models in RUNS:
        train = train_test_split(long, back).filter("is_train").drop("is_train")
        for model in models:
            st.append_forecasts(baseline_forecasts(train, DEFAULT.horizon, DEFAULT, models=(model,)),
                                model, ts)
    return st
