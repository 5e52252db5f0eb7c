"""Plan-shape guards for the properties the design relies on at scale."""

import re

from pyspark.sql import functions as F

from demand_engine.config import DEFAULT
from demand_engine.operators import baselines as B
from demand_engine.operators import recursive as RC
from demand_engine.plans import reports as R
from demand_engine.session import ensure_checkpoint_dir
from demand_engine.sources.tables import sales_daily

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_needed_columns(spark):
    plan = _plan(sales_daily(spark, SF))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", df_formatted(sales_daily(spark, SF)))
    assert sorted(schemas) == ["l_partkey:bigint,l_quantity:double,l_shipdate:timestamp_ntz",
                               "p_partkey:bigint,p_type:string"]
    assert "PartialAggregate" in plan or "partial_sum" in plan


def df_formatted(df) -> str:
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def test_baseline_cv_one_series_shuffle_one_sort(spark):
    plan = _plan(B.evaluate_baselines_cv(sales_daily(spark, SF)))
    # one exchange for the raw daily aggregate (series, day), one by series alone
    assert len(re.findall(r"Exchange hashpartitioning\(drug_code#\d+, \d+\)", plan)) == 1
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2
    assert len(re.findall(r"\bSort \[", plan)) == 1


def test_recursion_step_has_no_shuffle(spark):
    from demand_engine.operators.features import engineer_features
    feats = engineer_features(sales_daily(spark, SF))
    ensure_checkpoint_dir(spark)
    state = RC.initial_state(feats).checkpoint(eager=True)
    step = state.withColumn("date", F.date_add("last_date", 1)).select(
        "drug_code", *RC._step_feature_columns(DEFAULT, False))
    assert "Exchange" not in _plan(step)


def test_naive_forecast_is_an_aggregate(spark):
    from demand_engine.sources.tables import sales_daily as daily
    for df in (B.naive_forecast(daily(spark, SF)), B.forecast_calendar(daily(spark, SF))):
        plan = _plan(df)
        assert "Window" not in plan and not re.search(r"\bSort \[.*order", plan)


def test_newest_run_is_an_aggregate_not_an_item_window(spark):
    fc = spark.createDataFrame([(1, 1, "2024-01-01 00:00:00")],
                               "id long, drug_id long, ts string").select(
        "id", "drug_id", F.col("ts").cast("timestamp_ntz").alias("run_timestamp"))
    plan = _plan(R.newest_run(fc))
    assert "Window" not in plan and "HashAggregate" in plan
