"""One test per remaining semantic trap of SURVEY §2.12 (others live next to their operator)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from demand_engine.config import DEFAULT
from demand_engine.operators import evaluation as E
from demand_engine.operators import features as FE
from demand_engine.operators import recursive as RC
from demand_engine.sources import store as S


def test_t06_external_features_frozen_unless_refreshed(spark, sample_sales):
    feats = FE.engineer_features(sample_sales)
    state = RC.initial_state(feats).withColumn("date", F.lit(dt.date(2020, 7, 1)))
    frozen = state.select(*RC._step_feature_columns(DEFAULT, False)).first()
    fresh = state.select(*RC._step_feature_columns(DEFAULT, True)).first()
    last = feats.orderBy(F.col("date").desc()).first()
    assert frozen.flu_season_index == pytest.approx(last.flu_season_index)
    assert fresh.flu_season_index == pytest.approx(0.0, abs=1e-9)     # July
    assert frozen.rolling_mean_7 == fresh.rolling_mean_7 == pytest.approx(last.rolling_mean_7)
    assert frozen.month == 7.0                                         # calendar always moves


def test_t13_best_flag_is_null_safe(spark):
    cv = spark.createDataFrame([("A", "Naive", None), ("A", "Moving Average", None),
                                ("B", "Naive", 0.5), ("B", "Moving Average", 0.5)],
                               "drug_code string, model_name string, mape double")
    got = {(r.drug_code, r.model_name): r.is_best for r in E.best_model_per_series(cv).collect()}
    assert got[("A", "Naive")] is False and got[("A", "Moving Average")] is False
    assert got[("B", "Naive")] and got[("B", "Moving Average")]        # ties all flagged


def test_t14_improvement_null_when_best_baseline_is_zero(spark):
    summary = spark.createDataFrame([("Naive", 0.0), ("Boosted Trees", 0.2)], "model_name string, avg_mape double")
    assert E.ml_improvement(summary).first().improvement_pct is None
    summary = spark.createDataFrame([("Naive", 0.5), ("Seasonal Naive", 0.4), ("Boosted Trees", 0.3)],
                                    "model_name string, avg_mape double")
    assert E.ml_improvement(summary).first().improvement_pct == pytest.approx(25.0)


def test_t16_crossing_interval_is_reported_not_fatal(spark):
    fc = spark.createDataFrame([(2.0, 1.0, 3.0), (5.0, 1.0, 4.0), (2.0, None, None)],
                               "predicted_demand double, lower_ci double, upper_ci double")
    assert fc.filter(~S.interval_ok()).count() == 1
    dq = spark.createDataFrame([("forecasts_daily lower <= predicted <= upper (info)", 1)],
                               "rule string, violations long")
    S.assert_constraints(dq)                                           # info only: no error
    with pytest.raises(ValueError, match="unique"):
        S.assert_constraints(spark.createDataFrame([("drugs.drug_code unique", 2)],
                                                   "rule string, violations long"))


def test_t22_desc_order_puts_nulls_last(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0)], "c string, v double")
    assert df.orderBy(F.col("v").desc_nulls_last()).first().c == "b"


def test_json_records(spark, tmp_path):
    df = spark.createDataFrame([(1, dt.date(2020, 1, 1), 1.5)], "drug_id long, forecast_date date, v double")
    S.write_json(df, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out")).first()
    assert back.drug_id == 1 and back.forecast_date == "2020-01-01"


def test_t03_duplicate_days_seed_one_value_per_day(multi_sales):
    """Same-day duplicates are kept in the features; the recursion store keeps
    one value per calendar day (the later row in (date, quantity) order)."""
    dups = multi_sales.filter("drug_code = 'DUPS'")
    feats = FE.engineer_features(dups)
    assert feats.count() == dups.count()
    tail = feats.orderBy(F.col("date").desc(), F.col("quantity_sold").desc()).limit(30).collect()
    state = RC.initial_state(feats).first()
    assert len(state.store) == len({r.date for r in tail}) < 30
    by_day = {}
    for r in sorted(tail, key=lambda r: (r.date, r.quantity_sold)):
        by_day[r.date] = float(r.quantity_sold)           # later row wins
    assert dict(state.store) == by_day
