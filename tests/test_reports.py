import datetime as dt

import pytest
from pyspark.sql import functions as F

from demand_engine.plans import reports as R
from demand_engine.plans.fixture import demo_store


@pytest.fixture(scope="module")
def demo(spark):
    return demo_store(spark, "/root/testdata/sf0.001")


def test_risk_label_thresholds(spark):
    df = spark.createDataFrame([(None,), (500.0,), (500.01,), (1000.0,), (1000.5,)], "a double")
    assert [r[0] for r in df.select(R.risk_label(F.col("a"))).collect()] == \
        ["low", "low", "medium", "medium", "high"]


def test_display_defaults(spark):
    df = spark.createDataFrame([(None,), ("",), ("R03",)], "c string")
    assert [r[0] for r in df.select(R.display_text(F.col("c"), "N/A")).collect()] == ["N/A", "N/A", "R03"]


def test_risk_ranking_uses_newest_run(demo):
    rows = R.risk_ranking(demo.items, demo.forecasts).collect()
    assert len(rows) == 6 and all(r.latest_run == dt.datetime(2024, 2, 1, 6) for r in rows)
    avgs = [r.avg_forecast for r in rows]
    assert avgs == sorted(avgs, reverse=True)


def test_item_overview_counts_do_not_fan_out(demo):
    rows = R.item_overview(demo.items, demo.sales, demo.forecasts).collect()
    assert sum(r.sales_count for r in rows) == demo.sales.count()
    assert sum(r.forecast_count for r in rows) == demo.forecasts.count()


def test_item_forecasts_one_per_date(demo):
    f = R.item_forecasts(demo.forecasts)
    assert f.count() == f.select("drug_id", "forecast_date").distinct().count() == 6 * 30


def test_forecast_range_requires_id(demo):
    with pytest.raises(ValueError, match="drugId"):
        R.forecast_range(demo.items, demo.forecasts, None)


def test_chart_series_drops_zero_bounds(spark):
    fc = spark.createDataFrame(
        [(1, 1, dt.date(2020, 1, 1), dt.datetime(2024, 1, 1), 5.0, 0.0, 9.0)],
        "id long, drug_id long, forecast_date date, run_timestamp timestamp_ntz, "
        "predicted_demand double, lower_ci double, upper_ci double")
    sales = spark.createDataFrame([(1, dt.date(2019, 12, 31), 4)], "drug_id long, date date, quantity_sold int")
    rows = {r.date: r for r in R.chart_series(sales, fc, dt.date(2020, 6, 1)).collect()}
    assert rows["2020-01-01"].lower_ci is None and rows["2020-01-01"].upper_ci == 9.0
    assert rows["2019-12-31"].actual == 4 and rows["2019-12-31"].predicted is None


def test_recent_sales_newest_first(demo):
    rows = R.recent_sales(demo.sales).filter("drug_id = 1").collect()
    assert len(rows) == 10 and [r.rank for r in rows] == list(range(1, 11))
    assert all(rows[i].date > rows[i + 1].date for i in range(9))


def test_no_frame_outlives_its_query(spark):
    assert demo_store(spark, "/root/testdata/sf0.001") is not demo_store(spark, "/root/testdata/sf0.001")
    kept = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    before = kept()
    d = demo_store(spark, "/root/testdata/sf0.001")
    R.risk_ranking(d.items, d.forecasts).collect()
    assert kept() == before


def test_quartiles_interpolate_and_plan_is_distributed(spark):
    values = {"a": [5, 1, 1, 9, 2], "b": [7], "c": [4, None, 2], "d": [3] * 50 + [8] * 49}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs],
                               "drug_code string, quantity_sold int")
    import numpy as np
    for r in R.describe_sales(df).collect():
        known = [v for v in values[r.drug_code] if v is not None]
        assert (r["count"], r.p25, r.p50, r.p75) == (len(known), *np.percentile(known, [25, 50, 75]))
    everything = [v for vs in values.values() for v in vs if v is not None]
    total = R.describe_sales(df, by=None).first()
    assert total.p50 == np.percentile(everything, 50) and total.mean == pytest.approx(np.mean(everything))


def test_ranking_from_sql_text_is_the_same(demo):
    assert R.risk_ranking_sql(demo.items, demo.forecasts).collect() == \
        R.risk_ranking(demo.items, demo.forecasts).select(
            "id", "drug_code", "drug_name", "avg_forecast", "latest_run", "risk_level",
            "risk_label").collect()


def test_forecast_range_bounds_are_inclusive(spark):
    d0 = dt.date(2024, 3, 1)
    rows = [(i + 1, 1, d0 + dt.timedelta(days=i), "2024-02-28 00:00:00", 10.0 + i) for i in range(10)]
    rows += [(100, 1, d0, "2024-01-01 00:00:00", 99.0)]                      # an older run
    fc = spark.createDataFrame(rows, "id long, drug_id long, forecast_date date, ts string, "
                                     "predicted_demand double").select(
        "id", "drug_id", "forecast_date", F.col("ts").cast("timestamp_ntz").alias("run_timestamp"),
        "predicted_demand")
    items = spark.createDataFrame([(1, "A", "A")], "id long, drug_code string, drug_name string")
    out = R.forecast_range(items, fc, 1, d0 + dt.timedelta(days=2), d0 + dt.timedelta(days=5)).collect()
    assert [r.forecast_date for r in out] == [d0 + dt.timedelta(days=i) for i in range(2, 6)]
    assert all(r.run_timestamp == dt.datetime(2024, 2, 28) for r in out)
    assert len(R.forecast_range(items, fc, 1).collect()) == 10               # no bounds: newest run


def test_sales_lookback_is_inclusive_ten_years(spark):
    sales = spark.createDataFrame([(1, dt.date(2010, 6, 29), 1), (1, dt.date(2010, 6, 30), 2)],
                                  "drug_id long, date date, quantity_sold int")
    kept = [r.quantity_sold for r in R.sales_since(sales, dt.date(2020, 6, 30)).collect()]
    assert kept == [2]
