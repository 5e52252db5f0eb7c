import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from demand_engine.operators import baselines as B


@pytest.fixture(scope="module")
def train(sample_sales):
    return sample_sales.filter(F.col("date") < F.lit(dt.date(2020, 2, 2)))  # first 90 rows


def test_naive_all_equal_last_value(train, sample_pdf):
    out = B.naive_forecast(train, horizon=10).collect()
    last = int(sample_pdf["quantity_sold"].iloc[89])
    assert len(out) == 10 and all(r.predicted_demand == last for r in out)
    assert all(r.lower_ci <= r.predicted_demand <= r.upper_ci for r in out)


def test_naive_starts_day_after(train):
    out = B.naive_forecast(train, horizon=5).agg(F.min("date")).first()[0]
    assert out == dt.date(2020, 2, 2)


def test_moving_average_matches_window_mean(train, sample_pdf):
    out = B.moving_average_forecast(train, window=7, horizon=5).collect()
    expected = sample_pdf["quantity_sold"].iloc[83:90].mean()
    assert len(out) == 5 and out[0].predicted_demand == pytest.approx(expected)
    assert all(r.lower_ci >= 0 for r in out)


def test_seasonal_rows_and_lower_bound(train):
    out = B.seasonal_naive_forecast(train, season_length=7, horizon=30).collect()
    assert len(out) == 30 and all(r.lower_ci >= 0 for r in out)


def test_seasonal_reads_one_weekday_off(train, sample_pdf):
    """Trap T-04: step 0 (last+1) reads last-7; aligned=True reads last-6."""
    out = B.seasonal_naive_forecast(train, horizon=7).orderBy("date").collect()
    aligned = B.seasonal_naive_forecast(train, horizon=7, aligned=True).orderBy("date").collect()
    q = sample_pdf["quantity_sold"].tolist()
    assert out[0].predicted_demand == q[89 - 7]
    assert aligned[0].predicted_demand == q[89 - 6]


def test_seasonal_fallback_when_lookback_missing(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 1 + i), "X", v) for i, v in enumerate([100, 120, 110])],
                               "date date, drug_code string, quantity_sold int")
    out = B.seasonal_naive_forecast(df, horizon=5).collect()
    assert len(out) == 5 and all(r.predicted_demand is not None for r in out)
    assert any(r.predicted_demand == pytest.approx(110.0) for r in out)


def test_one_row_series_intervals(multi_sales):
    """Trap T-12: one row -> MA lower 0 / upper NULL; seasonal interval NULL."""
    out = {r.model_name: r for r in B.baseline_forecasts(multi_sales.filter("drug_code = 'ONE'"))
           .filter(F.col("date") == F.date_add(F.lit(dt.date(2021, 1, 1)), 1)).collect()}
    assert out["Moving Average"].lower_ci == 0.0 and out["Moving Average"].upper_ci is None
    assert out["Seasonal Naive"].lower_ci is None and out["Seasonal Naive"].upper_ci is None


def test_cv_returns_three_models_with_valid_metrics(sample_sales):
    rows = B.evaluate_baselines_cv(sample_sales, n_folds=2, test_days=15).collect()
    assert {r.model_name for r in rows} == {"Naive", "Moving Average", "Seasonal Naive"}
    for r in rows:
        assert r.mae >= 0 and r.rmse >= 0 and r.rmse >= r.mae - 1e-9


def test_cv_too_short_is_empty(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 1) + dt.timedelta(days=i), "X", 100) for i in range(20)],
                               "date date, drug_code string, quantity_sold int")
    assert B.evaluate_baselines_cv(df, n_folds=3, test_days=15).count() == 0


# --- brute force: the documented semantics, one series at a time, in pandas ----

def _brute_cv(pdf: pd.DataFrame, n_folds=3, test_days=30, min_train=30, L=7, W=7):
    out = []
    for code, g in pdf.groupby("drug_code"):
        g = g.sort_values(["date", "quantity_sold"]).reset_index(drop=True)
        n = len(g)
        for k in range(n_folds, 0, -1):
            start = n - k * test_days
            if start < min_train:
                continue
            tr, te = g.iloc[:start], g.iloc[start:start + test_days]
            last_date = tr["date"].iloc[-1]
            by_date = {}
            for d_, q_ in zip(tr["date"], tr["quantity_sold"]):
                by_date.setdefault(d_, q_)          # first row of a day in (date, qty) order
            preds = {"Naive": [float(tr["quantity_sold"].iloc[-1])] * len(te),
                     "Moving Average": [tr["quantity_sold"].iloc[-W:].mean()] * len(te),
                     "Seasonal Naive": [float(by_date.get(last_date - dt.timedelta(days=L - i % L),
                                                          tr["quantity_sold"].mean()))
                                        for i in range(len(te))]}
            y = te["quantity_sold"].to_numpy(dtype=float)
            for m, p in preds.items():
                e = y - np.array(p)
                mape = float(np.mean(np.abs(e[y > 0]) / y[y > 0])) if (y > 0).any() else None
                out.append((code, m, n_folds - k + 1, float(np.mean(np.abs(e))),
                            float(np.sqrt(np.mean(e * e))), mape))
    return out


def test_fold_metrics_match_brute_force(multi_sales):
    pdf = multi_sales.toPandas()
    expected = {r[:3]: r[3:] for r in _brute_cv(pdf)}
    got = {(r.drug_code, r.model_name, r.fold): (r.mae, r.rmse, r.mape)
           for r in B.fold_metrics(B.fold_predictions(multi_sales)).collect()}
    assert set(got) == set(expected) and len(got) > 0
    for k, (mae, rmse, mape) in expected.items():
        g = got[k]
        assert g[0] == pytest.approx(mae) and g[1] == pytest.approx(rmse)
        assert (g[2] is None and mape is None) or g[2] == pytest.approx(mape)


def test_zero_series_mape_is_null_not_nan(multi_sales):
    """Trap T-11: an all-zero fold has no MAPE (NULL), and the mean skips it."""
    rows = B.evaluate_baselines_cv(multi_sales.filter("drug_code = 'ZERO'")).collect()
    assert rows and all(r.mape is None for r in rows)
    assert not any(isinstance(r.mae, float) and math.isnan(r.mae) for r in rows)


def test_short_series_gets_baseline_folds_only_above_30_rows(multi_sales):
    """Trap T-07: 45 rows -> no fold of 30 test days with 30 training rows."""
    rows = B.evaluate_baselines_cv(multi_sales.filter("drug_code = 'SHORT'"), 3, 15).collect()
    assert {r.n_folds for r in rows} == {1}


def test_cv_plan_has_one_shuffle_after_input(multi_sales):
    plan = B.evaluate_baselines_cv(multi_sales)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1


def test_registered_forecaster_joins_cv_and_forecasts(sample_sales):
    """Extension point: a user model is a column expression over the cutoff stats."""
    def history_mean(stats, pos, cfg):
        m = stats["hist_mean"]
        return m, m - stats["hist_std"], m + stats["hist_std"]

    B.register_forecaster("History Mean", history_mean)
    try:
        cv = {r.model_name for r in B.evaluate_baselines_cv(sample_sales, 2, 15).collect()}
        assert "History Mean" in cv and len(cv) == 4
        fc = B.baseline_forecasts(sample_sales, 5).filter("model_name = 'History Mean'").collect()
        assert len(fc) == 5 and fc[0].lower_ci < fc[0].predicted_demand < fc[0].upper_ci
    finally:
        B.unregister_forecaster("History Mean")
    assert "History Mean" not in B.registered_models()
