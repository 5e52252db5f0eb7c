import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from demand_engine.config import DEFAULT
from demand_engine.functions import calendar as cal
from demand_engine.operators import features as FE


def _row(df, d):
    return df.filter(F.col("date") == F.lit(d)).first()


def test_time_feature_values(sample_sales):
    out = sample_sales.select("date", *cal.time_feature_columns(F.col("date")))
    wed = _row(out, dt.date(2020, 1, 1))
    assert (wed.day_of_week, wed.day_of_month, wed.month, wed.quarter) == (2, 1, 1, 1)
    assert wed.is_month_start == 1 and wed.is_weekend == 0 and wed.week_of_year == 1
    assert _row(out, dt.date(2020, 1, 4)).is_weekend == 1
    assert _row(out, dt.date(2020, 1, 31)).is_month_end == 1
    assert _row(out, dt.date(2020, 2, 29)).is_month_end == 1


def test_iso_week_at_year_boundary(spark):
    df = spark.createDataFrame([(dt.date(2021, 1, 3),), (dt.date(2020, 12, 31),)], "date date")
    weeks = [r.week_of_year for r in df.select(*cal.time_feature_columns(F.col("date"))).collect()]
    assert weeks == [53, 53]


def test_lag_columns(sample_sales, sample_pdf):
    out = (FE.with_order_key(sample_sales).select("date", "quantity_sold", *FE.lag_columns([1, 7]))
           .orderBy("date").toPandas())
    assert out.loc[5, "lag_1"] == out.loc[4, "quantity_sold"]
    assert pd.isna(out.loc[0, "lag_1"]) and pd.isna(out.loc[6, "lag_7"])
    assert out.loc[7, "lag_7"] == out.loc[0, "quantity_sold"]


def _pandas_rolling(q: pd.Series, n: int):
    s = q.shift(1).rolling(n, min_periods=1)
    return s.mean(), s.std(), s.min(), s.max()


def test_rolling_matches_shifted_pandas_rolling(sample_sales, sample_pdf):
    out = (FE.with_order_key(sample_sales).select("date", "quantity_sold", *FE.rolling_columns([7, 14, 30]))
           .orderBy("date").toPandas())
    q = sample_pdf["quantity_sold"].astype(float)
    for n in (7, 14, 30):
        mean, std, mn, mx = _pandas_rolling(q, n)
        for name, ref in (("mean", mean), ("std", std), ("min", mn), ("max", mx)):
            got = out[f"rolling_{name}_{n}"].astype(float)
            assert np.allclose(got.fillna(-1), ref.fillna(-1), atol=1e-9), (name, n)


def test_engineer_features_shape_and_no_nulls(sample_sales):
    out = FE.engineer_features(sample_sales)
    assert out.count() == 182
    names = FE.feature_names(DEFAULT)
    assert len(names) == 27 and out.columns == ["date", "drug_code", "quantity_sold", *names]
    nulls = out.select(*[F.sum(F.col(c).isNull().cast("int")).alias(c) for c in names]).first()
    assert sum(nulls) == 0


def test_quantity_unchanged(sample_sales, sample_pdf):
    out = FE.engineer_features(sample_sales).orderBy("date").toPandas()
    assert (out["quantity_sold"].values == sample_pdf["quantity_sold"].values).all()


def test_warmup_zero_fill_is_kept(sample_sales):
    """Trap T-01: warm-up lags are 0, not dropped."""
    first = FE.engineer_features(sample_sales).orderBy("date").first()
    assert first.lag_30 == 0 and first.rolling_std_7 == 0.0


def test_lags_are_by_row_not_by_day(multi_sales):
    """Trap T-05: training lags follow rows, so a gap shifts them."""
    out = (FE.with_order_key(multi_sales.filter("drug_code = 'GAPS'")).select("date", "quantity_sold",
                                                            *FE.lag_columns([1])).orderBy("date").collect())
    gap = next(i for i in range(1, len(out)) if (out[i].date - out[i - 1].date).days > 1)
    assert out[gap].lag_1 == out[gap - 1].quantity_sold


def test_one_window_one_shuffle(sample_sales):
    plan = FE.engineer_features(sample_sales)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1


def test_feature_columns_exclude_ids(sample_sales):
    cols = FE.feature_columns(FE.engineer_features(sample_sales))
    assert not {"date", "drug_code", "quantity_sold"} & set(cols)
    assert any(c.startswith("lag_") for c in cols) and any(c.startswith("rolling_") for c in cols)
