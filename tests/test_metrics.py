import math

import pytest
from pyspark.sql import functions as F

from demand_engine.functions.metrics import error_metrics
from demand_engine.operators import folds as FO
from demand_engine.operators.features import engineer_features


def _m(spark, yt, yp):
    df = spark.createDataFrame(list(zip(map(float, yt), map(float, yp))), "actual double, predicted double")
    return df.agg(*error_metrics()).first()


def test_perfect_predictions(spark):
    r = _m(spark, [10, 20, 30], [10, 20, 30])
    assert (r.mae, r.rmse, r.mape) == (0, 0, 0)


def test_mae_known_value(spark):
    assert _m(spark, [100, 200, 300], [110, 190, 310]).mae == pytest.approx(10)


def test_rmse_known_value(spark):
    assert _m(spark, [0, 0, 0], [3, 4, 0]).rmse == pytest.approx(math.sqrt(25 / 3))


def test_mape_excludes_zero_actuals(spark):
    r = _m(spark, [0, 100, 200], [10, 110, 210])
    assert r.mape == pytest.approx((0.1 + 0.05) / 2)


def test_mape_null_when_all_actuals_zero(spark):
    assert _m(spark, [0, 0, 0], [1, 2, 3]).mape is None


def test_split_sizes(sample_sales):
    split = FO.train_test_split(engineer_features(sample_sales), 30)
    test = split.filter(~F.col("is_train"))
    train = split.filter("is_train")
    assert test.count() == 30 and train.count() == 152
    assert train.agg(F.max("date")).first()[0] < test.agg(F.min("date")).first()[0]


def test_split_is_by_calendar_not_rows(multi_sales):
    split = FO.train_test_split(multi_sales.filter("drug_code = 'GAPS'"), 30)
    assert split.filter(~F.col("is_train")).count() < 30


def test_min_history_counts_rows(multi_sales):
    kept = {r[0] for r in FO.min_history(multi_sales, 90).select("drug_code").distinct().collect()}
    assert kept == {"GAPS", "FULL", "ZERO", "DUPS"}


def test_walk_forward_fold_positions(sample_sales):
    f = FO.walk_forward_folds(sample_sales, 3, 30, 30).collect()
    # 182 rows: test windows start at 92, 122, 152 -> all three valid (training >= 30)
    assert sorted({r.fold for r in f}) == [1, 2, 3] and len(f) == 90
    assert all(0 <= r.pos < 30 for r in f)
    f90 = FO.walk_forward_folds(sample_sales, 3, 30, 123).collect()
    assert {r.fold for r in f90} == {3} and len(f90) == 30
