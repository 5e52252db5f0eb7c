"""Forecast error metrics as aggregate expressions.

MAPE is a fraction (0.66 = 66 %), computed over rows with a positive actual
only; with no such row it is NULL (never NaN), so ``avg`` over folds or series
skips it the way ``nanmean`` does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mae(actual: Column, pred: Column) -> Column:
    return F.avg(F.abs(actual - pred))


def rmse(actual: Column, pred: Column) -> Column:
    return F.sqrt(F.avg((actual - pred) * (actual - pred)))


def mape(actual: Column, pred: Column) -> Column:
    return F.avg(F.when(actual > 0, F.abs(actual - pred) / actual))


def error_metrics(actual: str = "actual", pred: str = "predicted") -> list[Column]:
    a, p = F.col(actual).cast("double"), F.col(pred).cast("double")
    return [mae(a, p).alias("mae"), rmse(a, p).alias("rmse"), mape(a, p).alias("mape")]
