"""Model comparison: per-series table, overall summary, gain over baselines, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import BOOSTED, MODEL_ORDER, MOVING_AVERAGE, NAIVE, SEASONAL_NAIVE

BASELINES = (NAIVE, MOVING_AVERAGE, SEASONAL_NAIVE)
TIE = 1e-9


def _model_rank():
    expr = F.lit(len(MODEL_ORDER) + 1)
    for i, name in reversed(list(enumerate(MODEL_ORDER, 1))):
        expr = F.when(F.col("model_name") == name, F.lit(i)).otherwise(expr)
    return expr


def best_model_per_series(cv: DataFrame, series: str = "drug_code") -> DataFrame:
    """Flag the model(s) with the lowest MAPE of each series (ties all flagged).

    A series whose MAPEs are all NULL gets no flag (instead of failing).
    """
    best = F.min("mape").over(Window.partitionBy(series))
    return (cv.withColumn("__best", best)
            .withColumn("is_best", F.coalesce(F.abs(F.col("mape") - F.col("__best")) < TIE,
                                              F.lit(False)))
            .drop("__best"))


def model_comparison(cv: DataFrame, series: str = "drug_code") -> DataFrame:
    """Per-series table in the fixed model order with the best-model flag."""
    return best_model_per_series(cv, series).withColumn("model_rank", _model_rank())


def model_summary(cv: DataFrame, series: str = "drug_code") -> DataFrame:
    """Mean over series per model (NULLs skipped) and the overall best flag.

    The grouped frame has one row per model, so the un-partitioned window
    that finds the minimum runs over a handful of rows.
    """
    per_model = cv.groupBy("model_name").agg(
        F.avg("mae").alias("avg_mae"), F.avg("rmse").alias("avg_rmse"),
        F.avg("mape").alias("avg_mape"), F.countDistinct(series).alias("n_series"))
    best = F.min("avg_mape").over(Window.partitionBy(F.lit(0)))
    return (per_model.withColumn("__best", best)
            .withColumn("is_best", F.coalesce(F.abs(F.col("avg_mape") - F.col("__best")) < TIE,
                                              F.lit(False)))
            .drop("__best").withColumn("model_rank", _model_rank()))


def ml_improvement(summary: DataFrame, model: str = BOOSTED) -> DataFrame:
    """Relative MAPE gain (%) of ``model`` over the best baseline; NULL if undefined."""
    agg = summary.agg(
        F.min(F.when(F.col("model_name").isin(*BASELINES), F.col("avg_mape"))).alias("best_baseline_mape"),
        F.max(F.when(F.col("model_name") == model, F.col("avg_mape"))).alias("model_mape"))
    return agg.select(
        F.lit(model).alias("model_name"), "best_baseline_mape", "model_mape",
        (F.try_divide(F.col("best_baseline_mape") - F.col("model_mape"),
                      F.col("best_baseline_mape")) * 100).alias("improvement_pct"))


def series_profile(sales: DataFrame, warn_above: float = 0.10) -> DataFrame:
    """Share of zero days and coefficient of variation (sample std / mean)."""
    q = F.col("quantity_sold")
    return (sales.groupBy("drug_code")
            .agg(F.count(F.lit(1)).alias("n_rows"),
                 F.avg((q == 0).cast("double")).alias("zero_fraction"),
                 F.try_divide(F.stddev_samp(q), F.avg(q)).alias("cv"))
            .withColumn("zero_inflated", F.col("zero_fraction") > warn_above))


def zero_inflated_series(sales: DataFrame, warn_above: float = 0.10) -> DataFrame:
    return series_profile(sales, warn_above).filter("zero_inflated")
