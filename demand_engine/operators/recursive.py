"""Recursive multi-day forecast for all series at once.

Step ``i`` needs the prediction of step ``i-1`` (lag_1), so the horizon is
sequential; the series are not. The state is one row per series: the last
known feature row (rolling, external and scale features stay frozen, as in the
original), and an array of daily values: the last ``max(lags)`` calendar days up to
the last date (0 for a day missing among the last ``max(lags)`` rows), then one
value per step. A lag is a place in that array, fixed by the step, so no day is
searched for. Each step is a narrow projection of that frame (calendar features of
the next date, lags, scoring, one value appended): no shuffle. Scoring is any
function that adds a ``prediction`` column, the fitted ensemble's
``transform`` in production. The lineage is cut with a reliable checkpoint every
``checkpoint_every`` steps. Intervals never feed the store, so they are scored
once, after the loop, on the exploded steps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, ForecastConfig
from ..functions import calendar as cal
from ..session import ensure_checkpoint_dir
from .boosted import BoostedModels, bounded_prediction, model_columns, predict, predict_point, with_scale
from .folds import with_position

TIME_FEATURES = ("day_of_week", "day_of_month", "month", "quarter", "week_of_year",
                 "is_weekend", "is_month_start", "is_month_end")


def initial_state(features: DataFrame, cfg: ForecastConfig = DEFAULT) -> DataFrame:
    """One row per series from its last ``max(lags)`` feature rows: ``store``, the
    value of each known day, and ``values``, those of the last calendar days in order.

    Windows and the grouping are all clustered by series: one shuffle, and
    each group holds at most ``max(lags)`` rows.
    """
    k = max(cfg.lags)
    cols = model_columns(cfg)
    tail = with_position(with_scale(features)).filter(F.col("idx") >= F.col("n") - k)
    # one value per calendar day (the later of same-day duplicates wins, like a dict)
    per_day = (tail.withColumn("__dup", F.row_number().over(
        Window.partitionBy("drug_code", "date").orderBy(F.col("idx").desc())))
        .filter("__dup = 1"))
    known = per_day.groupBy("drug_code").agg(
        F.max("date").alias("last_date"),
        F.max_by(F.struct(*[F.col(c) for c in cols]), F.col("idx")).alias("last"),
        F.map_from_entries(F.collect_list(F.struct(
            F.col("date"), F.col("quantity_sold").cast("double")))).alias("store"))
    days = F.sequence(F.date_sub("last_date", k - 1), F.col("last_date"))
    return known.withColumn("values", F.transform(
        days, lambda d: F.coalesce(F.try_element_at("store", d), F.lit(0.0))))


def _step_feature_columns(cfg: ForecastConfig, refresh_external: bool,
                          step: Column | None = None) -> list:
    """Feature columns of forecast day ``date`` (a column of the frame), the
    ``step``-th (by default the first) after the last one: lag ``k`` is the value
    ``k`` days before it."""
    step = F.lit(1) if step is None else step
    nd = F.col("date")
    time_cols = dict(zip(TIME_FEATURES, cal.time_feature_columns(nd)))
    flu, allergy = cal.seasonal_columns(nd)
    external = ({"is_holiday": cal.is_holiday(nd, cfg.holiday_country),
                 "flu_season_index": flu, "allergy_season_index": allergy}
                if refresh_external else {})
    cols = []
    for c in model_columns(cfg):
        if c in time_cols:
            cols.append(time_cols[c].cast("double").alias(c))
        elif c.startswith("lag_"):
            lag = int(c.split("_")[1])
            cols.append(F.get("values", step + (max(cfg.lags) - 1 - lag)).alias(c))
        elif c in external:
            cols.append(external[c].cast("double").alias(c))
        else:
            cols.append(F.col("last")[c].cast("double").alias(c))
    return cols


def recurse(predictor: Callable[[DataFrame], DataFrame], features: DataFrame,
            horizon: int | None = None, cfg: ForecastConfig = DEFAULT,
            refresh_external: bool = False) -> DataFrame:
    """``horizon`` days after each series' last date: ``drug_code, date``, the
    prediction of each day (``__point``, not below 0) and its feature columns.

    ``predictor`` adds a ``prediction`` column to a frame of feature columns.
    The state carries only the daily values (one added per step), so a
    checkpoint writes one array of ``max(lags)`` + step numbers per series. Once the
    loop is done they are final, so the feature row of every step can be rebuilt
    from them (lags only look back) without carrying it along.
    """
    h = horizon or cfg.horizon
    ensure_checkpoint_dir(features.sparkSession)
    keep = ["drug_code", "last_date", "last", "values"]
    state = initial_state(features, cfg)
    for i in range(1, h + 1):
        x = state.select(*keep, F.date_add("last_date", i).alias("date"))
        x = predictor(x.select(*keep, "date", *_step_feature_columns(cfg, refresh_external, F.lit(i))))
        state = x.select("drug_code", "last_date", "last", F.concat("values", F.array(
            F.greatest(F.lit(0.0), "prediction"))).alias("values"))
        if i % cfg.checkpoint_every == 0 or i == h:
            state = state.checkpoint(eager=True)
    step = F.col("__step")
    return (state.select(*keep, F.explode(F.sequence(F.lit(1), F.lit(h))).alias("__step"))
            .select(*keep, step, F.date_add("last_date", step).alias("date"))
            .select("drug_code", "date",
                    F.get("values", step + (max(cfg.lags) - 1)).alias("__point"),
                    *_step_feature_columns(cfg, refresh_external, step)))


def forecast_future(models: BoostedModels, features: DataFrame, horizon: int | None = None,
                    cfg: ForecastConfig = DEFAULT, refresh_external: bool = False) -> DataFrame:
    """``(drug_code, date, predicted_demand, lower_ci, upper_ci)`` for ``horizon`` days.

    ``refresh_external=True`` recomputes holiday and seasonal features for
    each forecast day; by default they stay frozen at the last known row,
    as the rolling features do (and as the original does).
    """
    rows = recurse(lambda df: predict_point(models, df), features, horizon, cfg, refresh_external)
    if models.has_interval:
        rows = predict(models, rows)
        return rows.select("drug_code", "date", *bounded_prediction(
            F.col("__point"), F.col("lower_ci"), F.col("upper_ci")))
    return rows.select("drug_code", "date", *bounded_prediction(F.col("__point")))
