"""Naive, moving-average and seasonal-naive forecasters and their walk-forward CV.

Design: every row of a series gets, by window functions, the statistics a
baseline would compute if that row were the last training row (last value,
mean/std of the last ``ma_window`` rows, mean/std of the whole history so far,
and the values of the previous ``season_length`` days). A production forecast
reads them at the last row; a CV fold reads them at the row before its test
window and carries them to the test rows with ``last(..., ignorenulls)``.
So all series, all folds and all three models cost one shuffle by series
(the group-bys afterwards are clustered by series already) and no join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import (DEFAULT, MOVING_AVERAGE, NAIVE, SEASONAL_NAIVE, ForecastConfig)
from ..functions.metrics import error_metrics
from .features import DAY, ORDER_COL, series_window, with_order_key
from .folds import fold_of, is_cutoff, with_position

Z_95 = 1.96


def _sales_columns(df: DataFrame) -> DataFrame:
    """The three sales columns (and the order key when the frame has one)."""
    keep = ["date", "drug_code", "quantity_sold"] + ([ORDER_COL] if ORDER_COL in df.columns else [])
    return df.select(*keep)


def with_cutoff_stats(df: DataFrame, cfg: ForecastConfig = DEFAULT,
                      series: str = "drug_code") -> DataFrame:
    """Add struct ``stats``: what each baseline needs if training ended here."""
    w = series_window(series)
    # every row of the previous season_length days, and the current day (the
    # frame may also reach into one older day, which no lookup asks for)
    recent = w.rangeBetween(-(cfg.season_length + 1) * DAY, 0)
    q = F.col("quantity_sold")
    s = df.select(
        "*",
        F.avg(q).over(w.rowsBetween(-(cfg.ma_window - 1), 0)).alias("__ma_mean"),
        F.stddev_samp(q).over(w.rowsBetween(-(cfg.ma_window - 1), 0)).alias("__ma_std"),
        F.avg(q).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("__hist_mean"),
        F.stddev_samp(q).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("__hist_std"),
        F.collect_list(F.struct(F.col("date").alias("d"), q.alias("q"))).over(recent).alias("__recent"),
    )
    stats = F.struct(
        F.col("date").alias("cutoff_date"),
        q.cast("double").alias("last_value"),
        F.col("__ma_mean").alias("ma_mean"), F.col("__ma_std").alias("ma_std"),
        F.col("__hist_mean").alias("hist_mean"), F.col("__hist_std").alias("hist_std"),
        F.col("__recent").alias("recent"))
    return s.withColumn("stats", stats).drop("__ma_mean", "__ma_std", "__hist_mean",
                                             "__hist_std", "__recent")


def _seasonal_lookback(stats: Column, pos: Column, cfg: ForecastConfig, aligned: bool) -> Column:
    """Value ``season_length - pos % season_length`` days before the cutoff.

    The original reads the day ``L - i % L`` days back, one weekday off from
    the same weekday (which is ``L - 1 - i % L`` back); ``aligned=True`` gives
    the latter. Missing day -> NULL (caller falls back to the history mean).
    """
    L = cfg.season_length
    back = ((F.lit(L - 1) if aligned else F.lit(L)) - (pos % L)).cast("int")
    target = F.date_sub(stats["cutoff_date"], back)
    hit = F.filter(stats["recent"], lambda x: x["d"] == target)
    return F.get(hit, 0)["q"].cast("double")


Forecaster = Callable[[Column, Column, ForecastConfig], tuple[Column, Column, Column]]
_EXTRA_FORECASTERS: dict[str, Forecaster] = {}
BUILT_IN = (NAIVE, MOVING_AVERAGE, SEASONAL_NAIVE)


def register_forecaster(name: str, fn: Forecaster) -> None:
    """Add a forecaster to CV and forecasts (the model extension point).

    ``fn(stats, pos, cfg)`` returns (point, lower, upper) column expressions
    for forecast step ``pos`` (0-based) from the cutoff struct ``stats``:
    ``cutoff_date, last_value, ma_mean, ma_std, hist_mean, hist_std`` and
    ``recent`` (array of ``(d, q)`` for the last ``season_length`` days).
    Expressions stay inside the same window plan: no extra shuffle, no UDF.
    """
    if name in BUILT_IN:
        raise ValueError(f"{name!r} is a built-in model")
    _EXTRA_FORECASTERS[name] = fn


def unregister_forecaster(name: str) -> None:
    _EXTRA_FORECASTERS.pop(name, None)


def registered_models() -> tuple[str, ...]:
    return BUILT_IN + tuple(_EXTRA_FORECASTERS)


def model_predictions(stats: Column, pos: Column, cfg: ForecastConfig = DEFAULT,
                      aligned: bool = False) -> dict[str, tuple[Column, Column, Column]]:
    """(point, lower, upper) per model, for forecast step ``pos`` (0-based)."""
    naive = stats["last_value"]
    ma, ma_sd = stats["ma_mean"], stats["ma_std"]
    seas = F.coalesce(_seasonal_lookback(stats, pos, cfg, aligned), stats["hist_mean"])
    sd = stats["hist_std"]
    return {
        NAIVE: (naive, naive * 0.8, naive * 1.2),
        # greatest() skips NULL: a one-row window gives lower 0, upper NULL
        MOVING_AVERAGE: (ma, F.greatest(F.lit(0.0), ma - Z_95 * ma_sd), ma + Z_95 * ma_sd),
        SEASONAL_NAIVE: (seas,
                         F.when(sd.isNotNull(), F.greatest(F.lit(0.0), seas - Z_95 * sd)),
                         seas + Z_95 * sd),
        **{name: fn(stats, pos, cfg) for name, fn in _EXTRA_FORECASTERS.items()},
    }


def _explode_models(preds: dict, models) -> Column:
    return F.explode(F.array(*[
        F.struct(F.lit(m).alias("model_name"), p.alias("predicted_demand"),
                 lo.alias("lower_ci"), hi.alias("upper_ci"))
        for m, (p, lo, hi) in preds.items() if m in models]))


def baseline_forecasts(train: DataFrame, horizon: int | None = None,
                       cfg: ForecastConfig = DEFAULT, models=None,
                       aligned: bool = False) -> DataFrame:
    """Forecast ``horizon`` days after each series' last date, for each model.

    Output ``(drug_code, model_name, date, predicted_demand, lower_ci, upper_ci)``.
    """
    h = horizon or cfg.horizon
    models = models or registered_models()
    last = (with_cutoff_stats(with_position(_sales_columns(train)), cfg)
            .filter(F.col("idx") == F.col("n") - 1)
            .select("drug_code", "stats",
                    F.explode(F.sequence(F.lit(0), F.lit(h - 1))).alias("pos")))
    preds = model_predictions(F.col("stats"), F.col("pos"), cfg, aligned)
    out = last.select("drug_code", "stats", "pos", _explode_models(preds, models).alias("m"))
    return out.select("drug_code", "m.model_name",
                      F.date_add(F.col("stats.cutoff_date"), (F.col("pos") + 1).cast("int")).alias("date"),
                      "m.predicted_demand", "m.lower_ci", "m.upper_ci")


def _single(train, model, horizon, cfg, **kw):
    return baseline_forecasts(train, horizon, cfg, models=(model,), **kw).drop("model_name")


def last_rows(train: DataFrame) -> DataFrame:
    """Last row of each series in (date, quantity) order: an aggregate with a
    partial step, no sort and no window over the history."""
    last = with_order_key(train).groupBy("drug_code").agg(
        F.max_by(F.struct("date", "quantity_sold"), F.col(ORDER_COL)).alias("last"))
    return last.select("drug_code", "last.*")


def forecast_calendar(train: DataFrame, horizon: int = 30) -> DataFrame:
    """``(drug_code, date)``: the ``horizon`` days after each series' last."""
    last = train.groupBy("drug_code").agg(F.max("date").alias("last"))
    days = F.explode(F.sequence(F.date_add("last", 1), F.date_add("last", horizon)))
    return last.select("drug_code", days.alias("date"))


def naive_forecast(train: DataFrame, horizon: int = 30) -> DataFrame:
    """Last observed value; interval x0.8 / x1.2."""
    value = F.col("quantity_sold").cast("double")
    days = F.explode(F.sequence(F.date_add("date", 1), F.date_add("date", horizon)))
    return last_rows(train).select(
        "drug_code", days.alias("date"), value.alias("predicted_demand"),
        (value * 0.8).alias("lower_ci"), (value * 1.2).alias("upper_ci"))


def moving_average_forecast(train: DataFrame, window: int = 7, horizon: int = 30,
                            cfg: ForecastConfig = DEFAULT) -> DataFrame:
    """Mean of the last ``window`` rows; interval +-1.96 sd, lower clamped at 0."""
    return _single(train, MOVING_AVERAGE, horizon, _with(cfg, ma_window=window))


def seasonal_naive_forecast(train: DataFrame, season_length: int = 7, horizon: int = 30,
                            cfg: ForecastConfig = DEFAULT, aligned: bool = False) -> DataFrame:
    """Value one season back (history mean if that day is missing); +-1.96 sd."""
    return _single(train, SEASONAL_NAIVE, horizon, _with(cfg, season_length=season_length),
                   aligned=aligned)


def _with(cfg: ForecastConfig, **changes) -> ForecastConfig:
    from dataclasses import replace
    return replace(cfg, **changes)


def fold_predictions(sales: DataFrame, cfg: ForecastConfig = DEFAULT,
                     n_folds: int | None = None, test_days: int | None = None,
                     min_train: int | None = None, models=None) -> DataFrame:
    """Every test row of every fold with every baseline's prediction.

    Alignment is by position: step ``pos`` of the forecast is compared with
    the ``pos``-th test row, whatever its date (series may have gaps).
    """
    F_, T = n_folds or cfg.cv_folds, test_days or cfg.test_days
    models = models or registered_models()
    mt = cfg.baseline_min_train if min_train is None else min_train
    pos = with_cutoff_stats(with_position(_sales_columns(sales)), cfg)
    idx, n = F.col("idx"), F.col("n")
    k, test_start, in_test = fold_of(idx, n, F_, T, mt)
    cut = F.when(is_cutoff(idx, n, F_, T, mt), F.col("stats"))
    carried = F.last(cut, ignorenulls=True).over(
        series_window().rowsBetween(Window.unboundedPreceding, -1))
    rows = (pos.select("drug_code", "date", "quantity_sold", idx,
                       (F.lit(F_) + 1 - k).alias("fold"), test_start.alias("test_start"),
                       in_test.alias("__in"), carried.alias("cut"))
            .filter("__in")
            .withColumn("pos", (F.col("idx") - F.col("test_start")).cast("int")))
    preds = model_predictions(F.col("cut"), F.col("pos"), cfg)
    return rows.select("drug_code", "fold", "pos", "date",
                       F.col("quantity_sold").alias("actual"),
                       _explode_models(preds, models).alias("m")
                       ).select("drug_code", "fold", "pos", "date", "actual",
                                "m.model_name", F.col("m.predicted_demand").alias("predicted"))


def fold_metrics(preds: DataFrame) -> DataFrame:
    """MAE / RMSE / MAPE per (series, model, fold)."""
    return (preds.groupBy("drug_code", "model_name", "fold")
            .agg(*error_metrics("actual", "predicted"), F.count(F.lit(1)).alias("n_test")))


def cv_summary(metrics: DataFrame) -> DataFrame:
    """Mean over folds per (series, model); NULL MAPE folds are skipped."""
    return (metrics.groupBy("drug_code", "model_name")
            .agg(F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"),
                 F.avg("mape").alias("mape"), F.count(F.lit(1)).alias("n_folds")))


def evaluate_baselines_cv(sales: DataFrame, n_folds: int = 3, test_days: int = 30,
                          cfg: ForecastConfig = DEFAULT, models=None) -> DataFrame:
    """All registered baselines on walk-forward folds (min 30 training rows)."""
    return cv_summary(fold_metrics(fold_predictions(sales, cfg, n_folds, test_days,
                                                    models=models)))
