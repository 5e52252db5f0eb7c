"""Feature frame: calendar, external, lag and rolling features in one pass.

All lag and rolling columns share one window (partition = series, order =
date), so the whole feature frame costs one shuffle by series and one sort;
the calendar/holiday/seasonal columns are projections in the same stage.
A daily series has one row per day, so the largest window partition is the
longest history (thousands of rows), whatever the size of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, ForecastConfig
from ..functions import calendar as cal

ID_COLUMNS = ("date", "drug_code", "quantity_sold")
EXCLUDED_FROM_MODEL = ("date", "drug_code", "quantity_sold", "drug_id", "__order")


DAY = 1 << 32  # one day in units of the order key


def order_key(date: str = "date", target: str = "quantity_sold") -> Column:
    """One ``long`` that orders rows like ``(date, quantity)``.

    ``day_number * 2^32 + (quantity + 2^31)``: quantity breaks ties among
    same-day duplicates so results are repeatable, and because it is a
    single numeric key, row frames and day-based range frames
    (``rangeBetween(-k * DAY, 0)``) share one window order, hence one sort.
    """
    return (F.unix_date(F.col(date)).cast("long") * DAY
            + (F.col(target).cast("long") + (1 << 31)))


ORDER_COL = "__order"


def with_order_key(df: DataFrame) -> DataFrame:
    """Materialise the order key once: windows that order by the same column
    (not by equal expressions, which Spark aliases per window) share one sort."""
    return df if ORDER_COL in df.columns else df.withColumn(ORDER_COL, order_key())


def series_window(series: str = "drug_code") -> Window:
    """Series window in (date, quantity) order; the frame needs ``with_order_key``."""
    return Window.partitionBy(series).orderBy(F.col(ORDER_COL))


def lag_columns(lags, target: str = "quantity_sold", w: Window | None = None) -> list[Column]:
    w = w or series_window()
    return [F.lag(target, n).over(w).alias(f"lag_{n}") for n in lags]


def rolling_columns(windows, target: str = "quantity_sold", w: Window | None = None,
                    stats=("mean", "std", "min", "max")) -> list[Column]:
    """Statistics of the ``n`` rows before the current one (shifted by one row).

    Frame ``rows -n .. -1``; one preceding row is enough (min_periods = 1);
    the sample std of one row is NULL.
    """
    w = w or series_window()
    fns = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    out = []
    for n in windows:
        frame = w.rowsBetween(-n, -1)
        for s in stats:
            out.append(fns[s](target).over(frame).alias(f"rolling_{s}_{n}"))
    return out


def external_columns(date: Column, country: str) -> list[Column]:
    return [cal.is_holiday(date, country).alias("is_holiday"), *cal.seasonal_columns(date)]


def feature_names(cfg: ForecastConfig = DEFAULT) -> list[str]:
    names = ["day_of_week", "day_of_month", "month", "quarter", "week_of_year",
             "is_weekend", "is_month_start", "is_month_end",
             "is_holiday", "flu_season_index", "allergy_season_index"]
    names += [f"lag_{n}" for n in cfg.lags]
    for n in cfg.rolling_windows:
        names += [f"rolling_{s}_{n}" for s in ("mean", "std", "min", "max")]
    return names


def engineer_features(sales: DataFrame, cfg: ForecastConfig = DEFAULT,
                      extra_holidays: DataFrame | None = None,
                      keep_order_key: bool = False) -> DataFrame:
    """The 27-column feature frame (plus date, drug_code, quantity_sold).

    Missing lag/rolling values (warm-up rows) are filled with 0, as the
    original does before its (then ineffective) drop of rows without lag_30.
    """
    date = F.col("date")
    w = series_window()
    base = with_order_key(sales.select(*ID_COLUMNS))
    if extra_holidays is not None:
        base = cal.with_holiday_flag(base, cfg.holiday_country, extra_holidays=extra_holidays)
        holiday = [F.col("is_holiday")]
    else:
        holiday = [cal.is_holiday(date, cfg.holiday_country).alias("is_holiday")]
    feats = base.select(
        *ID_COLUMNS,
        *([ORDER_COL] if keep_order_key else []),
        *cal.time_feature_columns(date),
        *holiday,
        *cal.seasonal_columns(date),
        *lag_columns(cfg.lags, w=w),
        *rolling_columns(cfg.rolling_windows, w=w),
    )
    model_cols = [c for c in feats.columns if c not in ID_COLUMNS and c != ORDER_COL]
    return feats.fillna(0, subset=model_cols)


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in EXCLUDED_FROM_MODEL]
