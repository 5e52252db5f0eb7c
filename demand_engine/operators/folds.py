"""Positions, calendar split, minimum history and walk-forward folds.

Folds are positional (counted in rows from the end of each series, not in
days), as in the original. Every row belongs to at most one test window, so a
fold is a label on the row, not a copy of the training data: ``n_folds``
folds cost no more than one pass over the series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .features import ORDER_COL, series_window, with_order_key


def with_position(df: DataFrame, series: str = "drug_code") -> DataFrame:
    """Add ``idx`` (0-based row number by date) and ``n`` (rows in the series)."""
    return with_order_key(df).select("*",
                     (F.row_number().over(series_window(series)) - 1).alias("idx"),
                     F.count(F.lit(1)).over(Window.partitionBy(series)).cast("int").alias("n"))


def train_test_split(df: DataFrame, test_days: int = 30, series: str = "drug_code") -> DataFrame:
    """Flag ``is_train``: date <= (last date of the series - test_days)."""
    split_date = F.date_sub(F.max("date").over(Window.partitionBy(series)), test_days)
    return df.withColumn("is_train", F.col("date") <= split_date)


def min_history(df: DataFrame, min_rows: int = 90, series: str = "drug_code") -> DataFrame:
    """Keep series with at least ``min_rows`` rows (rows, not days).

    The count uses the ordered series window with a whole-series frame, so a
    following row-ordered window reuses its sort.
    """
    n = F.count(F.lit(1)).over(series_window(series).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing))
    return with_order_key(df).withColumn("__n", n).filter(F.col("__n") >= min_rows).drop("__n")


def fold_of(idx: Column, n: Column, n_folds: int, test_days: int, min_train: int):
    """(k, test_start, in_test) of a row; k = 1 is the last window."""
    k = F.floor((n - 1 - idx) / F.lit(test_days)).cast("int") + 1
    test_start = (n - k * test_days).cast("int")
    in_test = (k <= n_folds) & (test_start >= min_train)
    return k, test_start, in_test


def is_cutoff(idx: Column, n: Column, n_folds: int, test_days: int, min_train: int) -> Column:
    """True on the last training row before a valid test window."""
    back = n - 1 - idx
    k = F.floor(back / F.lit(test_days)).cast("int")
    return ((back % test_days) == 0) & (k >= 1) & (k <= n_folds) & (idx + 1 >= min_train)


def walk_forward_folds(df: DataFrame, n_folds: int = 3, test_days: int = 30,
                       min_train: int = 30, series: str = "drug_code") -> DataFrame:
    """Test rows of every fold: ``fold`` (1 = earliest), ``test_start``, ``pos``."""
    pos = with_position(df, series)
    k, test_start, in_test = fold_of(F.col("idx"), F.col("n"), n_folds, test_days, min_train)
    return (pos.select("*", (F.lit(n_folds) + 1 - k).alias("fold"),
                       test_start.alias("test_start"), in_test.alias("__in"))
            .filter("__in").drop("__in", ORDER_COL)
            .withColumn("pos", (F.col("idx") - F.col("test_start")).cast("int")))
