"""Wide sales files: load, date-column detection, wide-to-long, item metadata."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import write_once

# Accepted date column names (first match wins, exact case) and
# the non-item numeric columns that a wide sales file may carry.
DATE_COLUMN_CANDIDATES = ("datum", "date", "Date")
NON_ITEM_COLUMNS = ("Year", "year", "Month", "month", "Hour", "hour",
                    "Weekday Name", "weekday_name", "Weekday", "weekday", "Day", "day")


def load_raw_sales(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with header; types inferred unless ``schema`` is given (inference
    reads the files twice, so pass a schema for large inputs). A missing path
    is FileNotFoundError."""
    try:
        if schema is not None:
            return spark.read.csv(path, header=True, schema=schema)
        return spark.read.csv(path, header=True, inferSchema=True)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc) or "Path does not exist" in str(exc):
            raise FileNotFoundError(f"no sales file under {path}") from exc
        raise


def load_wide_csv(spark: SparkSession, path: str,
                  date_format: str = "yyyy-MM-dd") -> tuple[DataFrame, DataFrame]:
    """(readable lines, rejected lines) of a wide CSV with header.

    Every column but the date and the known non-item columns is an item and read as
    a number; nothing is inferred, so one bad field neither fails the load nor turns
    its item into text. A line with a field that is no number (or too many fields)
    is rejected as ``unreadable line``, one without a date in ``date_format`` as
    ``unreadable date``; ``rejected`` has the line as it stood and the reason. The
    files are read once.
    """
    try:
        names = spark.read.csv(path, header=True).columns
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc):
            raise FileNotFoundError(f"no sales file under {path}") from exc
        raise
    date_col = detect_date_column(names)
    text = {date_col, *NON_ITEM_COLUMNS}
    schema = T.StructType([T.StructField(c, T.StringType() if c in text else T.DoubleType())
                           for c in names] + [T.StructField("__line", T.StringType())])
    rows = spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE",
                          columnNameOfCorruptRecord="__line")
    day = F.try_to_timestamp(F.col(f"`{date_col}`"), F.lit(date_format)).cast("date")
    reason = F.when(F.col("__line").isNotNull(), "unreadable line").when(
        F.col("__day").isNull(), "unreadable date")
    rows = write_once(rows.withColumn("__day", day).withColumn("reason", reason))
    good = rows.filter("reason IS NULL").select(*[
        F.col("__day").alias(c) if c == date_col else F.col(f"`{c}`") for c in names])
    line = F.coalesce("__line", F.concat_ws(",", *[F.col(f"`{c}`").cast("string") for c in names]))
    return good, rows.filter("reason IS NOT NULL").select(line.alias("line"), "reason")


def detect_date_column(columns: list[str]) -> str:
    for name in DATE_COLUMN_CANDIDATES:
        if name in columns:
            return name
    raise ValueError(f"No date column found. Available columns: {list(columns)}")


def item_columns(df: DataFrame, date_col: str) -> list[str]:
    excluded = {date_col, *NON_ITEM_COLUMNS}
    return [f.name for f in df.schema.fields
            if f.name not in excluded and isinstance(f.dataType, T.NumericType)]


def wide_to_long(df: DataFrame, date_format: str | None = None) -> DataFrame:
    """Melt one-column-per-item into ``(date, drug_code, quantity_sold)``.

    Same-day duplicates are kept, not summed; rows with a missing quantity are
    dropped; quantities are truncated to integers (3.9 -> 3, -3.9 -> -3).
    Dates are parsed as ISO text unless ``date_format`` (a Spark datetime
    pattern such as ``MM/dd/yyyy``) is given; unparsable text raises.
    The result is not sorted: windows sort for themselves and reports order
    at output.
    """
    date_col = detect_date_column(df.columns)
    items = item_columns(df, date_col)
    if not items:
        raise ValueError("No numeric item columns found")
    raw = F.col(f"`{date_col}`")
    parsed = F.to_date(raw, date_format) if date_format else F.to_date(raw)
    values = df.select(parsed.alias("date"),
                       *[F.col(f"`{c}`").cast("double").alias(c) for c in items])
    long = values.unpivot(["date"], items, "drug_code", "quantity_sold")
    return (long.dropna(subset=["quantity_sold"])
            .select("date", "drug_code", F.col("quantity_sold").cast("int").alias("quantity_sold")))


def item_metadata(sales: DataFrame) -> DataFrame:
    """Distinct item codes; name and ATC code default to the code."""
    codes = sales.select("drug_code").distinct()
    return codes.select("drug_code", F.col("drug_code").alias("drug_name"),
                        F.col("drug_code").alias("atc_code"))


def load_summary(sales: DataFrame) -> DataFrame:
    """Rows, distinct series and date range of a long frame (one pass)."""
    return sales.agg(F.count(F.lit(1)).alias("n_rows"),
                     F.countDistinct("drug_code").alias("n_series"),
                     F.min("date").alias("min_date"),
                     F.max("date").alias("max_date"))
