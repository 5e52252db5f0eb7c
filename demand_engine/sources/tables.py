"""Daily sales series derived from the given parquet tables.

The driver tables stand in for a shop's daily sales file: an item series is a
``part`` attribute (``p_type`` by default: 6 series; ``p_brand``: 25;
``p_partkey``: thousands), the day is the ship date and the demand is the
summed line quantity. The join is left to the optimizer (broadcast while
``part`` is small, sort-merge join once it is not) and the aggregation is a
partial (map-side) hash aggregate before its shuffle, so a series holding a
third of all line items only costs one pre-aggregated row per task and day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sales_daily(spark: SparkSession, sf_dir: str, series: str = "p_type") -> DataFrame:
    """Long frame ``(date DATE, drug_code STRING, quantity_sold INT)``.

    ``series`` is a ``part`` column (joined on the part key) or a ``lineitem``
    column such as ``l_suppkey`` (no join; about 1,000 series at sf0.1).
    """
    li = table(spark, sf_dir, "lineitem")
    if series.startswith("l_"):
        keyed = li.select(F.col(series).cast("string").alias("drug_code"), "l_quantity", "l_shipdate")
    else:
        part = table(spark, sf_dir, "part").select(
            "p_partkey", F.col(series).cast("string").alias("drug_code"))
        keyed = (li.select("l_partkey", "l_quantity", "l_shipdate")
                 .join(part, F.col("l_partkey") == F.col("p_partkey")))
    return (keyed.groupBy("drug_code", F.to_date("l_shipdate").alias("date"))
            .agg(F.sum("l_quantity").cast("int").alias("quantity_sold"))
            .select("date", "drug_code", "quantity_sold"))


def line_counts_daily(spark: SparkSession, sf_dir: str, series: str = "p_type") -> DataFrame:
    """Second measure over the same keys: number of lines per series and day.

    Used as the "new batch" of an upsert so that replaced values are visible.
    """
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", F.col(series).cast("string").alias("drug_code"))
    return (li.join(part, li.l_partkey == part.p_partkey)
            .groupBy("drug_code", F.to_date("l_shipdate").alias("date"))
            .agg(F.count(F.lit(1)).cast("int").alias("quantity_sold"))
            .select("date", "drug_code", "quantity_sold"))


def wide_sales(spark: SparkSession, sf_dir: str, series: str = "p_type") -> DataFrame:
    """Wide layout (``datum`` + one numeric column per item), as a sales CSV has.

    A wide file has one column per item, so the item count is the column count
    of a file and bounded; the pivot keys are found by Spark itself.
    """
    long = sales_daily(spark, sf_dir, series)
    return (long.groupBy(F.col("date").alias("datum"))
            .pivot("drug_code")
            .agg(F.first("quantity_sold")))


def fill_missing_days(sales: DataFrame) -> DataFrame:
    """Every day between the first and last of each series; missing days are 0."""
    span = sales.groupBy("drug_code").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = span.select("drug_code", F.explode(F.sequence("a", "b")).alias("date"))
    return (days.join(sales, ["drug_code", "date"], "left")
            .select("date", "drug_code", F.coalesce("quantity_sold", F.lit(0)).alias("quantity_sold")))


SALES_SQL = """sales_daily AS (
  SELECT p_type AS drug_code, CAST(l_shipdate AS DATE) AS date,
         CAST(TRUNC(SUM(l_quantity)) AS INTEGER) AS quantity_sold
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""

LINES_SQL = """line_counts AS (
  SELECT p_type AS drug_code, CAST(l_shipdate AS DATE) AS date,
         CAST(COUNT(*) AS INTEGER) AS quantity_sold
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
