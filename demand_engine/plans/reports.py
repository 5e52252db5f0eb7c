"""Reporting queries over the store (dashboard, item pages, forecast API).

Each function takes the store tables as DataFrames and answers one question
for all items at once; per-item pages are a filter on the same result.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_once
from ..sources.store import latest_forecasts  # noqa: F401  (re-exported)

# Risk thresholds on the average forecast of the newest run.
RISK_HIGH_ABOVE = 1000
RISK_MEDIUM_ABOVE = 500


def view_sales(sales: DataFrame, items: DataFrame, drug_code: str | None = None,
               ordered: bool = True) -> DataFrame:
    """Sales joined to item names, optionally for one code, by code and date."""
    it = items.select(F.col("id").alias("drug_id"), "drug_code", "drug_name")
    if drug_code is not None:
        it = it.filter(F.col("drug_code") == drug_code)
    out = sales.join(it, "drug_id").select("drug_code", "drug_name", "date", "quantity_sold")
    return out.orderBy("drug_code", "date") if ordered else out


def sales_head(sales: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    return view_sales(sales, items).limit(n)


QUARTILES = (0.25, 0.5, 0.75)


def describe_sales(view: DataFrame, by: str | None = "drug_code") -> DataFrame:
    """count, mean, std, min, quartiles (exact, linear interpolation), max.

    Quartiles come from counts per value: the (key, value, count) rows are
    range-partitioned, each partition adds up its own counts, and totals per
    partition (one row per key and partition) shift them. Each quartile is then
    the value that holds its lower neighbour and the one that holds its upper.
    No value list is ever gathered in one task.
    """
    q = F.col("quantity_sold")
    key = F.col(by) if by else F.lit("all")
    rows = view.select(key.alias("__key"), "quantity_sold")
    stats = rows.groupBy("__key").agg(
        F.count(q).alias("count"), F.avg(q).alias("mean"), F.stddev_samp(q).alias("std"),
        F.min(q).cast("double").alias("min"), F.max(q).cast("double").alias("max"))
    counted = (rows.filter(q.isNotNull()).groupBy("__key", "quantity_sold")
               .agg(F.count(F.lit(1)).alias("c")))
    ranged = write_once(counted.repartitionByRange("__key", "quantity_sold")
                        .withColumn("__pid", F.spark_partition_id()))
    before = Window.partitionBy("__key").orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (ranged.groupBy("__key", "__pid").agg(F.sum("c").alias("t"))
               .select("__key", "__pid", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("o")))
    inside = Window.partitionBy("__key", "__pid").orderBy("quantity_sold")
    places = (ranged.withColumn("upto", F.sum("c").over(inside))
              .join(offsets, ["__key", "__pid"]).join(stats.select("__key", "count"), "__key")
              .select("__key", "quantity_sold", "count",
                      (F.col("o") + F.col("upto") - F.col("c")).alias("first"),
                      (F.col("o") + F.col("upto") - 1).alias("last")))

    def holds(rank: Column) -> Column:
        return F.max(F.when((F.col("first") <= rank) & (rank <= F.col("last")), q))

    parts = []
    for i, p in enumerate(QUARTILES):
        rank = (F.col("count") - 1) * p
        parts += [holds(F.floor(rank)).alias(f"lo{i}"), holds(F.ceil(rank)).alias(f"hi{i}")]
    quartiles = places.groupBy("__key").agg(*parts)
    out = stats.join(quartiles, "__key", "left")
    at = lambda i, p: (F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}"))
                       * ((F.col("count") - 1) * p % 1)).alias(f"p{int(p * 100)}")
    return out.select(*([F.col("__key").alias(by)] if by else []), "count", "mean", "std", "min",
                      *[at(i, p) for i, p in enumerate(QUARTILES)], "max")


def newest_run(forecasts: DataFrame) -> DataFrame:
    """Forecast rows of each item's newest run (exact timestamp match).

    The newest timestamp per item is a partial (map-side) aggregate, and the
    rows are kept by a semi-join on (item, timestamp): an item whose history
    holds a third of all rows is never gathered into one task, because its
    older runs hash to other partitions.
    """
    latest = forecasts.groupBy("drug_id").agg(F.max("run_timestamp").alias("run_timestamp"))
    return forecasts.join(latest, ["drug_id", "run_timestamp"], "left_semi")


def risk_label(avg: Column) -> Column:
    a = F.coalesce(avg, F.lit(0.0))
    return (F.when(a > RISK_HIGH_ABOVE, "high").when(a > RISK_MEDIUM_ABOVE, "medium")
            .otherwise("low"))


def risk_ranking(items: DataFrame, forecasts: DataFrame, top: int = 10) -> DataFrame:
    """Top items by average forecast of their newest run, with a risk level.

    Items without forecasts drop out (the outer join is inner in effect).
    Ordered by average desc, then code, so the top-k cut is deterministic.
    """
    per_item = (newest_run(forecasts).groupBy("drug_id")
                .agg(F.avg(F.col("predicted_demand").cast("double")).alias("avg_forecast"),
                     F.max("run_timestamp").alias("latest_run")))
    joined = items.join(per_item, items.id == per_item.drug_id).select(
        "id", "drug_code", "drug_name", F.round("avg_forecast", 6).alias("avg_forecast"), "latest_run")
    level = risk_label(F.col("avg_forecast"))
    return (joined.withColumn("risk_level", level)
            .withColumn("risk_label", F.initcap(level))
            .orderBy(F.col("avg_forecast").desc_nulls_last(), F.col("drug_code"))
            .limit(top))


def child_counts(items: DataFrame, sales: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Items with their number of sales rows and forecast rows.

    Both facts are aggregated to one row per item before joining, so the
    joins never multiply rows.
    """
    s = sales.groupBy("drug_id").agg(F.count(F.lit(1)).alias("sales_count"))
    f = forecasts.groupBy("drug_id").agg(F.count(F.lit(1)).alias("forecast_count"))
    return (items.join(s, items.id == s.drug_id, "left").drop("drug_id")
            .join(f, items.id == f.drug_id, "left").drop("drug_id")
            .select("id", "drug_code", "drug_name", "atc_code",
                    F.coalesce("sales_count", F.lit(0)).alias("sales_count"),
                    F.coalesce("forecast_count", F.lit(0)).alias("forecast_count")))


def display_text(c: Column, default: str) -> Column:
    """JavaScript ``x || default``: NULL and empty text both show the default."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def item_overview(items: DataFrame, sales: DataFrame, forecasts: DataFrame) -> DataFrame:
    c = child_counts(items, sales, forecasts)
    return c.select("id", "drug_code", "drug_name",
                    display_text(F.col("atc_code"), "-").alias("atc_display"),
                    "sales_count", "forecast_count").orderBy("drug_code")


def dashboard_cards(items: DataFrame, sales: DataFrame, forecasts: DataFrame) -> DataFrame:
    c = child_counts(items, sales, forecasts)
    return c.agg(F.count(F.lit(1)).alias("total_items"),
                 F.count_if(F.col("forecast_count") > 0).alias("items_with_forecasts"),
                 F.coalesce(F.sum("sales_count"), F.lit(0)).alias("total_sales_records"))


def sales_since(sales: DataFrame, as_of: _dt.date, years_back: int = 10) -> DataFrame:
    """Sales on or after ``as_of`` minus ``years_back`` years (page look-back)."""
    return sales.filter(F.col("date") >= F.add_months(F.lit(as_of), -12 * years_back))


def item_forecasts(forecasts: DataFrame) -> DataFrame:
    """Item page forecasts: runs at or after the newest, one row per date (first by id).

    "At or after the newest" is the newest run itself (nothing is after the
    maximum), so this is :func:`newest_run` plus a de-duplication by date,
    whose groups hold one row per model of that run.
    """
    newest = newest_run(forecasts)
    first = Window.partitionBy("drug_id", "forecast_date").orderBy("id")
    return (newest.withColumn("__rn", F.row_number().over(first))
            .filter("__rn = 1").drop("__rn"))


def item_stats(items: DataFrame, sales: DataFrame, forecasts: DataFrame,
               as_of: _dt.date) -> DataFrame:
    """Per item: sales rows in the look-back, forecast points, last run, avg demand (1 dp)."""
    s = (sales_since(sales, as_of).groupBy("drug_id")
         .agg(F.count(F.lit(1)).alias("sales_records"), F.avg("quantity_sold").alias("__avg")))
    f = (item_forecasts(forecasts).groupBy("drug_id")
         .agg(F.count(F.lit(1)).alias("forecast_points"), F.max("run_timestamp").alias("last_run")))
    return (items.select("id", "drug_code", "drug_name",
                         display_text(F.col("atc_code"), "N/A").alias("atc_display"))
            .join(s, F.col("id") == s.drug_id, "left").drop("drug_id")
            .join(f, F.col("id") == f.drug_id, "left").drop("drug_id")
            .select("id", "drug_code", "drug_name", "atc_display",
                    F.coalesce("sales_records", F.lit(0)).alias("sales_records"),
                    F.coalesce("forecast_points", F.lit(0)).alias("forecast_points"),
                    "last_run",
                    F.coalesce(F.round("__avg", 1), F.lit(0.0)).alias("avg_daily_demand")))


def latest_run_forecasts(items: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Forecast API: rows of each item's newest run with code and name, by date."""
    it = items.select(F.col("id").alias("drug_id"), "drug_code", "drug_name")
    return newest_run(forecasts).join(it, "drug_id").orderBy("drug_id", "forecast_date")


def forecast_range(items: DataFrame, forecasts: DataFrame, drug_id: int | None,
                   date_from: _dt.date | None = None, date_to: _dt.date | None = None) -> DataFrame:
    """Forecast API for one item: optional inclusive date bounds; id required."""
    if drug_id is None:
        raise ValueError("drugId parameter is required")
    f = forecasts.filter(F.col("drug_id") == drug_id)
    if date_from is not None:
        f = f.filter(F.col("forecast_date") >= F.lit(date_from))
    if date_to is not None:
        f = f.filter(F.col("forecast_date") <= F.lit(date_to))
    # newest run is decided over all of the item's rows, before the date bounds
    latest = forecasts.filter(F.col("drug_id") == drug_id).agg(F.max("run_timestamp").alias("__l"))
    return (f.join(latest, F.col("run_timestamp") == F.col("__l")).drop("__l")
            .join(items.select(F.col("id").alias("drug_id"), "drug_code", "drug_name"), "drug_id")
            .orderBy("forecast_date"))


def item_by_id(items: DataFrame, drug_id: int) -> DataFrame:
    return items.filter(F.col("id") == drug_id)


def recent_sales(sales: DataFrame, n: int = 10) -> DataFrame:
    """Last ``n`` days of each item, newest first."""
    w = Window.partitionBy("drug_id").orderBy(F.col("date").desc())
    return (sales.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
            .orderBy("drug_id", "rank"))


def chart_series(sales: DataFrame, forecasts: DataFrame, as_of: _dt.date) -> DataFrame:
    """Actuals and newest forecasts in one sparse frame per item.

    Dates as ISO text; interval bounds are dropped when zero or missing, as
    a JavaScript truthiness test does.
    """
    actual = sales_since(sales, as_of).select(
        "drug_id", F.date_format("date", "yyyy-MM-dd").alias("date"),
        F.col("quantity_sold").alias("actual"))

    def truthy(c):
        return F.when(F.col(c).isNotNull() & (F.col(c) != 0), F.col(c).cast("double"))

    pred = item_forecasts(forecasts).select(
        "drug_id", F.date_format("forecast_date", "yyyy-MM-dd").alias("date"),
        F.col("predicted_demand").cast("double").alias("predicted"),
        truthy("lower_ci").alias("lower_ci"), truthy("upper_ci").alias("upper_ci"))
    return actual.unionByName(pred, allowMissingColumns=True)


# The dashboard's ranking as SQL text for Spark SQL over temp views: the newest
# run of each item first, then the average of its rows.
RANKING_SQL = """
WITH newest AS (
  SELECT drug_id, max(run_timestamp) AS latest_run FROM forecasts_daily GROUP BY drug_id),
demand AS (
  SELECT n.drug_id, n.latest_run, avg(CAST(p.predicted_demand AS DOUBLE)) AS mean_demand
  FROM newest n INNER JOIN forecasts_daily p
    ON p.drug_id = n.drug_id AND p.run_timestamp = n.latest_run
  GROUP BY n.drug_id, n.latest_run)
SELECT items.id, items.drug_code, items.drug_name, round(mean_demand, 6) AS avg_forecast, latest_run
FROM demand INNER JOIN drugs AS items ON items.id = demand.drug_id
ORDER BY avg_forecast DESC NULLS LAST, items.drug_code
LIMIT 10
"""


def risk_ranking_sql(items: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Same answer as :func:`risk_ranking`, from SQL text."""
    spark = items.sparkSession
    items.createOrReplaceTempView("drugs")
    forecasts.createOrReplaceTempView("forecasts_daily")
    ranked = spark.sql(RANKING_SQL)
    level = risk_label(F.col("avg_forecast"))
    return ranked.withColumn("risk_level", level).withColumn("risk_label", F.initcap(level))
