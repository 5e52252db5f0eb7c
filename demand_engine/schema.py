"""Spark schemas of the stored tables; every write is cast to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(10, 2)

DRUGS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("drug_code", T.StringType(), False),
    T.StructField("drug_name", T.StringType(), False),
    T.StructField("atc_code", T.StringType(), True),
    T.StructField("created_at", T.TimestampNTZType(), True),
])

SALES_DAILY = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("drug_id", T.LongType(), False),
    T.StructField("date", T.DateType(), False),
    T.StructField("quantity_sold", T.IntegerType(), False),
    T.StructField("created_at", T.TimestampNTZType(), True),
])

FORECASTS_DAILY = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("drug_id", T.LongType(), False),
    T.StructField("forecast_date", T.DateType(), False),
    T.StructField("run_timestamp", T.TimestampNTZType(), False),
    T.StructField("predicted_demand", MONEY, False),
    T.StructField("lower_ci", MONEY, True),
    T.StructField("upper_ci", MONEY, True),
    T.StructField("model_name", T.StringType(), False),
    T.StructField("created_at", T.TimestampNTZType(), True),
])

TABLES = {"drugs": DRUGS, "sales_daily": SALES_DAILY, "forecasts_daily": FORECASTS_DAILY}


def conform(df: DataFrame, table: str) -> DataFrame:
    """The columns of a stored table, in its order and types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[table].fields])
