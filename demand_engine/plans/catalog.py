"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Every query reads the given parquet tables (or frames Spark derives from
them) in full; parameters are the operator defaults unless stated.
Floating-point outputs are rounded to 6 decimals so that a check against
another engine compares values, not the last bits of a summation order.
"""

from __future__ import annotations

import datetime as _dt
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import BOOSTED, DEFAULT, NAIVE
from ..functions import calendar as cal
from ..operators import baselines as B
from ..operators import boosted as BO
from ..operators import evaluation as E
from ..operators import features as FE
from ..operators import folds as FO
from ..operators import recursive as RC
from ..session import ensure_checkpoint_dir, write_once
from ..sources import store as S
from ..sources import tables as TB
from ..sources import wide as W
from . import reports as R
from .fixture import RUN_1, demo_store
from .forecast_run import (eligible_features, evaluate, forecast_through_store,
                           train_production)

# Parameters of the parameterised report queries.
FILTER_CODE = "PROMO"
ITEM_ID = 3
AS_OF = _dt.date(2005, 6, 30)
RANGE_FROM = _dt.date(2001, 10, 1)
RANGE_TO = _dt.date(2001, 10, 20)
DELETED_CODE = "PROMO"
SALES_OLD_UNTIL = _dt.date(2001, 6, 30)
SALES_NEW_FROM = _dt.date(2001, 6, 1)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    cols = [F.round(F.col(f.name), digits).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
            for f in df.schema.fields]
    return df.select(*cols)


def _sales(spark, sf):
    return TB.sales_daily(spark, sf)


# --- ingest -----------------------------------------------------------------

@register("load_summary")
def q_load_summary(spark, sf):
    return W.load_summary(_sales(spark, sf))


@register("wide_to_long")
def q_wide_to_long(spark, sf):
    return W.wide_to_long(TB.wide_sales(spark, sf))


@register("item_metadata")
def q_item_metadata(spark, sf):
    return W.item_metadata(_sales(spark, sf))


# --- features ---------------------------------------------------------------

@register("time_features")
def q_time_features(spark, sf):
    return _sales(spark, sf).select("drug_code", "date", *cal.time_feature_columns(F.col("date")))


@register("seasonal_indices")
def q_seasonal_indices(spark, sf):
    return round_doubles(_sales(spark, sf).select("drug_code", "date",
                                                  *cal.seasonal_columns(F.col("date"))))


@register("holiday_flag")
def q_holiday_flag(spark, sf):
    return _sales(spark, sf).select(
        "drug_code", "date", cal.is_holiday(F.col("date"), DEFAULT.holiday_country).alias("is_holiday"))


@register("holidays_of_two_countries")
def q_holidays_of_two_countries(spark, sf):
    """One frame, two countries: series whose code has an even length sell in the US, the
    others in Germany."""
    sales = _sales(spark, sf)
    years = sales.agg(F.min(F.year("date")).alias("a"), F.max(F.year("date")).alias("b")).first()
    country = F.when(F.length("drug_code") % 2 == 0, "US").otherwise("DE")
    where = sales.select("drug_code", country.alias("country")).distinct()
    table = cal.holiday_calendar(spark, ["US", "DE"], years.a, years.b)
    return cal.with_country_holidays(sales, where, table).select(
        "drug_code", "country", "date", "is_holiday")


@register("lag_features")
def q_lag_features(spark, sf):
    return FE.with_order_key(_sales(spark, sf)).select("drug_code", "date", "quantity_sold",
                                                       *FE.lag_columns(DEFAULT.lags))


def _rolling(stat):
    def q(spark, sf):
        return round_doubles(FE.with_order_key(_sales(spark, sf)).select(
            "drug_code", "date", *FE.rolling_columns(DEFAULT.rolling_windows, stats=(stat,))))
    return q


for _stat in ("mean", "std", "min", "max"):
    register(f"rolling_{_stat}")(_rolling(_stat))


@register("feature_frame")
def q_feature_frame(spark, sf):
    return round_doubles(FE.engineer_features(_sales(spark, sf)))


# --- splits and folds -------------------------------------------------------

@register("train_test_split")
def q_train_test_split(spark, sf):
    return FO.train_test_split(_sales(spark, sf), DEFAULT.test_days)


@register("min_history")
def q_min_history(spark, sf):
    return FO.min_history(_sales(spark, sf), DEFAULT.min_history_days).select(
        "date", "drug_code", "quantity_sold")


@register("walk_forward_folds")
def q_walk_forward_folds(spark, sf):
    return FO.walk_forward_folds(_sales(spark, sf), DEFAULT.cv_folds, DEFAULT.test_days,
                                 DEFAULT.baseline_min_train)


@register("series_tail")
def q_series_tail(spark, sf):
    k = max(DEFAULT.lags)
    pos = FO.with_position(_sales(spark, sf))
    return pos.filter(F.col("idx") >= F.col("n") - k).select("drug_code", "date", "quantity_sold")


# --- baselines --------------------------------------------------------------

@register("naive_forecast")
def q_naive(spark, sf):
    return round_doubles(B.naive_forecast(_sales(spark, sf), DEFAULT.horizon))


@register("moving_average_forecast")
def q_ma(spark, sf):
    return round_doubles(B.moving_average_forecast(_sales(spark, sf), DEFAULT.ma_window, DEFAULT.horizon))


@register("seasonal_naive_forecast")
def q_seasonal(spark, sf):
    return round_doubles(B.seasonal_naive_forecast(_sales(spark, sf), DEFAULT.season_length,
                                                   DEFAULT.horizon))


@register("forecast_calendar")
def q_forecast_calendar(spark, sf):
    return B.forecast_calendar(_sales(spark, sf), DEFAULT.horizon)


@register("all_baseline_forecasts")
def q_all_baselines(spark, sf):
    return round_doubles(B.baseline_forecasts(_sales(spark, sf), DEFAULT.horizon))


@register("clamped_baselines")
def q_clamped(spark, sf):
    fc = B.baseline_forecasts(_sales(spark, sf), DEFAULT.horizon)
    return round_doubles(fc.select(
        "drug_code", "model_name", "date",
        *[F.greatest(F.lit(0.0), F.col(c)).alias(c)
          for c in ("predicted_demand", "lower_ci", "upper_ci")]))


def _cv(spark, sf):
    return B.evaluate_baselines_cv(_sales(spark, sf), DEFAULT.cv_folds, DEFAULT.test_days)


@register("baseline_fold_metrics")
def q_fold_metrics(spark, sf):
    return round_doubles(B.fold_metrics(B.fold_predictions(_sales(spark, sf))))


@register("baseline_cv")
def q_baseline_cv(spark, sf):
    return round_doubles(_cv(spark, sf))


@register("best_model_per_series")
def q_best_model(spark, sf):
    return round_doubles(E.best_model_per_series(_cv(spark, sf)))


def _pipeline_series_cv(spark, sf):
    """Baseline CV of the series the forecasting run evaluates: at least
    ``min_history_days`` rows and one boosted fold (``n - test_days >= 90``)."""
    s = FO.min_history(_sales(spark, sf), DEFAULT.min_history_days + DEFAULT.test_days)
    return B.evaluate_baselines_cv(s, DEFAULT.cv_folds, DEFAULT.test_days)  # keeps the sort


@register("model_comparison")
def q_model_comparison(spark, sf):
    return round_doubles(E.model_comparison(_pipeline_series_cv(spark, sf)))


@register("model_summary")
def q_model_summary(spark, sf):
    return round_doubles(E.model_summary(_pipeline_series_cv(spark, sf)))


@register("series_profile")
def q_series_profile(spark, sf):
    return round_doubles(E.series_profile(_sales(spark, sf), DEFAULT.zero_fraction_warn))


@register("zero_inflated_suppliers")
def q_zero_inflated_suppliers(spark, sf):
    """Suppliers ship on few days: with the missing days filled, zeros prevail."""
    daily = TB.fill_missing_days(TB.sales_daily(spark, sf, "l_suppkey"))
    return round_doubles(E.zero_inflated_series(daily, DEFAULT.zero_fraction_warn))


@register("zero_inflated_series")
def q_zero_inflated(spark, sf):
    return round_doubles(E.zero_inflated_series(_sales(spark, sf), DEFAULT.zero_fraction_warn))


# --- store ------------------------------------------------------------------

@register("upsert_items")
def q_upsert_items(spark, sf):
    meta = W.item_metadata(_sales(spark, sf))
    # an earlier state of the dimension: the codes of even length, lower-case names,
    # ids in reverse code order (so id order and code order differ)
    first = S.with_sequential_id(
        meta.filter(F.length("drug_code") % 2 == 0), [F.col("drug_code").desc()]).select(
        "id", "drug_code", F.lower("drug_name").alias("drug_name"),
        F.lit(None).cast("string").alias("atc_code"))
    return S.upsert_items(first, meta)


@register("upsert_sales")
def q_upsert_sales(spark, sf):
    old = _sales(spark, sf).filter(F.col("date") <= F.lit(SALES_OLD_UNTIL))
    new = TB.line_counts_daily(spark, sf).filter(F.col("date") >= F.lit(SALES_NEW_FROM))
    return S.upsert_by_key(old.select("drug_code", "date", "quantity_sold"),
                           new.select("drug_code", "date", "quantity_sold"), ["drug_code", "date"])


def _scratch_store(spark):
    """An empty store in the session's shared folder, of this call alone."""
    return S.ParquetStore(spark, f"{ensure_checkpoint_dir(spark)}/store-{uuid.uuid4().hex}")


def _old_sales(spark, sf):
    return _sales(spark, sf).filter(F.col("date") <= F.lit(SALES_OLD_UNTIL))


@register("store_first_load")
def q_store_first_load(spark, sf):
    """A first batch that holds keys twice: one row per key is stored."""
    st = _scratch_store(spark)
    long = _sales(spark, sf)
    st.upsert_items(W.item_metadata(long))
    return st.upsert_sales(long.unionByName(TB.line_counts_daily(spark, sf))).select(
        "id", "drug_id", "date", "quantity_sold")


@register("store_reload")
def q_store_reload(spark, sf):
    """A second batch over a loaded table: known keys keep their id."""
    st = _scratch_store(spark)
    st.upsert_items(W.item_metadata(_sales(spark, sf)))
    st.upsert_sales(_old_sales(spark, sf))
    new = TB.line_counts_daily(spark, sf).filter(F.col("date") >= F.lit(SALES_NEW_FROM))
    return st.upsert_sales(new).select("id", "drug_id", "date", "quantity_sold")


@register("store_delete")
def q_store_delete(spark, sf):
    """Sales left after an item was deleted from the store with its rows."""
    st = _scratch_store(spark)
    st.upsert_items(W.item_metadata(_sales(spark, sf)))
    st.upsert_sales(_sales(spark, sf))
    st.delete_items(spark.createDataFrame([(DELETED_CODE,)], "drug_code string"))
    return st.read("sales_daily").join(st.read("drugs").select(
        F.col("id").alias("drug_id"), "drug_code"), "drug_id", "left").select(
        "drug_id", "drug_code", "date", "quantity_sold")


@register("store_created_at")
def q_store_created_at(spark, sf):
    """After a second batch: rows by whether their created_at is the first write's (known
    keys keep it, new keys get that of their own batch)."""
    st = _scratch_store(spark)
    st.upsert_items(W.item_metadata(_sales(spark, sf)))
    first = st.upsert_sales(_old_sales(spark, sf)).agg(F.max("created_at")).first()[0]
    new = TB.line_counts_daily(spark, sf).filter(F.col("date") >= F.lit(SALES_NEW_FROM))
    rows = st.upsert_sales(new).withColumn("from_first_write", F.col("created_at") <= F.lit(first))
    return rows.groupBy("drug_id", "from_first_write").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("created_at").alias("n_stamped"),
        F.countDistinct("created_at").alias("n_stamps"))


@register("json_round_trip")
def q_json_round_trip(spark, sf):
    """Latest forecasts written as JSON records and read back."""
    latest = S.latest_forecasts(demo_store(spark, sf).forecasts)
    path = f"{ensure_checkpoint_dir(spark)}/json-{uuid.uuid4().hex}"
    S.write_json(latest, path)
    return spark.read.schema(latest.schema).json(path)


@register("csv_ingest")
def q_csv_ingest(spark, sf):
    """The wide table as CSV with some broken lines, loaded again: the long rows."""
    good, _ = W.load_wide_csv(spark, _wide_csv(spark, sf))
    return W.wide_to_long(good)


@register("csv_rejected")
def q_csv_rejected(spark, sf):
    """Of the same file: the lines that were turned away, by reason."""
    _, rejected = W.load_wide_csv(spark, _wide_csv(spark, sf))
    return rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("n_lines"))


def _wide_csv(spark, sf):
    """Wide sales as CSV text; every 40th day of the year has a letter in place of its
    first number, every 41st no readable date."""
    wide = TB.wide_sales(spark, sf)
    first, *others = [c for c in wide.columns if c != "datum"]
    day, date = F.dayofyear("datum"), F.col("datum").cast("string")
    text = wide.select(
        F.when(day % 41 == 0, F.concat(F.lit("day "), date)).otherwise(date).alias("datum"),
        F.when(day % 40 == 0, F.lit("x")).otherwise(F.col(first).cast("string")).alias(first),
        *others)
    path = f"{ensure_checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    text.write.option("header", True).csv(path)
    return path


@register("registered_forecaster")
def q_registered_forecaster(spark, sf):
    """A user's forecaster (the mean of the history, one deviation wide) through the
    registry and the plan of the built-in ones."""
    def mean(stats, pos, cfg):
        return (stats["hist_mean"], stats["hist_mean"] - stats["hist_std"],
                stats["hist_mean"] + stats["hist_std"])

    B.register_forecaster("History Mean", mean)
    try:
        return round_doubles(B.baseline_forecasts(_sales(spark, sf), DEFAULT.horizon,
                                                  models=["History Mean"]))
    finally:
        B.unregister_forecaster("History Mean")


@register("model_reload")
def q_model_reload(spark, sf):
    """Change of each prediction and bound when the models are saved and loaded again."""
    cfg = replace(DEFAULT, gbt_max_iter=4, gbt_chunk_rounds=2, quantile_rounds=3)
    feats = _features(spark, sf)
    table = BO.training_table(feats, cfg)
    models = train_production(feats, cfg, table)
    path = f"{ensure_checkpoint_dir(spark)}/models-{uuid.uuid4().hex}"
    BO.save_models(models, path, spark)
    held = table.filter("production = 'valid'").select("drug_code", "date", "features")
    before = BO.predict(models, held)
    columns = ("predicted_demand", "lower_ci", "upper_ci")
    after = BO.predict(BO.load_models(spark, path, cfg), held).withColumnsRenamed(
        {c: f"__{c}" for c in columns})
    return before.join(after, ["drug_code", "date"]).select(
        "drug_code", "date", *[F.abs(F.col(c) - F.col(f"__{c}")).alias(f"{c}_change") for c in columns])


@register("forecasting_run_stand_in")
def q_forecasting_run_stand_in(spark, sf):
    """The whole run through a store, with last week's value as the model."""
    st = _scratch_store(spark)
    forecast_through_store(_sales(spark, sf), lambda df: df.withColumn("prediction", F.col("lag_7")),
                           st, "Last Week", RUN_1)
    stored = st.read("forecasts_daily")
    return stored.join(st.read("drugs").select(F.col("id").alias("drug_id"), "drug_code"), "drug_id").select(
        "drug_id", "drug_code", "forecast_date", "run_timestamp", "predicted_demand", "lower_ci",
        "upper_ci", "model_name")


@register("sales_with_ids")
def q_sales_with_ids(spark, sf):
    return demo_store(spark, sf).sales


@register("forecast_records")
def q_forecast_records(spark, sf):
    return demo_store(spark, sf).forecasts


@register("dq_constraints")
def q_dq(spark, sf):
    st = demo_store(spark, sf)
    return S.dq_constraints(st.items, st.sales, st.forecasts)


@register("cascade_delete")
def q_cascade(spark, sf):
    st = demo_store(spark, sf)
    gone = spark.createDataFrame([(DELETED_CODE,)], "drug_code string")
    _, kept = S.cascade_delete(st.items, st.forecasts, gone)
    return kept


@register("latest_forecasts")
def q_latest_forecasts(spark, sf):
    return S.latest_forecasts(demo_store(spark, sf).forecasts)


# --- reports ----------------------------------------------------------------

@register("view_sales")
def q_view_sales(spark, sf):
    st = demo_store(spark, sf)
    return R.view_sales(st.sales, st.items)


@register("view_sales_filtered")
def q_view_sales_filtered(spark, sf):
    st = demo_store(spark, sf)
    return R.view_sales(st.sales, st.items, FILTER_CODE)


@register("sales_head")
def q_sales_head(spark, sf):
    st = demo_store(spark, sf)
    return R.sales_head(st.sales, st.items)


@register("describe_sales")
def q_describe(spark, sf):
    st = demo_store(spark, sf)
    return round_doubles(R.describe_sales(R.view_sales(st.sales, st.items, ordered=False)))


@register("describe_sales_overall")
def q_describe_overall(spark, sf):
    st = demo_store(spark, sf)
    return round_doubles(R.describe_sales(R.view_sales(st.sales, st.items, ordered=False), by=None))


@register("risk_ranking")
def q_risk(spark, sf):
    st = demo_store(spark, sf)
    return R.risk_ranking(st.items, st.forecasts)


@register("risk_ranking_sql")
def q_risk_sql(spark, sf):
    st = demo_store(spark, sf)
    return R.risk_ranking_sql(st.items, st.forecasts)


@register("item_overview")
def q_item_overview(spark, sf):
    st = demo_store(spark, sf)
    return R.item_overview(st.items, st.sales, st.forecasts)


@register("dashboard_cards")
def q_cards(spark, sf):
    st = demo_store(spark, sf)
    return R.dashboard_cards(st.items, st.sales, st.forecasts)


@register("item_stats")
def q_item_stats(spark, sf):
    st = demo_store(spark, sf)
    return R.item_stats(st.items, st.sales, st.forecasts, AS_OF)


@register("item_sales_history")
def q_item_sales_history(spark, sf):
    return R.sales_since(demo_store(spark, sf).sales, AS_OF)


@register("latest_run_forecasts")
def q_latest_run(spark, sf):
    st = demo_store(spark, sf)
    return R.latest_run_forecasts(st.items, st.forecasts)


@register("forecast_range")
def q_forecast_range(spark, sf):
    st = demo_store(spark, sf)
    return R.forecast_range(st.items, st.forecasts, ITEM_ID, RANGE_FROM, RANGE_TO)


@register("item_by_id")
def q_item_by_id(spark, sf):
    return R.item_by_id(demo_store(spark, sf).items, ITEM_ID)


@register("recent_sales")
def q_recent_sales(spark, sf):
    return R.recent_sales(demo_store(spark, sf).sales)


@register("item_forecasts")
def q_item_forecasts(spark, sf):
    return R.item_forecasts(demo_store(spark, sf).forecasts)


@register("chart_series")
def q_chart_series(spark, sf):
    st = demo_store(spark, sf)
    return R.chart_series(st.sales, st.forecasts, AS_OF)


@register("run_totals")
def q_run_totals(spark, sf):
    newest = R.newest_run(demo_store(spark, sf).forecasts)
    return newest.agg(F.countDistinct("drug_id").alias("series_forecast"),
                      F.count(F.lit(1)).alias("forecasts_generated"))



# --- boosted model (results depend on a fitted model: checked on rows only) --

def _features(spark, sf):
    """Feature frame with scale columns, written once for all uses of a query."""
    return write_once(BO.with_scale(eligible_features(_sales(spark, sf), DEFAULT)))


@register("boosted_cv")
def q_boosted_cv(spark, sf):
    return round_doubles(BO.walk_forward_validate(_features(spark, sf), DEFAULT))


@register("boosted_fit_summary")
def q_boosted_fit_summary(spark, sf):
    return round_doubles(BO.feature_importances(train_production(_features(spark, sf)), spark))


@register("leaf_quantiles")
def q_leaf_quantiles(spark, sf):
    table = BO.training_table(_features(spark, sf), DEFAULT)
    model = BO.fit_interval_model(BO.part_of(table, "interval"), DEFAULT, None, "__valid")
    rows = [(name, *leaf) for name, side in (("lower", model.lower), ("upper", model.upper))
            for leaf in side.leaves]
    return spark.createDataFrame(rows, "bound string, tree int, leaf int, value double")


@register("pinball_leaves_stand_in")
def q_pinball_leaves(spark, sf):
    """One round's leaf values, with series and weekday as the leaf and last week's
    value as the bound so far."""
    f = _features(spark, sf).withColumn("leaf", F.concat_ws("/", "drug_code", "day_of_week"))
    error = (F.col("quantity_sold") - F.col("lag_7")).cast("double")
    low, high = (BO.leaf_quantiles(f, "leaf", error, a).withColumnRenamed("value", name)
                 for a, name in ((DEFAULT.interval_alpha_low, "lower_value"),
                                 (DEFAULT.interval_alpha_high, "upper_value")))
    return low.join(high, "leaf")


def _predicted(spark, sf, series="p_type"):
    feats = write_once(BO.with_scale(eligible_features(TB.sales_daily(spark, sf, series), DEFAULT)))
    test = FO.train_test_split(feats, DEFAULT.test_days).filter(~F.col("is_train"))
    return BO.predict(train_production(feats), test)


@register("boosted_predict")
def q_boosted_predict(spark, sf):
    return round_doubles(_predicted(spark, sf).select(
        "drug_code", "date", "quantity_sold", "predicted_demand", "lower_ci", "upper_ci"))


@register("interval_coverage")
def q_interval_coverage(spark, sf):
    """Share of held-out rows inside the 80 % interval, over all brands."""
    inside = F.col("quantity_sold").between(F.col("lower_ci"), F.col("upper_ci")).cast("double")
    return round_doubles(_predicted(spark, sf, "p_brand").groupBy("drug_code").agg(
        F.avg(inside).alias("coverage"), F.count(F.lit(1)).alias("n_rows")))


@register("recursive_forecast")
def q_recursive_forecast(spark, sf):
    feats = _features(spark, sf)
    return round_doubles(RC.forecast_future(train_production(feats), feats, DEFAULT.horizon))


def _full_cv(spark, sf):
    base, boosted = evaluate(_features(spark, sf), DEFAULT)
    return base.unionByName(boosted)


@register("model_comparison_full")
def q_model_comparison_full(spark, sf):
    return round_doubles(E.model_comparison(_full_cv(spark, sf)))


@register("ml_improvement")
def q_ml_improvement(spark, sf):
    return round_doubles(E.ml_improvement(E.model_summary(_full_cv(spark, sf))))


# --- the same operators with stand-ins for the fitted model, checked by SQL ------

@register("boosted_fold_sizes")
def q_boosted_fold_sizes(spark, sf):
    return BO.fold_sizes(_features(spark, sf), DEFAULT)


def _recursion(lag):
    def q(spark, sf):
        rows = RC.recurse(lambda df: df.withColumn("prediction", F.col(f"lag_{lag}")),
                          _features(spark, sf), DEFAULT.horizon)
        return rows.select("drug_code", "date", F.col("__point").alias("predicted_demand"))
    return q


for _lag in (1, 7):
    register(f"recursion_by_lag_{_lag}")(_recursion(_lag))


@register("bounded_predictions")
def q_bounded_predictions(spark, sf):
    """Clamping and "both bounds or none" on a hand-written predictor."""
    f = _features(spark, sf)
    point = F.when(F.col("day_of_week") >= 5, F.col("lag_7") - 400.0).otherwise(F.col("lag_7") * 1.0)
    spread = F.when(F.col("is_month_end") == 0, F.col("lag_1") - F.col("lag_14"))
    return round_doubles(f.select("drug_code", "date", *BO.bounded_prediction(
        point, point - F.abs(spread), F.when(F.col("is_month_start") == 0, point + F.abs(spread)))))


def _stand_in_cv(spark, sf):
    """Baseline CV, and a fourth model whose errors are nine tenths of Naive's."""
    cv = _pipeline_series_cv(spark, sf)
    return cv.unionByName(cv.filter(F.col("model_name") == NAIVE).withColumns(
        {"model_name": F.lit(BOOSTED), **{c: F.col(c) * 0.9 for c in ("mae", "rmse", "mape")}}))


@register("comparison_stand_in")
def q_comparison_stand_in(spark, sf):
    return round_doubles(E.model_comparison(_stand_in_cv(spark, sf)))


@register("improvement_stand_in")
def q_improvement_stand_in(spark, sf):
    return round_doubles(E.ml_improvement(E.model_summary(_stand_in_cv(spark, sf))))
