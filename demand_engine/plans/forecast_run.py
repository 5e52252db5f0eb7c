"""One forecasting run for every series: evaluate, train (or load), forecast, store.

No step loops over series on the driver: features, both cross-validations,
the fits and the recursive forecast each handle all series at once. The
feature frame is persisted once (split, CV, training and the forecast tail
all read it); the caller releases it with ``result.features.unpersist()``.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BOOSTED, DEFAULT, ForecastConfig
from ..operators import baselines as B
from ..operators import boosted as BO
from ..operators import evaluation as E
from ..operators import features as FE
from ..operators import folds as FO
from ..operators import recursive as RC
from ..sources.store import ParquetStore
from ..sources.wide import item_metadata


@dataclass
class RunResult:
    features: DataFrame
    baseline_cv: DataFrame
    boosted_cv: DataFrame
    comparison: DataFrame
    summary: DataFrame
    improvement: DataFrame
    models: BO.BoostedModels
    forecasts: DataFrame
    totals: DataFrame


def eligible_features(sales: DataFrame, cfg: ForecastConfig = DEFAULT) -> DataFrame:
    """Feature frame of the series with at least ``min_history_days`` rows.

    It keeps the series order key, so the folds, CV windows and the forecast
    tail computed from it reuse its partitioning and sort order.
    """
    return FO.min_history(FE.engineer_features(sales, cfg, keep_order_key=True),
                          cfg.min_history_days)


def evaluate(features: DataFrame, cfg: ForecastConfig = DEFAULT, table: DataFrame | None = None):
    """(baseline cv, boosted cv) on the same positional folds.

    Baselines need 30 training rows per fold, the boosted model 90; as in the
    original, only series with at least one boosted fold enter the comparison.
    """
    boosted_folds = BO.walk_forward_validate(features, cfg, table=table)
    boosted = BO.boosted_cv_summary(boosted_folds)
    base = B.evaluate_baselines_cv(features, cfg.cv_folds, cfg.test_days, cfg)
    base = base.join(boosted.select("drug_code"), "drug_code", "left_semi")
    return base, boosted


def train_production(features: DataFrame, cfg: ForecastConfig = DEFAULT,
                     table: DataFrame | None = None) -> BO.BoostedModels:
    """Point + interval models on all but the last ``test_days`` days of each
    series; the held-out days drive early stopping of the point model (as in the
    original), the last days of the training part that of the bounds."""
    if table is None:
        table = BO.training_table(features, cfg)
    cols = BO.model_columns(cfg)
    with ThreadPoolExecutor(max_workers=2) as pool:
        point = pool.submit(BO.fit_point, BO.part_of(table, "production"), cfg, cols, "__valid")
        interval = pool.submit(BO.fit_interval_model, BO.part_of(table, "interval"), cfg, cols,
                               "__valid")
        fitted = interval.result()
        model, rounds = point.result()
        return BO.BoostedModels(model, fitted, cols, rounds=rounds)


def series_fingerprint(features: DataFrame) -> str:
    """Order-free fingerprint of the series set (count and XOR of hashes),
    computed by Spark; a saved model trained on another set is not reused."""
    row = (features.select("drug_code").distinct()
           .agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("drug_code")).alias("x"))
           .first())
    return f"{row['n']}:{row['x']}"


def load_or_train(features: DataFrame, cfg: ForecastConfig, model_path: str | None,
                  retrain: bool, table: DataFrame | None = None) -> BO.BoostedModels:
    spark = features.sparkSession
    series = series_fingerprint(features) if model_path else None
    if model_path and not retrain:
        try:
            return BO.load_models(spark, model_path, cfg, series)
        except FileNotFoundError:
            pass
    models = train_production(features, cfg, table)
    if model_path:
        models.series = series
        BO.save_models(models, model_path, spark)
    return models


def forecast_through_store(sales: DataFrame, predictor: Callable[[DataFrame], DataFrame],
                           store: ParquetStore, model_name: str, run_timestamp: _dt.datetime,
                           cfg: ForecastConfig = DEFAULT) -> DataFrame:
    """Load sales, build features, forecast recursively and append the run, with any
    function that adds a ``prediction`` column in place of a fitted model."""
    store.upsert_items(item_metadata(sales))
    store.upsert_sales(sales)
    steps = RC.recurse(predictor, eligible_features(sales, cfg), cfg.horizon, cfg)
    forecasts = steps.select("drug_code", "date", *BO.bounded_prediction(F.col("__point")))
    return store.append_forecasts(forecasts, model_name, run_timestamp)


def run_forecast(sales: DataFrame, cfg: ForecastConfig = DEFAULT, store: ParquetStore | None = None,
                 model_path: str | None = None, retrain: bool = False,
                 run_timestamp: _dt.datetime | None = None) -> RunResult:
    if store is not None:
        store.upsert_items(item_metadata(sales))
        store.upsert_sales(sales)
    features = eligible_features(sales, cfg).persist(StorageLevel.MEMORY_AND_DISK)
    # evaluation fits and production fits are independent jobs over one training table
    table = BO.training_table(features, cfg)
    with ThreadPoolExecutor(max_workers=2) as pool:
        evaluated = pool.submit(evaluate, features, cfg, table)
        trained = pool.submit(load_or_train, features, cfg, model_path, retrain, table)
        base_cv, boosted_cv = evaluated.result()
        models = trained.result()
    # three reports read the CV tables (one row per series and model): keep them
    base_cv = base_cv.persist(StorageLevel.MEMORY_AND_DISK)
    boosted_cv = boosted_cv.persist(StorageLevel.MEMORY_AND_DISK)
    comparison = E.model_comparison(base_cv.unionByName(boosted_cv))
    summary = E.model_summary(base_cv.unionByName(boosted_cv))
    improvement = E.ml_improvement(summary, BOOSTED)
    forecasts = RC.forecast_future(models, features, cfg.horizon, cfg)
    if store is not None:
        ts = run_timestamp or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
        store.append_forecasts(forecasts, BOOSTED, ts)
    totals = forecasts.agg(F.countDistinct("drug_code").alias("series_forecast"),
                           F.count(F.lit(1)).alias("forecasts_generated"))
    return RunResult(features, base_cv, boosted_cv, comparison, summary, improvement,
                     models, forecasts, totals)
