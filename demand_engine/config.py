"""Run configuration: one frozen dataclass instead of environment lookups."""

from __future__ import annotations

from dataclasses import dataclass, field

# Canonical column names of the long sales frame.
SERIES = "drug_code"
DATE = "date"
TARGET = "quantity_sold"

# Model names as stored in the forecast history and shown in the
# comparison tables, in their fixed display order.
NAIVE = "Naive"
MOVING_AVERAGE = "Moving Average"
SEASONAL_NAIVE = "Seasonal Naive"
BOOSTED = "Boosted Trees"
MODEL_ORDER = (NAIVE, MOVING_AVERAGE, SEASONAL_NAIVE, BOOSTED)
# Label under which runs of the earlier system stored their boosted model; read
# as BOOSTED, never written.
LEGACY_LABELS = {"LightGBM": BOOSTED}


@dataclass(frozen=True)
class ForecastConfig:
    """Defaults follow the original system's configuration."""

    lags: tuple[int, ...] = (1, 7, 14, 30)
    rolling_windows: tuple[int, ...] = (7, 14, 30)
    horizon: int = 30
    holiday_country: str = "MK"
    min_history_days: int = 90
    cv_folds: int = 3
    test_days: int = 30
    baseline_min_train: int = 30
    ma_window: int = 7
    season_length: int = 7
    interval_alpha_low: float = 0.1
    interval_alpha_high: float = 0.9
    zero_fraction_warn: float = 0.10
    # Pooled gradient-boosted trees (Spark ML) standing in for per-series boosting;
    # the original's settings where Spark ML has them: learning rate 0.05, 90 % of
    # the features (per node here, per tree there), 80 % of the rows, at most 32
    # leaves (depth 5; the original allows 31), early stop on a validation set.
    gbt_max_iter: int = 1000
    gbt_patience: int = 50
    # Rounds of one fit. Further chunks of as many rounds are fitted on the residuals
    # of those before until the patience rule stops (or the maximum is reached).
    gbt_chunk_rounds: int = 30
    gbt_max_depth: int = 5
    gbt_step_size: float = 0.05
    gbt_subsampling_rate: float = 0.8
    gbt_feature_subset: str = "0.9"
    gbt_seed: int = 42
    # Interval models: pinball boosting, one small tree a round, for each bound.
    quantile_rounds: int = 40
    quantile_step: float = 0.2
    quantile_patience: int = 5
    quantile_tree_depth: int = 4
    quantile_min_instances: int = 50
    # Recursion: checkpoint the state frame every n steps to cut lineage.
    checkpoint_every: int = 5
    extra: dict = field(default_factory=dict)


DEFAULT = ForecastConfig()
