"""demand_engine: daily demand forecasting over many item series, on Spark."""

from .config import DEFAULT, ForecastConfig
from .session import ensure_checkpoint_dir, get_spark

__all__ = ["DEFAULT", "ForecastConfig", "ensure_checkpoint_dir", "get_spark"]
