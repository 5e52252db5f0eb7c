"""Boosted-tree demand model, interval model, prediction and walk-forward CV.

One pooled Spark ML ``GBTRegressor`` is fitted over all series at once: a fit is
a distributed job whose cost is nearly flat in the number of series, while a
fit per series would be a driver loop over series. Two scale features (mean and
spread of the series' history before the row) tell the trees which level a
series is on.

Training table: one frame, assembled and written once, holds every row's vector,
label and its role (train, valid, test) in each fit; the walk-forward folds, the
production model and the interval models all read it.

Rounds: up to ``gbt_max_iter`` with a patience of ``gbt_patience`` on the
validation rows. Spark ML's own early stop has no patience, so the ensemble grows
in chunks of ``gbt_chunk_rounds``: the first is fitted on the label, each later one
on the residuals of all before it, a column that is brought up to date once per
chunk. No round is fitted twice. (A chunk's first tree has weight 1, as the first
tree of any Spark ML ensemble, the others the step size.) The validation error of
every prefix comes from ``evaluateEachIteration``; the best prefix of the joined
chunks is kept.

Interval: one ensemble for each bound, boosted under the pinball loss of its
quantile. A round fits a small tree to the sign of the residuals (the loss's
gradient) and gives each leaf the quantile of its rows' residuals
(``percentile_approx``, a mergeable sketch: a leaf holding a third of all rows never
lands whole in one task), shrunk by the step. The prefix with the least pinball
loss on the validation rows is kept.

Scoring is one ``model.transform`` in the JVM for the point and one for each bound,
whatever the number of trees; the leaf tables (``quantile_rounds`` x 2 ** depth rows
at most) are literal maps.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import SparkContext, StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (GBTRegressionModel, GBTRegressor, RandomForestRegressionModel,
                                   RandomForestRegressor)
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import BOOSTED, DEFAULT, ForecastConfig
from ..functions.metrics import error_metrics
from ..session import ensure_checkpoint_dir, write_once
from .features import feature_names, series_window, with_order_key
from .folds import train_test_split, with_position

LABEL = "__label"
SCALE_FEATURES = ("series_mean", "series_std")


def with_scale(features: DataFrame) -> DataFrame:
    """Add the series' mean and spread over all rows before the current one
    (0 on the first rows), in the series window the features already use."""
    if set(SCALE_FEATURES) <= set(features.columns):
        return features
    before = series_window().rowsBetween(Window.unboundedPreceding, -1)
    q = F.col("quantity_sold")
    return with_order_key(features).withColumns({
        "series_mean": F.coalesce(F.avg(q).over(before), F.lit(0.0)),
        "series_std": F.coalesce(F.stddev_samp(q).over(before), F.lit(0.0))})


def model_columns(cfg: ForecastConfig = DEFAULT) -> list[str]:
    """Columns the boosted model reads: the feature frame and the scale."""
    return [*feature_names(cfg), *SCALE_FEATURES]


def assembled(df: DataFrame, cols: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep").transform(df)


@dataclass
class QuantileModel:
    """A bound: ``start`` plus each tree's value for the row's leaf."""

    forest: RandomForestRegressionModel        # the trees, in the order of the rounds
    leaves: list[tuple[int, int, float]]       # tree, leaf, value: rounds x 2 ** depth at most
    start: float
    losses: list[float]                        # validation loss before and after every round


@dataclass
class IntervalModel:
    lower: QuantileModel
    upper: QuantileModel


@dataclass
class BoostedModels:
    point: GBTRegressionModel
    interval: IntervalModel | None
    feature_cols: list[str]
    series: str | None = None  # fingerprint of the series set it was trained on
    rounds: int = 0            # rounds fitted before the best prefix was kept

    @property
    def has_interval(self) -> bool:
        return self.interval is not None


def _labelled(df: DataFrame, cols: list[str], *extra: str) -> DataFrame:
    """``(features, label)`` rows; rows of the training table have both already."""
    if "features" not in df.columns:
        df = assembled(df.withColumn(LABEL, F.col("quantity_sold").cast("double")), cols)
    return df.select("features", LABEL, *extra)


def training_table(features: DataFrame, cfg: ForecastConfig = DEFAULT, n_folds: int | None = None,
                   test_days: int | None = None, min_train: int | None = None,
                   parity: bool = False) -> DataFrame:
    """Every feature row as (series, date, quantity, label, vector) with its role in
    each fit, written once.

    ``fold_k`` (1 = earliest): a fold trains on the rows before each series' own test
    window; its last ``test_days`` training rows are for validation. ``parity=True``
    validates on the scored window itself, as the original does (optimistic).
    ``production``: all but the last ``test_days`` days train, those validate.
    ``interval``: of the production's training rows the last ``test_days`` validate.
    """
    nf, T = n_folds or cfg.cv_folds, test_days or cfg.test_days
    mt = cfg.min_history_days if min_train is None else min_train
    series = Window.partitionBy("drug_code")
    rows = train_test_split(with_position(with_scale(features)), T).withColumn(
        "n_train", F.count_if("is_train").over(series))
    idx, roles = F.col("idx"), {}
    for k in range(1, nf + 1):
        start = F.col("n") - k * T
        role = F.when((start < mt) | (idx >= start + T), None).when(idx >= start, "test")
        if not parity:
            role = role.when(idx >= start - T, "valid")
        roles[f"fold_{nf + 1 - k}"] = role.otherwise("train")
    roles["production"] = F.when(F.col("is_train"), "train").otherwise("valid")
    roles["interval"] = F.when(~F.col("is_train"), None).when(
        idx >= F.col("n_train") - T, "valid").otherwise("train")
    rows = rows.withColumns({LABEL: F.col("quantity_sold").cast("double"), **roles})
    return write_once(assembled(rows, model_columns(cfg)).select(
        "drug_code", "date", "quantity_sold", LABEL, "features", *roles))


def part_of(table: DataFrame, fit: str, parity: bool = False) -> DataFrame:
    """Training and validation rows of one fit, flagged ``__valid``."""
    valid = "test" if parity else "valid"
    return table.filter(F.col(fit).isin("train", valid)).withColumn("__valid", F.col(fit) == valid)


def best_prefix(errors: Sequence[float], patience: int) -> tuple[int, bool]:
    """(trees to keep, whether the patience rule stopped): the prefix with the
    lowest error, scanning until ``patience`` rounds bring nothing better."""
    best_k, best = 1, float("inf")
    for k, error in enumerate(errors, 1):
        if error < best:
            best_k, best = k, error
        elif k - best_k >= patience:
            return best_k, True
    return best_k, False


def _java_array(kind, items):
    array = SparkContext._active_spark_context._gateway.new_array(kind, len(items))
    for i, item in enumerate(items):
        array[i] = item
    return array


def _ml():  # also from a worker thread
    jvm = SparkContext._active_spark_context._gateway.jvm
    return jvm, jvm.org.apache.spark.ml.regression


def joined(chunks: Sequence[GBTRegressionModel], n: int) -> GBTRegressionModel:
    """One model of the first ``n`` trees of the chunks, in order."""
    jvm, ml = _ml()
    trees = [tree for chunk in chunks for tree in chunk._java_obj.trees()][:n]
    weights = [float(w) for chunk in chunks for w in chunk.treeWeights][:n]
    java = chunks[0]._java_obj
    model = GBTRegressionModel(ml.GBTRegressionModel(
        java.uid(), _java_array(ml.DecisionTreeRegressionModel, trees),
        _java_array(jvm.double, weights), java.numFeatures()))
    return model.setFeaturesCol("features").setPredictionCol("prediction")


def first_trees(model: GBTRegressionModel, n: int) -> GBTRegressionModel:
    """The model made of the first ``n`` trees."""
    return model if n >= model.getNumTrees else joined([model], n)


def fit_point(train: DataFrame, cfg: ForecastConfig = DEFAULT, cols: list[str] | None = None,
              validation_col: str | None = None) -> tuple[GBTRegressionModel, int]:
    """(model, rounds fitted). Without a validation column all rounds are kept.

    The narrow (vector, residual) frame is persisted while a chunk is fitted; the
    next one is derived from it by one pass of the chunk's model. Its lineage is a
    chain of at most ``gbt_max_iter / gbt_chunk_rounds`` such passes.
    """
    cols = cols or model_columns(cfg)
    flag = F.col(validation_col).cast("boolean") if validation_col else F.lit(False)
    rows = _labelled(train.withColumn("__held", flag), cols, "__held").withColumnRenamed(
        LABEL, "__residual").persist(StorageLevel.MEMORY_AND_DISK)
    chunks, errors, fitted = [], [], 0
    try:
        while True:
            rounds = min(cfg.gbt_chunk_rounds, cfg.gbt_max_iter - fitted)
            chunk = GBTRegressor(
                featuresCol="features", labelCol="__residual", maxIter=rounds, maxBins=32,
                maxDepth=cfg.gbt_max_depth, stepSize=cfg.gbt_step_size,
                subsamplingRate=cfg.gbt_subsampling_rate, checkpointInterval=-1,
                featureSubsetStrategy=cfg.gbt_feature_subset, seed=cfg.gbt_seed + fitted
            ).fit(rows.filter(~F.col("__held")).select("features", "__residual"))
            chunks.append(chunk)
            fitted += rounds
            keep, stopped = fitted, False
            if validation_col:
                held = rows.filter("__held").select("features", "__residual")
                errors += chunk.evaluateEachIteration(held, "squared")
                keep, stopped = best_prefix(errors, cfg.gbt_patience)
            if stopped or fitted >= cfg.gbt_max_iter:
                return joined(chunks, keep), fitted
            later = chunk.transform(rows).select(
                "features", (F.col("__residual") - F.col("prediction")).alias("__residual"),
                "__held").persist(StorageLevel.MEMORY_AND_DISK)
            later.count()
            rows.unpersist()
            rows = later
    finally:
        rows.unpersist()


def _with_leaves(df: DataFrame, forest: RandomForestRegressionModel, out: str) -> DataFrame:
    """Add ``out``: the leaf each tree of ``forest`` puts the row's ``features`` in."""
    forest = forest.setFeaturesCol("features").setLeafCol("__vector").setPredictionCol("__mean")
    return (forest.transform(df).withColumn(out, vector_to_array("__vector").cast("array<int>"))
            .drop("__vector", "__mean"))


def _leaf_value(leaves: Sequence[tuple[int, int, float]], column: str) -> Column:
    """Sum over the trees of the value of the row's leaf."""
    table = F.create_map(*[F.lit(x) for tree, leaf, value in leaves
                           for x in ((tree << 16) + leaf, float(value))])
    values = F.transform(column, lambda leaf, tree: F.coalesce(
        F.try_element_at(table, F.shiftleft(tree, 16) + leaf), F.lit(0.0)))
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def leaf_quantiles(rows: DataFrame, leaf: str, residual: Column, alpha: float) -> DataFrame:
    """``(leaf, value)``: the quantile of the residuals in each leaf."""
    return rows.groupBy(leaf).agg(F.percentile_approx(residual, alpha, 10000).alias("value"))


def pinball_loss(error: Column, alpha: float) -> Column:
    """Mean pinball loss of ``error`` = actual - bound."""
    return F.avg(F.greatest(alpha * error, (alpha - 1) * error))


def fit_quantile(rows: DataFrame, alpha: float, cfg: ForecastConfig = DEFAULT,
                 cols: list[str] | None = None, validation_col: str | None = None) -> QuantileModel:
    """Boost the pinball loss of ``alpha``; without a validation column every round
    is kept."""
    cols = cols or model_columns(cfg)
    flag = F.col(validation_col).cast("boolean") if validation_col else F.lit(False)
    error = F.col(LABEL) - F.col("__bound")
    used = ~F.col("__held")
    state = _labelled(rows.withColumn("__held", flag), cols, "__held").persist(
        StorageLevel.MEMORY_AND_DISK)
    start = float(state.filter(used).agg(
        F.percentile_approx(LABEL, alpha, 10000)).first()[0] or 0.0)
    ensure_checkpoint_dir(rows.sparkSession)
    held = state
    state = state.withColumn("__bound", F.lit(start))
    trees, leaves, losses = [], [], []
    best, stopped = 0, False
    if validation_col:
        losses = [state.filter("__held").agg(pinball_loss(error, alpha)).first()[0] or 0.0]
    try:
        while len(trees) < cfg.quantile_rounds and not stopped:
            k = len(trees)
            gradient = F.when(error > 0, F.lit(alpha)).otherwise(F.lit(alpha - 1)).alias("__g")
            forest = RandomForestRegressor(
                featuresCol="features", labelCol="__g", numTrees=1, bootstrap=False, maxBins=32,
                subsamplingRate=cfg.gbt_subsampling_rate, seed=cfg.gbt_seed + k,
                featureSubsetStrategy=cfg.gbt_feature_subset, maxDepth=cfg.quantile_tree_depth,
                minInstancesPerNode=cfg.quantile_min_instances
            ).fit(state.filter(used).select("features", gradient))
            placed = _with_leaves(state, forest, "__leaves")
            table = leaf_quantiles(placed.filter(used).withColumn("leaf", F.col("__leaves")[0]),
                                   "leaf", error, alpha).orderBy("leaf").collect()
            shift = [(0, r.leaf, cfg.quantile_step * r.value) for r in table]
            later = placed.select("features", LABEL, "__held", (
                F.col("__bound") + _leaf_value(shift, "__leaves")).alias("__bound"))
            later = (later.checkpoint(eager=True) if (k + 1) % cfg.checkpoint_every == 0
                     else later.persist(StorageLevel.MEMORY_AND_DISK))
            trees.append(forest._java_obj.trees()[0])
            leaves += [(k, leaf, value) for _, leaf, value in shift]
            best = k + 1
            if validation_col:
                losses.append(later.filter("__held").agg(pinball_loss(error, alpha)).first()[0] or 0.0)
                kept, stopped = best_prefix(losses, cfg.quantile_patience)
                best = kept - 1
            else:
                later.count()
            held.unpersist()
            state = held = later
    finally:
        held.unpersist()
    jvm, ml = _ml()
    n = max(best, 1)  # a forest needs a tree; without a gain its leaves count nothing
    model = RandomForestRegressionModel(ml.RandomForestRegressionModel(
        forest._java_obj.uid(), _java_array(ml.DecisionTreeRegressionModel, trees[:n]),
        forest._java_obj.numFeatures()))
    model._java_obj.set(model._java_obj.numTrees(), n)  # what a saved forest is checked against
    return QuantileModel(model, [x if best else (*x[:2], 0.0) for x in leaves if x[0] < n], start,
                         losses)


def fit_interval_model(train: DataFrame, cfg: ForecastConfig = DEFAULT, cols: list[str] | None = None,
                       validation_col: str | None = None) -> IntervalModel:
    """Both bounds; the two ensembles are independent jobs and are fitted together."""
    with ThreadPoolExecutor(max_workers=2) as pool:
        return IntervalModel(*pool.map(
            lambda alpha: fit_quantile(train, alpha, cfg, cols, validation_col),
            (cfg.interval_alpha_low, cfg.interval_alpha_high)))


def train_models(train: DataFrame, cfg: ForecastConfig = DEFAULT,
                 validation_col: str | None = None, with_interval: bool = True) -> BoostedModels:
    cols = model_columns(cfg)
    point, rounds = fit_point(train, cfg, cols, validation_col)
    interval = fit_interval_model(train, cfg, cols) if with_interval else None
    return BoostedModels(point, interval, cols, rounds=rounds)


def bounded_prediction(point: Column, lower: Column | None = None,
                       upper: Column | None = None) -> list[Column]:
    """The three output columns: nothing below 0, and both bounds or none."""
    none = F.lit(None).cast("double")
    both = (lower.isNotNull() & upper.isNotNull()) if lower is not None and upper is not None else None
    floor = lambda c: F.greatest(F.lit(0.0), c)
    return [floor(point).alias("predicted_demand"),
            (none if both is None else F.when(both, floor(lower))).alias("lower_ci"),
            (none if both is None else F.when(both, floor(upper))).alias("upper_ci")]


def predict_point(models: BoostedModels, df: DataFrame) -> DataFrame:
    """Add ``prediction`` (not clamped)."""
    return models.point.transform(assembled(df, models.feature_cols)).drop("features")


def predict(models: BoostedModels, df: DataFrame) -> DataFrame:
    """Add ``predicted_demand`` and, when an interval model exists,
    ``lower_ci``/``upper_ci`` (NULL otherwise); see :func:`bounded_prediction`."""
    keep = [c for c in df.columns if c not in ("features", "prediction")]
    out = models.point.transform(df if "features" in df.columns
                                 else assembled(df, models.feature_cols))
    bounds = []
    if models.has_interval:
        for name, side in (("__lower", models.interval.lower), ("__upper", models.interval.upper)):
            out = _with_leaves(out, side.forest, name)
            bounds.append(F.lit(side.start) + _leaf_value(side.leaves, name))
    return out.select(*keep, *bounded_prediction(F.col("prediction"), *bounds))


def fold_names(table: DataFrame) -> dict[int, str]:
    """Folds of a training table that have training and test rows."""
    names = [c for c in table.columns if c.startswith("fold_")]
    if not names:
        return {}
    row = table.agg(*[(F.count_if(F.col(c) == "train") * F.count_if(F.col(c) == "test")).alias(c)
                      for c in names]).first()
    return {int(c.removeprefix("fold_")): c for c in names if row[c]}


def fold_sizes(features: DataFrame, cfg: ForecastConfig = DEFAULT) -> DataFrame:
    """``(drug_code, fold, n_train, n_valid, n_test)`` of the boosted folds."""
    table = training_table(features, cfg)
    folds = fold_names(table)
    by_fold = F.explode(F.array(*[F.struct(F.lit(k).alias("fold"), F.col(c).alias("role"))
                                  for k, c in folds.items()])) if folds else None
    if by_fold is None:
        return features.sparkSession.createDataFrame(
            [], "drug_code string, fold int, n_train long, n_valid long, n_test long")
    return (table.select("drug_code", by_fold.alias("f")).select("drug_code", "f.*")
            .filter("role IS NOT NULL").groupBy("drug_code", "fold")
            .agg(*[F.count_if(F.col("role") == r).alias(f"n_{r}") for r in ("train", "valid", "test")]))


def fold_predictions(table: DataFrame, cfg: ForecastConfig = DEFAULT,
                     parity: bool = False) -> DataFrame | None:
    """``(drug_code, fold, actual, predicted, n_trees, n_rounds)`` of every test row:
    one pooled fit per fold, all over the same table; None without a fold."""
    cols = model_columns(cfg)

    def scored(item):
        fold, name = item
        point, rounds = fit_point(part_of(table, name, parity), cfg, cols, "__valid")
        test = table.filter(F.col(name) == "test")
        return predict(BoostedModels(point, None, cols), test).select(
            "drug_code", F.lit(fold).alias("fold"), F.col("quantity_sold").alias("actual"),
            F.col("predicted_demand").alias("predicted"),
            F.lit(point.getNumTrees).alias("n_trees"), F.lit(rounds).alias("n_rounds"))

    folds = fold_names(table)
    if not folds:
        return None
    # the fold fits are independent jobs: submit them together
    with ThreadPoolExecutor(max_workers=len(folds)) as pool:
        parts = list(pool.map(scored, folds.items()))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


def walk_forward_validate(features: DataFrame, cfg: ForecastConfig = DEFAULT,
                          n_folds: int | None = None, test_days: int | None = None,
                          min_train: int | None = None, parity: bool = False,
                          table: DataFrame | None = None) -> DataFrame:
    """Boosted walk-forward CV: metrics per (series, fold). See :func:`training_table`."""
    if table is None:
        table = training_table(features, cfg, n_folds, test_days, min_train, parity)
    rows = fold_predictions(table, cfg, parity)
    if rows is None:
        schema = ("drug_code string, fold int, mae double, rmse double, mape double, n_test long, "
                  "n_trees int, n_rounds int")
        return table.sparkSession.createDataFrame([], schema).withColumn(
            "model_name", F.lit(BOOSTED))
    return rows.groupBy("drug_code", "fold").agg(
        *error_metrics("actual", "predicted"), F.count(F.lit(1)).alias("n_test"),
        F.max("n_trees").alias("n_trees"), F.max("n_rounds").alias("n_rounds")).withColumn(
        "model_name", F.lit(BOOSTED))


def boosted_cv_summary(fold_metrics: DataFrame) -> DataFrame:
    return (fold_metrics.groupBy("drug_code", "model_name")
            .agg(F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"),
                 F.avg("mape").alias("mape"), F.count(F.lit(1)).alias("n_folds")))


def feature_importances(models: BoostedModels, spark: SparkSession) -> DataFrame:
    """Importance per feature, with the rounds fitted and the trees kept."""
    imp = models.point.featureImportances.toArray().tolist()
    imp += [0.0] * (len(models.feature_cols) - len(imp))
    return spark.createDataFrame(
        [(c, float(v), models.point.getNumTrees, models.rounds)
         for c, v in zip(models.feature_cols, imp)],
        "feature string, importance double, n_trees int, n_rounds int")


# ---------------------------------------------------------------------------
# persistence: a version is a folder, and counts once its record is written
# ---------------------------------------------------------------------------

def _versions(spark: SparkSession, path: str) -> list[tuple[int, bool]]:
    """(number, finished) of the saved versions, newest last."""
    Path = spark._jvm.org.apache.hadoop.fs.Path
    base = Path(path)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return []
    folders = [st.getPath() for st in fs.listStatus(base)]
    return sorted((int(f.getName()[2:]), fs.exists(Path(f, "meta/_SUCCESS")))
                  for f in folders if f.getName().startswith("v="))


def save_models(models: BoostedModels, path: str, spark: SparkSession | None = None) -> str:
    """Save all parts into a new version folder, the record last: a save that was
    cut short is never loaded, and the version before it stays whole."""
    spark = spark or SparkSession.getActiveSession()
    found = _versions(spark, path)
    folder = f"{path}/v={found[-1][0] + 1 if found else 1}"
    models.point.write().save(f"{folder}/point")
    meta = {"feature_cols": models.feature_cols, "series": models.series, "rounds": models.rounds}
    if models.has_interval:
        for name in ("lower", "upper"):
            side = getattr(models.interval, name)
            side.forest.write().save(f"{folder}/{name}")
            meta[name] = [side.leaves, side.start, side.losses]
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.text(f"{folder}/meta")
    return folder


def load_models(spark: SparkSession, path: str, cfg: ForecastConfig = DEFAULT,
                series: str | None = None) -> BoostedModels:
    """Load the newest finished version; none, or a feature/series list that no
    longer matches, raises FileNotFoundError so the caller retrains."""
    finished = [v for v, done in _versions(spark, path) if done]
    if not finished:
        raise FileNotFoundError(f"no saved model under {path}")
    folder = f"{path}/v={finished[-1]}"
    meta = json.loads(spark.read.text(f"{folder}/meta").first()[0])
    if meta.get("feature_cols") != model_columns(cfg):
        raise FileNotFoundError("saved model was trained on other features")
    if series is not None and meta.get("series") is not None and meta["series"] != series:
        raise FileNotFoundError("saved model was trained on other series")
    sides = []
    for name in ("lower", "upper"):
        if name in meta:
            leaves, start, losses = meta[name]
            sides.append(QuantileModel(RandomForestRegressionModel.load(f"{folder}/{name}"),
                                       [tuple(x) for x in leaves], start, losses))
    return BoostedModels(GBTRegressionModel.load(f"{folder}/point"),
                         IntervalModel(*sides) if sides else None, meta["feature_cols"],
                         meta.get("series"), meta["rounds"])
