import datetime as dt
from dataclasses import replace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from demand_engine.config import DEFAULT
from demand_engine.operators import boosted as BO
from demand_engine.operators import features as FE
from demand_engine.operators import recursive as RC

CFG = replace(DEFAULT, gbt_max_iter=5, gbt_max_depth=3, gbt_chunk_rounds=2, quantile_min_instances=20,
              quantile_tree_depth=3, quantile_rounds=4)


@pytest.fixture(scope="module")
def feats(multi_sales):
    return BO.with_scale(FE.engineer_features(multi_sales.filter("drug_code IN ('GAPS', 'FULL')"), CFG)).cache()


@pytest.fixture(scope="module")
def models(feats):
    return BO.train_models(feats, CFG)


def test_first_trees_are_the_prefix_of_the_ensemble(feats, models):
    data = BO.assembled(feats, models.feature_cols)
    cut = BO.first_trees(models.point, 3)
    assert cut.getNumTrees == 3 and models.point.getNumTrees == 5
    weights, trees = models.point.treeWeights, models.point.trees
    out = data.withColumn("y", F.lit(0.0))
    for i in range(3):
        t = trees[i].setPredictionCol(f"t{i}").setFeaturesCol("features")
        out = t.transform(out).withColumn("y", F.col("y") + weights[i] * F.col(f"t{i}"))
    out = cut.transform(out)
    assert out.select(F.max(F.abs(F.col("y") - F.col("prediction")))).first()[0] < 1e-9


def test_scoring_many_trees_stays_a_model_call(feats, models):
    plan = BO.predict(models, feats)._jdf.queryExecution().executedPlan().toString()
    assert "CASE WHEN (rolling" not in plan and len(plan) < 60_000


def test_interval_both_or_none(feats, models):
    with_int = BO.predict(models, feats)
    assert with_int.filter(F.col("lower_ci").isNull() | F.col("upper_ci").isNull()).count() == 0
    no_int = BO.predict(BO.BoostedModels(models.point, None, models.feature_cols), feats)
    assert no_int.filter(F.col("lower_ci").isNotNull() | F.col("upper_ci").isNotNull()).count() == 0
    assert with_int.filter((F.col("lower_ci") < 0) | (F.col("predicted_demand") < 0)).count() == 0
    assert with_int.filter("lower_ci > upper_ci").count() < 0.02 * with_int.count()


def test_leaf_tables_are_bounded(models):
    for side in (models.interval.lower, models.interval.upper):
        assert 0 < len(side.leaves) <= CFG.quantile_rounds * 2 ** CFG.quantile_tree_depth
        assert len({t for t, *_ in side.leaves}) == len(side.forest.trees)


def test_one_round_of_leaves_row_by_row(spark, feats):
    """The first round's leaf values against DuckDB over the rows themselves."""
    import duckdb
    cfg = replace(CFG, quantile_rounds=1, quantile_step=0.5)
    for alpha in (0.1, 0.9):
        model = BO.fit_quantile(feats, alpha, cfg)
        rows = BO._with_leaves(BO.assembled(feats, BO.model_columns(cfg)), model.forest, "leaves").select(
            F.col("leaves")[0].alias("leaf"), F.col("quantity_sold").alias("y")).toPandas()  # noqa: F841
        [(start,)] = duckdb.sql(f"SELECT quantile_disc(y, {alpha}) FROM rows").fetchall()
        assert start == model.start
        want = duckdb.sql(f"SELECT leaf, 0.5 * quantile_disc(y - {start}, {alpha}) FROM rows GROUP BY leaf"
                          ).fetchall()
        assert sorted((leaf, value) for _, leaf, value in model.leaves) == sorted(
            (leaf, float(value)) for leaf, value in want)


def test_bounds_are_the_sum_of_their_trees(feats, models):
    data = BO.assembled(feats, models.feature_cols)
    side = models.interval.upper
    table = {(t, leaf): v for t, leaf, v in side.leaves}
    for r in BO._with_leaves(data, side.forest, "leaves").withColumn(
            "bound", F.lit(side.start) + BO._leaf_value(side.leaves, "leaves")).limit(50).collect():
        assert r.bound == pytest.approx(side.start + sum(table[t, leaf] for t, leaf in enumerate(r.leaves)))


def test_intervals_cover_rows_whose_spread_differs(spark):
    """Noise that grows with the series level: each series' held-out rows lie inside
    an 80 % interval about 80 % of the time, and the widths follow the noise."""
    import numpy as np
    rng = np.random.default_rng(11)
    rows = [(dt.date(2019, 1, 1) + dt.timedelta(days=i), code, max(0, int(rng.normal(level, spread))))
            for code, level, spread in (("CALM", 300, 5), ("MID", 500, 40), ("WILD", 900, 120))
            for i in range(900)]
    sales = spark.createDataFrame(rows, "date date, drug_code string, quantity_sold int")
    cfg = replace(DEFAULT, gbt_max_iter=10, gbt_chunk_rounds=10, test_days=120)
    table = BO.training_table(FE.engineer_features(sales, cfg), cfg)
    fitted = BO.fit_interval_model(BO.part_of(table, "interval"), cfg, None, "__valid")
    for side in (fitted.lower, fitted.upper):
        assert min(side.losses) < side.losses[0] / 2
    point, _ = BO.fit_point(BO.part_of(table, "production"), cfg, None, "__valid")
    held = table.filter("production = 'valid'")
    got = {r.drug_code: r for r in BO.predict(BO.BoostedModels(point, fitted, BO.model_columns(cfg)), held)
           .groupBy("drug_code").agg(
               F.avg(F.col("quantity_sold").between(F.col("lower_ci"), F.col("upper_ci"))
                     .cast("double")).alias("inside"),
               F.avg(F.col("upper_ci") - F.col("lower_ci")).alias("width")).collect()}
    assert all(0.70 <= r.inside <= 0.90 for r in got.values()), got
    assert 0.75 <= sum(r.inside for r in got.values()) / 3 <= 0.85, got
    assert got["CALM"].width < got["MID"].width / 3 < got["WILD"].width / 3


def _brute_recursion(spark, models, feats_pdf, horizon):
    """The documented recursion, one series, one step at a time."""
    cols = models.feature_cols
    g = feats_pdf.sort_values(["date", "quantity_sold"]).tail(max(CFG.lags))
    store = {d: float(q) for d, q in zip(g["date"], g["quantity_sold"])}
    row = g.iloc[-1][cols].astype(float).to_dict()
    last = g["date"].iloc[-1]
    out = []
    for i in range(1, horizon + 1):
        d = last + dt.timedelta(days=i)
        ts = pd.Timestamp(d)
        row.update(day_of_week=d.weekday(), day_of_month=d.day, month=d.month, quarter=ts.quarter,
                   week_of_year=d.isocalendar()[1], is_weekend=int(d.weekday() >= 5),
                   is_month_start=int(d.day == 1), is_month_end=int(ts.is_month_end))
        for lag in CFG.lags:
            row[f"lag_{lag}"] = store.get(d - dt.timedelta(days=lag), 0.0)
        one = spark.createDataFrame([tuple(float(row[c]) for c in cols)], ", ".join(f"{c} double" for c in cols))
        p = max(0.0, BO.predict(BO.BoostedModels(models.point, None, cols), one).first().predicted_demand)
        store[d] = p
        out.append((d, p))
    return out


def test_recursion_matches_step_by_step(spark, feats, models):
    h = 10
    got = {(r.drug_code, r.date): r.predicted_demand
           for r in RC.forecast_future(models, feats, h, CFG).collect()}
    assert len(got) == 2 * h
    for code in ("GAPS", "FULL"):
        pdf = feats.filter(F.col("drug_code") == code).toPandas()
        for d, p in _brute_recursion(spark, models, pdf, h):
            assert got[(code, d)] == pytest.approx(p, abs=1e-9)


def test_recursion_lags_use_calendar_days_with_zero_for_gaps(spark, feats):
    """Trap T-05: the seed store holds the last 30 rows; a missing day reads 0."""
    state = RC.initial_state(feats.filter("drug_code = 'GAPS'"), CFG).first()
    assert len(state.store) == 30
    span = (max(state.store) - min(state.store)).days
    assert span > 29  # the series has gaps, so 30 rows cover more than 30 days
    days = [state.last_date - dt.timedelta(days=29 - j) for j in range(30)]
    assert state["values"] == [state.store.get(d, 0.0) for d in days]
    assert any(d not in state.store for d in days)


def test_save_and_load_round_trip(spark, tmp_path, models, feats):
    path = str(tmp_path / "models")
    models.series = "2:x"
    BO.save_models(models, path, spark)
    back = BO.load_models(spark, path, CFG, "2:x")
    a = BO.predict(models, feats).agg(F.sum("predicted_demand"), F.sum("lower_ci")).first()
    b = BO.predict(back, feats).agg(F.sum("predicted_demand"), F.sum("lower_ci")).first()
    assert a == b
    with pytest.raises(FileNotFoundError):
        BO.load_models(spark, path, CFG, "3:y")
    with pytest.raises(FileNotFoundError):
        BO.load_models(spark, str(tmp_path / "missing"), CFG)


def test_walk_forward_cv_needs_90_rows(feats):
    rows = BO.walk_forward_validate(feats, CFG).collect()
    by_series = {}
    for r in rows:
        by_series.setdefault(r.drug_code, set()).add(r.fold)
    # FULL: 160 rows -> test windows start at rows 130, 100 (70 < 90 is skipped)
    assert by_series["FULL"] == {2, 3} and by_series["GAPS"] == {1, 2, 3}


def test_pooled_model_learns_additive_patterns(spark):
    """Weekday, month and series effects that add up, noise of +-2: one shallow
    tree cannot hold them all, so the ensemble has to grow, and it beats naive."""
    import numpy as np
    rng = np.random.default_rng(3)
    weekday = [0, 35, 70, 15, 90, 160, 120]
    month = [0, 25, 60, 10, 45, 80, 5, 30, 70, 20, 55, 90]
    rows = []
    for code, level in (("W1", 0), ("W2", 45), ("W3", 110)):
        for i in range(700):
            d = dt.date(2019, 1, 1) + dt.timedelta(days=i)
            q = 100 + level + weekday[d.weekday()] + month[d.month - 1] + int(rng.integers(-2, 3))
            rows.append((d, code, q))
    sales = spark.createDataFrame(rows, "date date, drug_code string, quantity_sold int")
    cfg = replace(DEFAULT, gbt_max_iter=64, gbt_chunk_rounds=16, gbt_patience=8, gbt_max_depth=3,
                  gbt_step_size=0.3)
    split = FE.engineer_features(sales, cfg).join(
        sales.groupBy("drug_code").agg(F.max("date").alias("__m")), "drug_code")
    split = BO.with_scale(split.withColumn("__v", F.col("date") > F.date_sub("__m", 30)).drop("__m"))
    point, rounds = BO.fit_point(split, cfg, None, "__v")
    assert 10 < point.getNumTrees <= rounds <= 64
    test = split.filter("__v")
    scored = BO.predict(BO.BoostedModels(point, None, BO.model_columns(cfg)), test)
    mae = scored.agg(F.avg(F.abs(F.col("quantity_sold") - F.col("predicted_demand")))).first()[0]
    naive_mae = test.agg(F.avg(F.abs(F.col("quantity_sold") - F.col("lag_1")))).first()[0]
    assert mae < naive_mae / 3


def test_best_prefix_rule():
    assert BO.best_prefix([5, 4, 3, 3, 3, 3], 3) == (3, True)
    assert BO.best_prefix([5, 4, 3, 3.5, 2, 3], 3) == (5, False)
    assert BO.best_prefix([1.0], 50) == (1, False)


def test_chunks_go_on_until_patience_stops(spark, feats, tmp_path, monkeypatch):
    cfg = replace(CFG, gbt_max_iter=16, gbt_chunk_rounds=4, gbt_patience=3, gbt_step_size=0.5)
    last = feats.groupBy("drug_code").agg(F.max("date").alias("__m"))
    data = (feats.join(last, "drug_code")
            .withColumn("__v", F.col("date") > F.date_sub("__m", 30)).drop("__m"))
    fits = []

    class Counted(BO.GBTRegressor):
        def fit(self, rows):
            fits.append(self.getMaxIter())
            return super().fit(rows)

    monkeypatch.setattr(BO, "GBTRegressor", Counted)
    model, rounds = BO.fit_point(data, cfg, None, "__v")
    assert sum(fits) == rounds and rounds in (4, 8, 12, 16) and 1 <= model.getNumTrees <= rounds
    # brute force: all rounds without a stop, the error of each prefix from its own trees
    train, valid = data.filter("NOT __v"), data.filter("__v")
    whole, _ = BO.fit_point(train, cfg)
    assert whole.getNumTrees == 16 and sum(fits) == rounds + 16
    mse = []
    for k in range(1, 17):
        scored = BO.predict_point(BO.BoostedModels(BO.first_trees(whole, k), None, BO.model_columns(cfg)), valid)
        mse.append(scored.agg(F.avg((F.col("quantity_sold") - F.col("prediction")) ** 2)).first()[0])
    assert model.getNumTrees == BO.best_prefix(mse, 3)[0]
    joint = whole.evaluateEachIteration(BO._labelled(valid, BO.model_columns(cfg)).withColumnRenamed(
        BO.LABEL, whole.getLabelCol()), "squared")
    assert joint == pytest.approx(mse)
    models = BO.BoostedModels(model, BO.fit_interval_model(data, cfg), BO.model_columns(cfg), "s", rounds)
    BO.save_models(models, str(tmp_path / "m"), spark)
    back = BO.load_models(spark, str(tmp_path / "m"), cfg, "s")
    assert (back.rounds, back.point.getNumTrees) == (rounds, model.getNumTrees)


def test_a_save_that_was_cut_short_is_not_loaded(spark, tmp_path, models, monkeypatch):
    path = str(tmp_path / "models")
    models.series = "2:x"
    first = BO.save_models(models, path, spark)
    monkeypatch.setattr(BO.json, "dumps", lambda _: 1 / 0)  # fails before the record is written
    with pytest.raises(ZeroDivisionError):
        BO.save_models(models, path, spark)
    monkeypatch.undo()
    assert BO._versions(spark, path) == [(1, True), (2, False)] and first.endswith("v=1")
    assert BO.load_models(spark, path, CFG, "2:x").rounds == models.rounds
    assert BO.save_models(models, path, spark).endswith("v=3")
    assert BO.load_models(spark, path, CFG).point.getNumTrees == models.point.getNumTrees


def test_fold_metrics_from_stored_predictions(spark, feats, tmp_path):
    """Every fold reads one table; its metrics are those of the stored predictions."""
    import duckdb
    table = BO.training_table(feats, CFG)
    BO.fold_predictions(table, CFG).write.parquet(str(tmp_path / "p"))
    want = duckdb.sql(f"""SELECT drug_code, fold, avg(abs(actual - predicted)),
        sqrt(avg((actual - predicted) ** 2)), count(*) FROM '{tmp_path}/p/*.parquet' GROUP BY ALL""").fetchall()
    got = BO.walk_forward_validate(feats, CFG, table=table).collect()
    assert sorted((r.drug_code, r.fold, round(r.mae, 6), round(r.rmse, 6), r.n_test) for r in got) == sorted(
        (c, f, round(m, 6), round(s, 6), n) for c, f, m, s, n in want)
    optimistic = BO.walk_forward_validate(feats, CFG, parity=True).collect()
    assert {(r.drug_code, r.fold, r.n_test) for r in optimistic} == {
        (r.drug_code, r.fold, r.n_test) for r in got}
