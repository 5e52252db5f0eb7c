import datetime as dt

import pytest
from pyspark.sql import functions as F

from demand_engine.plans.fixture import demo_store
from demand_engine.sources import store as S


@pytest.fixture(scope="module")
def demo(spark):
    return demo_store(spark, "/root/testdata/sf0.001")


def test_sequential_ids_are_dense_and_ordered(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7 % 5000).alias("k")).repartition(7)
    out = S.with_sequential_id(df, ["k"], 10).collect()
    ids = sorted((r.k, r.id) for r in out)
    assert [i for _, i in ids] == list(range(10, 5010))
    assert S.with_sequential_id(df.limit(0), ["k"]).collect() == []


def test_ids_need_no_window_over_all_rows(spark):
    plan = S.with_sequential_id(spark.range(10).toDF("k"), ["k"])._jdf.queryExecution().toString()
    rows, _, counts = plan.partition("BroadcastExchange")
    assert "SinglePartition" not in rows and "SinglePartition" in counts  # one row per partition


def test_upsert_items_keeps_ids_updates_names_appends_new(spark):
    old = spark.createDataFrame([(5, "B", "old b", None), (2, "A", "old a", "x")],
                                "id long, drug_code string, drug_name string, atc_code string")
    inc = spark.createDataFrame([("A", "A", "A"), ("C", "C", "C"), ("D", "D", "D")],
                                "drug_code string, drug_name string, atc_code string")
    got = {r.drug_code: (r.id, r.drug_name) for r in S.upsert_items(old, inc).collect()}
    assert got == {"A": (2, "A"), "B": (5, "old b"), "C": (6, "C"), "D": (7, "D")}


def test_upsert_by_key_new_rows_win(spark):
    old = spark.createDataFrame([("X", 1, 10), ("X", 2, 20)], "k string, d int, v int")
    new = spark.createDataFrame([("X", 2, 99), ("X", 3, 30)], "k string, d int, v int")
    got = sorted(tuple(r) for r in S.upsert_by_key(old, new, ["k", "d"]).collect())
    assert got == [("X", 1, 10), ("X", 2, 99), ("X", 3, 30)]


def test_unknown_code_raises(spark, demo):
    bad = spark.createDataFrame([(dt.date(2020, 1, 1), "NOPE", 1)], "date date, drug_code string, quantity_sold int")
    with pytest.raises(ValueError, match="NOPE"):
        S.sales_records(bad, demo.items)


def test_forecast_records_types(demo):
    f = demo.forecasts
    types = dict(f.dtypes)
    assert types["predicted_demand"] == "decimal(10,2)" and types["run_timestamp"] == "timestamp_ntz"
    assert f.select("run_timestamp").distinct().count() == 2


def test_dq_constraints_clean(demo):
    assert all(r.violations == 0 for r in S.dq_constraints(demo.items, demo.sales, demo.forecasts).collect())


def test_dq_constraints_find_violations(spark, demo):
    bad_sales = demo.sales.unionByName(demo.sales.limit(1)).unionByName(
        spark.createDataFrame([(999, dt.date(2020, 1, 1), -1)], "drug_id long, date date, quantity_sold int"))
    got = {r.rule: r.violations for r in S.dq_constraints(demo.items, bad_sales, demo.forecasts).collect()}
    assert got["sales_daily (drug_id, date) unique"] == 1
    assert got["sales_daily.quantity_sold >= 0"] == 1
    assert got["sales_daily.drug_id references drugs"] == 1


def test_cascade_delete(spark, demo):
    gone = spark.createDataFrame([("PROMO",)], "drug_code string")
    items, facts = S.cascade_delete(demo.items, demo.forecasts, gone)
    pid = demo.items.filter("drug_code = 'PROMO'").first().id
    assert items.filter("drug_code = 'PROMO'").count() == 0
    assert facts.filter(F.col("drug_id") == pid).count() == 0 and facts.count() > 0


def test_latest_forecasts_one_row_per_item_date(demo):
    latest = S.latest_forecasts(demo.forecasts)
    assert latest.count() == demo.forecasts.select("drug_id", "forecast_date").distinct().count()
    overlap = latest.filter(F.col("run_timestamp") == F.lit(dt.datetime(2024, 2, 1, 6)))
    assert overlap.filter("model_name = 'Moving Average'").count() == overlap.count()


def _dates(start, n):
    return [start + dt.timedelta(days=i) for i in range(n)]


@pytest.fixture
def loaded(spark, tmp_path, demo):
    st = S.ParquetStore(spark, str(tmp_path / "wh"))
    st.upsert_items(demo.items.select("drug_code", "drug_name", "atc_code"))
    return st


def test_item_versions_keep_id_and_created_at(loaded, demo):
    before = {r.drug_code: r for r in loaded.read("drugs").collect()}
    assert len(before) == 6 and loaded.versions("drugs") == [1]
    loaded.upsert_items(demo.items.select("drug_code", F.lit("renamed").alias("drug_name"), "atc_code"))
    after = {r.drug_code: r for r in loaded.read("drugs").collect()}
    assert loaded.versions("drugs") == [1, 2] and {r.drug_name for r in after.values()} == {"renamed"}
    assert all((after[c].id, after[c].created_at) == (r.id, r.created_at) for c, r in before.items())


def test_first_load_merges_its_own_duplicates(spark, loaded):
    batch = spark.createDataFrame([(d, "PROMO", q) for d in _dates(dt.date(2020, 1, 30), 4) for q in (3, 8)],
                                  "date date, drug_code string, quantity_sold int")
    first = loaded.upsert_sales(batch).collect()
    assert len(first) == 4 and {r.quantity_sold for r in first} == {8}
    again = loaded.upsert_sales(batch.withColumn("quantity_sold", F.lit(9))).collect()
    key = lambda r: (r.drug_id, r.date)
    assert {key(r): (r.id, r.created_at) for r in again} == {key(r): (r.id, r.created_at) for r in first}
    assert {r.quantity_sold for r in again} == {9} and sorted(r.id for r in again) == [1, 2, 3, 4]


def test_bad_rows_are_refused_and_change_nothing(spark, loaded):
    good = spark.createDataFrame([(dt.date(2020, 1, 1), "PROMO", 3)],
                                 "date date, drug_code string, quantity_sold int")
    loaded.upsert_sales(good)
    with pytest.raises(ValueError, match="quantity_sold >= 0"):
        loaded.upsert_sales(good.withColumn("quantity_sold", F.lit(-3)))
    with pytest.raises(ValueError, match="not null"):
        loaded.upsert_sales(good.withColumn("date", F.lit(None).cast("date")))
    fc = good.select("drug_code", F.lit(None).cast("date").alias("date"), F.lit(1.0).alias("predicted_demand"),
                     F.lit(None).cast("double").alias("lower_ci"), F.lit(None).cast("double").alias("upper_ci"))
    with pytest.raises(ValueError, match="forecasts_daily not null"):
        loaded.append_forecasts(fc, "Boosted Trees")
    assert [r.quantity_sold for r in loaded.read("sales_daily").collect()] == [3]
    assert loaded.versions("sales_daily") == [1] and loaded.read("forecasts_daily") is None


def test_upsert_writes_only_touched_months(spark, loaded, demo):
    day = dt.date(1995, 4, 1)
    loaded.upsert_sales(demo.sales_long.filter(F.col("date") < F.lit(day)))
    before = dict(loaded.manifest("sales_daily")[0])
    batch = (demo.sales_long.filter((F.col("date") >= F.lit(dt.date(1995, 3, 20)))
                                    & (F.col("date") < F.lit(dt.date(1995, 4, 10))))
             .withColumn("quantity_sold", F.lit(7)))
    out = loaded.upsert_sales(batch)
    after = dict(loaded.manifest("sales_daily")[0])
    assert {m for m in after if before.get(m) != after[m]} == {"1995-03", "1995-04"}
    got = {(r.drug_id, r.date): r.quantity_sold for r in out.collect()}
    n_old = demo.sales_long.filter(F.col("date") < F.lit(day)).count()
    n_new = batch.filter(F.col("date") >= F.lit(day)).count()
    assert len(got) == n_old + n_new
    assert all(q == 7 for (i, d), q in got.items() if d >= dt.date(1995, 3, 20))
    assert any(q != 7 for (i, d), q in got.items() if d < dt.date(1995, 3, 20))
    ids = [r.id for r in out.collect()]
    assert sorted(ids) == list(range(1, len(ids) + 1))


def test_an_unfinished_write_is_not_seen(spark, loaded, demo):
    import os
    loaded.upsert_sales(demo.sales_long.filter("drug_code = 'PROMO'"))
    n = loaded.read("sales_daily").count()
    os.makedirs(f"{loaded.root}/sales_daily/manifest/v=2")                 # no _SUCCESS
    assert loaded.versions("sales_daily") == [1] and loaded.read("sales_daily").count() == n


def test_forecast_runs_and_delete_with_cascade(spark, loaded, demo):
    loaded.upsert_sales(demo.sales_long)
    fc = demo.sales_long.groupBy("drug_code").agg(F.max("date").alias("date")).select(
        "drug_code", "date", F.lit(1.5).alias("predicted_demand"),
        F.lit(1.0).alias("lower_ci"), F.lit(2.0).alias("upper_ci"))
    loaded.append_forecasts(fc, "Boosted Trees", dt.datetime(2024, 3, 1))
    hist = loaded.append_forecasts(fc, "Boosted Trees", dt.datetime(2024, 3, 2))
    assert sorted(r.id for r in hist.collect()) == list(range(1, 13))
    promo = loaded.read("drugs").filter("drug_code = 'PROMO'").first().id
    n = loaded.read("sales_daily").filter(F.col("drug_id") != promo).count()
    loaded.delete_items(spark.createDataFrame([("PROMO",)], "drug_code string"))
    assert loaded.read("drugs").count() == 5
    assert loaded.read("sales_daily").count() == n
    assert loaded.read("forecasts_daily").count() == 10
    assert all(loaded.read(t).filter(F.col("drug_id") == promo).count() == 0
               for t in ("sales_daily", "forecasts_daily"))
    new = loaded.append_forecasts(fc.filter("drug_code <> 'PROMO'"), "Naive", dt.datetime(2024, 3, 3))
    assert new.agg(F.max("id")).first()[0] == 17                            # ids are never reused


def test_a_part_is_one_file_and_a_large_one_is_split(spark, tmp_path):
    """50 shuffle partitions: files per month at most bytes / target + 1."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions",
                                             "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        store = S.ParquetStore(spark, str(tmp_path / "s"))
        rows = spark.range(60_000).repartition(50).select(
            F.col("id"), (F.col("id") % 7).alias("drug_id"),
            F.expr("date_add(date'2020-01-01', CAST(id % 60 AS INT))").alias("date"),
            F.lit(1).alias("quantity_sold"), F.lit(None).cast("timestamp_ntz").alias("created_at"))
        month = F.date_format("date", "yyyy-MM")
        import pathlib

        def files(entries):
            return {part: len(list(pathlib.Path(path.removeprefix("file:")).glob("part-*"))) for part, path in entries}

        assert files(store._write("sales_daily", rows, month)) == {"2020-01": 1, "2020-02": 1}
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
        split = files(store._write("sales_daily", rows, month))
        assert all(1 < n <= 30_000 * 40 // 200_000 + 1 for n in split.values()), split
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
