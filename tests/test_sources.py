import datetime as dt

import pytest
from pyspark.sql import functions as F

from demand_engine.sources import wide as W
from demand_engine.sources.tables import fill_missing_days, sales_daily, wide_sales


@pytest.fixture
def wide_df(spark):
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=i), 100 + i, 200 + i) for i in range(10)]
    return spark.createDataFrame(rows, "datum date, M01AB int, N02BA int")


def test_produces_long_format(wide_df):
    assert set(W.wide_to_long(wide_df).columns) == {"date", "drug_code", "quantity_sold"}


def test_row_count_is_rows_times_items(wide_df):
    assert W.wide_to_long(wide_df).count() == 20


def test_item_codes_preserved(wide_df):
    codes = {r[0] for r in W.wide_to_long(wide_df).select("drug_code").distinct().collect()}
    assert codes == {"M01AB", "N02BA"}


def test_detects_date_column_name(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 1 + i), i) for i in range(5)], "date date, DrugA int")
    out = W.wide_to_long(df)
    assert "date" in out.columns and out.count() == 5


def test_raises_on_missing_date_column(spark):
    df = spark.createDataFrame([(i, i) for i in range(5)], "DrugA int, DrugB int")
    with pytest.raises(ValueError, match="No date column found"):
        W.wide_to_long(df)


def test_drops_missing_quantities(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 1), 100.0), (dt.date(2020, 1, 2), None),
                                (dt.date(2020, 1, 3), 120.0)], "datum date, DrugA double")
    out = W.wide_to_long(df)
    assert out.count() == 2 and out.filter(F.col("quantity_sold").isNull()).count() == 0


def test_quantities_truncate_not_round(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 1), 3.9), (dt.date(2020, 1, 2), -3.9)],
                               "datum date, A double")
    assert sorted(r[0] for r in W.wide_to_long(df).select("quantity_sold").collect()) == [-3, 3]


def test_non_item_columns_excluded(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 1), 2020, 1, 5)], "datum date, Year int, Month int, A int")
    assert [r[0] for r in W.wide_to_long(df).select("drug_code").collect()] == ["A"]


def test_same_day_duplicates_are_kept_not_summed(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 1), 5), (dt.date(2020, 1, 1), 7)], "datum date, A int")
    assert W.wide_to_long(df).count() == 2


def test_metadata_columns_and_uniqueness(sample_sales):
    meta = W.item_metadata(sample_sales)
    assert set(meta.columns) >= {"drug_code", "drug_name", "atc_code"}
    rows = meta.collect()
    assert [r.drug_code for r in rows] == ["RHYTHM"] and rows[0].drug_name == "RHYTHM"


def test_missing_csv_is_file_not_found(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        W.load_raw_sales(spark, str(tmp_path / "nope.csv"))


def test_csv_round_trip(spark, tmp_path):
    p = tmp_path / "sales.csv"
    p.write_text("datum,R03,R06,Hour\n2020-01-01,3,4.5,7\n2020-01-02,,6,7\n")
    out = W.wide_to_long(W.load_raw_sales(spark, str(p)))
    got = sorted((str(r.date), r.drug_code, r.quantity_sold) for r in out.collect())
    assert got == [("2020-01-01", "R03", 3), ("2020-01-01", "R06", 4), ("2020-01-02", "R06", 6)]


def test_wide_fixture_round_trip(spark):
    long = sales_daily(spark, "/root/testdata/sf0.001")
    back = W.wide_to_long(wide_sales(spark, "/root/testdata/sf0.001"))
    assert back.exceptAll(long).count() == 0 and long.exceptAll(back).count() == 0


def test_wide_file_from_given_tables(spark, tmp_path):
    """The CSV path on real data: written wide, loaded, melted."""
    wide = wide_sales(spark, "/root/testdata/sf0.001")
    wide.write.csv(str(tmp_path / "wide"), header=True)
    back = W.wide_to_long(W.load_raw_sales(spark, str(tmp_path / "wide")))
    long = sales_daily(spark, "/root/testdata/sf0.001")
    assert back.exceptAll(long).count() == 0 and long.exceptAll(back).count() == 0


def test_missing_days_are_filled_with_zero(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 1), "A", 3), (dt.date(2020, 1, 4), "A", 5),
                                (dt.date(2020, 1, 2), "B", 1)], "date date, drug_code string, quantity_sold int")
    got = sorted((r.drug_code, r.date.day, r.quantity_sold) for r in fill_missing_days(df).collect())
    assert got == [("A", 1, 3), ("A", 2, 0), ("A", 3, 0), ("A", 4, 5), ("B", 2, 1)]


def test_load_summary(spark):
    s = W.load_summary(sales_daily(spark, "/root/testdata/sf0.001")).first()
    assert s.n_series == 6 and s.n_rows > 0 and s.min_date <= s.max_date


def test_csv_with_schema_and_date_pattern(spark, tmp_path):
    p = tmp_path / "us.csv"
    p.write_text("datum,A\n01/31/2020,5\n02/01/2020,6\n")
    raw = W.load_raw_sales(spark, str(p), schema="datum string, A int")
    got = sorted((str(r.date), r.quantity_sold) for r in W.wide_to_long(raw, "MM/dd/yyyy").collect())
    assert got == [("2020-01-31", 5), ("2020-02-01", 6)]


def test_bad_lines_are_rejected_with_a_reason(spark, tmp_path):
    p = tmp_path / "wide.csv"
    p.write_text("Date,A,B,Year\n2020-01-01,1,2.9,2020\n2020-01-02,x,3,2020\nyesterday,4,5,2020\n"
                 "2020-01-04,6,,2020\n2020-01-05,7,8,2020,9\n")
    good, rejected = W.load_wide_csv(spark, str(p))
    long = sorted((str(r.date), r.drug_code, r.quantity_sold) for r in W.wide_to_long(good).collect())
    assert long == [("2020-01-01", "A", 1), ("2020-01-01", "B", 2), ("2020-01-04", "A", 6)]
    assert sorted((r.reason, r.line.split(",")[0]) for r in rejected.collect()) == [
        ("unreadable date", "yesterday"), ("unreadable line", "2020-01-02"),
        ("unreadable line", "2020-01-05")]
    with pytest.raises(FileNotFoundError):
        W.load_wide_csv(spark, str(tmp_path / "nope.csv"))
