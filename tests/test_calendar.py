import datetime as dt

import pytest
from pyspark.sql import functions as F

from demand_engine.functions import calendar as cal


def _flags(spark, dates, country):
    df = spark.createDataFrame([(d,) for d in dates], "date date")
    return [r[0] for r in df.select(cal.is_holiday(F.col("date"), country)).collect()]


def test_known_holiday_new_year(spark):
    assert _flags(spark, [dt.date(2018, 1, 1)], "SI") == [1]


def test_known_non_holiday(spark):
    assert _flags(spark, [dt.date(2018, 6, 15)], "SI") == [0]


def test_values_binary_and_some_found(spark):
    dates = [dt.date(2018, 1, 1) + dt.timedelta(days=i) for i in range(365)]
    flags = _flags(spark, dates, "SI")
    assert set(flags) <= {0, 1} and 10 <= sum(flags) <= 20


@pytest.mark.parametrize("year,western,orthodox", [
    (2018, dt.date(2018, 4, 1), dt.date(2018, 4, 8)),
    (2019, dt.date(2019, 4, 21), dt.date(2019, 4, 28)),
    (2024, dt.date(2024, 3, 31), dt.date(2024, 5, 5)),
    (2000, dt.date(2000, 4, 23), dt.date(2000, 4, 30)),
])
def test_easter_dates(spark, year, western, orthodox):
    df = spark.createDataFrame([(year,)], "y int")
    row = df.select(cal.western_easter(F.col("y")).alias("w"),
                    cal.orthodox_easter(F.col("y")).alias("o")).first()
    assert (row.w, row.o) == (western, orthodox)


def test_easter_monday_rules(spark):
    assert _flags(spark, [dt.date(2018, 4, 2)], "SI") == [1]      # Easter Monday
    assert _flags(spark, [dt.date(2018, 4, 9)], "MK") == [1]      # Orthodox Easter Monday
    assert _flags(spark, [dt.date(2018, 4, 2)], "MK") == [0]


def test_year_bounded_rule(spark):
    assert _flags(spark, [dt.date(2014, 1, 2), dt.date(2018, 1, 2)], "SI") == [0, 1]


def test_extra_holiday_table(spark):
    df = spark.createDataFrame([(dt.date(2018, 6, 19),), (dt.date(2018, 6, 14),)], "date date")
    extra = spark.createDataFrame([(dt.date(2018, 6, 19),)], "date date")
    out = cal.with_holiday_flag(df, "MK", extra_holidays=extra).orderBy("date").collect()
    assert [r.is_holiday for r in out] == [0, 1]


def test_lunar_holiday_of_the_default_country(spark):
    """Days from public calendars, one of them in the reference period."""
    assert _flags(spark, [dt.date(2018, 6, 15), dt.date(2018, 6, 16)], "MK") == [1, 0]
    assert _flags(spark, [dt.date(2018, 6, 15)], "SI") == [0]


def test_unknown_country(spark):
    with pytest.raises(ValueError):
        cal.is_holiday(F.col("date"), "XX")


def test_seasonal_indices(spark):
    dates = [dt.date(2018, m, 1) for m in range(1, 13)]
    rows = (spark.createDataFrame([(d,) for d in dates], "date date")
            .select("date", *cal.seasonal_columns(F.col("date"))).orderBy("date").collect())
    flu = [r.flu_season_index for r in rows]
    allergy = [r.allergy_season_index for r in rows]
    assert all(0 <= v <= 1 for v in flu + allergy)
    assert flu[0] == pytest.approx(1.0) and flu[6] == pytest.approx(0.0, abs=0.01)
    assert allergy[3] == pytest.approx(1.0) and allergy[3] > allergy[9]
    import numpy as np
    assert abs(np.corrcoef(flu, allergy)[0, 1]) < 0.9


def _days(spark, country, first, last):
    return {(str(r.date), r.name) for r in cal.holiday_calendar(spark, [country], first, last).collect()}


def test_calendar_anchors_of_the_other_countries(spark):
    """Public dates, written out by hand."""
    us = _days(spark, "US", 2020, 2022)
    for day in ("2021-01-18 Martin Luther King Jr. Day", "2021-05-31 Memorial Day", "2021-09-06 Labor Day",
                "2021-11-25 Thanksgiving Day", "2021-07-05 Independence Day (observed)",
                "2021-12-24 Christmas Day (observed)", "2021-12-31 New Year's Day (observed)",
                "2021-06-19 Juneteenth"):
        assert tuple(day.split(" ", 1)) in us, day
    assert not any(d.startswith("2020-06") for d, _ in us)
    assert len([d for d, _ in _days(spark, "US", 2019, 2019)]) == 10
    assert {d for d, _ in _days(spark, "DE", 2019, 2019)} == {
        "2019-01-01", "2019-04-19", "2019-04-22", "2019-05-01", "2019-05-30", "2019-06-10",
        "2019-10-03", "2019-12-25", "2019-12-26"}
    assert len(_days(spark, "FR", 2019, 2019)) == 11 and len(_days(spark, "AT", 2019, 2019)) == 13
    assert ("2019-06-20", "Corpus Christi") in _days(spark, "AT", 2019, 2019)


def test_table_and_column_agree(spark):
    days = spark.sql("SELECT explode(sequence(date'1994-01-01', date'2026-12-31')) AS date")
    for country in cal.HOLIDAY_RULES:
        by_rule = {r.date for r in days.filter(cal.is_holiday(F.col("date"), country) == 1).collect()}
        table = cal.holiday_calendar(spark, [country], 1993, 2027).filter(
            "date BETWEEN date'1994-01-01' AND date'2026-12-31'")
        assert {r.date for r in table.collect()} == by_rule, country


def test_series_of_two_countries_and_of_none(spark):
    df = spark.createDataFrame([("a", dt.date(2019, 7, 4)), ("b", dt.date(2019, 7, 4)),
                                ("b", dt.date(2019, 10, 3)), ("c", dt.date(2019, 1, 1))],
                               "drug_code string, date date")
    where = spark.createDataFrame([("a", "US"), ("b", "DE")], "drug_code string, country string")
    got = cal.with_country_holidays(df, where, cal.holiday_calendar(spark, ["US", "DE"], 2019, 2019))
    assert {(r.drug_code, r.date.month): r.is_holiday for r in got.collect()} == {
        ("a", 7): 1, ("b", 7): 0, ("b", 10): 1, ("c", 1): 0}


def test_dates_after_the_last_lunar_one_raise(spark):
    df = spark.createDataFrame([(dt.date(2031, 3, 3),)], "date date")
    with pytest.raises(Exception, match="listed up to 2030"):
        df.select(cal.is_holiday(F.col("date"), "MK")).collect()
    with pytest.raises(ValueError, match="listed up to 2030"):
        cal.holiday_calendar(spark, ["MK"], 2020, 2031)
    assert df.select(cal.is_holiday(F.col("date"), "SI")).first()[0] == 0


def test_unknown_country_with_a_table(spark):
    df = spark.createDataFrame([(dt.date(2031, 3, 3),), (dt.date(2031, 3, 4),)], "date date")
    extra = df.limit(1)
    out = cal.with_holiday_flag(df, "XX", extra_holidays=extra).orderBy("date").collect()
    assert [r.is_holiday for r in out] == [1, 0]
