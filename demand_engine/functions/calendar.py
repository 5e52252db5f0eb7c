"""Calendar, seasonal and holiday column expressions.

Everything here is a plain column expression evaluated inside whole-stage
codegen: no join, no Python per row. The holiday test is computed from the date
itself (fixed month-day rules, Easter-relative rules with Easter from the public
Gauss/Meeus computus, weekdays of a month, observed days, and a list of dated lunar
holidays up to 2030). Further days can be passed as a ``(date)`` DataFrame (see
:func:`with_holiday_flag`). The same rules as a ``(country, date, name)`` table
(:func:`holiday_calendar`) serve frames whose series belong to several countries.
"""

from __future__ import annotations

import datetime as _dt
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Public holiday rules per country (public calendars).
#   fixed: (month, day, first_year, last_year, name) - years inclusive, None = open
#   weekday: (month, weekday, which, first_year, name) - Monday = 0, which of the
#            month (-1 = the last)
#   easter: (calendar, offset in days from Easter Sunday, name)
#   dates: days which no rule on the date gives; with ``lunar`` (their name) they
#          come every year and are known up to the last one listed
#   observed: a fixed day on a Saturday is also kept on the Friday before it, one on
#             a Sunday on the Monday after it
# ---------------------------------------------------------------------------
HOLIDAY_RULES = {
    "SI": {
        "fixed": [
            (1, 1, None, None, "New Year's Day"),
            (1, 2, None, 2012, "New Year holiday"),
            (1, 2, 2017, None, "New Year holiday"),
            (2, 8, None, None, "Preseren Day"),
            (4, 27, None, None, "Day of Uprising Against Occupation"),
            (5, 1, None, None, "Labour Day"),
            (5, 2, None, None, "Labour Day"),
            (6, 25, None, None, "Statehood Day"),
            (8, 15, None, None, "Assumption Day"),
            (10, 31, None, None, "Reformation Day"),
            (11, 1, None, None, "Remembrance Day"),
            (12, 25, None, None, "Christmas Day"),
            (12, 26, None, None, "Independence and Unity Day"),
        ],
        "easter": [
            ("western", 0, "Easter Sunday"),
            ("western", 1, "Easter Monday"),
            ("western", 49, "Whit Sunday"),
        ],
        "dates": [],
    },
    "MK": {
        "fixed": [
            (1, 1, None, None, "New Year's Day"),
            (1, 7, None, None, "Christmas Day (Orthodox)"),
            (5, 1, None, None, "Labour Day"),
            (5, 24, None, None, "Saints Cyril and Methodius Day"),
            (8, 2, None, None, "Republic Day"),
            (9, 8, None, None, "Independence Day"),
            (10, 11, None, None, "Day of the People's Uprising"),
            (10, 23, None, None, "Day of the Macedonian Revolutionary Struggle"),
            (12, 8, None, None, "Saint Clement of Ohrid Day"),
        ],
        "easter": [
            ("orthodox", 1, "Easter Monday (Orthodox)"),
        ],
        "lunar": "Eid al-Fitr",      # first days, as far as they are listed
        "dates": [
            "1990-04-26", "1991-04-16", "1992-04-04", "1993-03-24", "1994-03-13", "1995-03-02",
            "1996-02-19", "1997-02-08", "1998-01-29", "1999-01-18", "2000-01-08", "2000-12-27",
            "2001-12-16", "2002-12-05", "2003-11-25", "2004-11-14", "2005-11-03", "2006-10-23",
            "2007-10-13", "2008-10-01", "2009-09-20", "2010-09-10", "2011-08-30", "2012-08-19",
            "2013-08-08", "2014-07-28", "2015-07-17", "2016-07-06", "2017-06-25", "2018-06-15",
            "2019-06-04", "2020-05-24", "2021-05-13", "2022-05-02", "2023-04-21", "2024-04-10",
            "2025-03-30", "2026-03-20", "2027-03-09", "2028-02-26", "2029-02-14", "2030-02-04",
        ],
    },
    "AT": {
        "fixed": [
            (1, 1, None, None, "New Year's Day"),
            (1, 6, None, None, "Epiphany"),
            (5, 1, None, None, "National Holiday"),
            (8, 15, None, None, "Assumption Day"),
            (10, 26, None, None, "National Day"),
            (11, 1, None, None, "All Saints' Day"),
            (12, 8, None, None, "Immaculate Conception"),
            (12, 25, None, None, "Christmas Day"),
            (12, 26, None, None, "Saint Stephen's Day"),
        ],
        "easter": [
            ("western", 1, "Easter Monday"),
            ("western", 39, "Ascension Day"),
            ("western", 50, "Whit Monday"),
            ("western", 60, "Corpus Christi"),
        ],
        "dates": [],
    },
    "DE": {                          # in all states
        "fixed": [
            (1, 1, None, None, "New Year's Day"),
            (5, 1, None, None, "Labour Day"),
            (10, 3, 1990, None, "German Unity Day"),
            (10, 31, 2017, 2017, "Reformation Day"),
            (12, 25, None, None, "Christmas Day"),
            (12, 26, None, None, "Second Day of Christmas"),
        ],
        "easter": [
            ("western", -2, "Good Friday"),
            ("western", 1, "Easter Monday"),
            ("western", 39, "Ascension Day"),
            ("western", 50, "Whit Monday"),
        ],
        "dates": [],
    },
    "FR": {
        "fixed": [
            (1, 1, None, None, "New Year's Day"),
            (5, 1, None, None, "Labour Day"),
            (5, 8, 1982, None, "Victory Day"),
            (7, 14, None, None, "National Day"),
            (8, 15, None, None, "Assumption Day"),
            (11, 1, None, None, "All Saints' Day"),
            (11, 11, None, None, "Armistice Day"),
            (12, 25, None, None, "Christmas Day"),
        ],
        "easter": [
            ("western", 1, "Easter Monday"),
            ("western", 39, "Ascension Day"),
            ("western", 50, "Whit Monday"),
        ],
        "dates": [],
    },
    "US": {                          # federal
        "fixed": [
            (1, 1, None, None, "New Year's Day"),
            (6, 19, 2021, None, "Juneteenth"),
            (7, 4, None, None, "Independence Day"),
            (11, 11, 1978, None, "Veterans Day"),
            (12, 25, None, None, "Christmas Day"),
        ],
        "weekday": [
            (1, 0, 3, 1986, "Martin Luther King Jr. Day"),
            (2, 0, 3, 1971, "Washington's Birthday"),
            (5, 0, -1, 1971, "Memorial Day"),
            (9, 0, 1, None, "Labor Day"),
            (10, 0, 2, 1971, "Columbus Day"),
            (11, 3, 4, 1942, "Thanksgiving Day"),
        ],
        "easter": [],
        "dates": [],
        "observed": True,
    },
}


def _div(a: Column, b: int) -> Column:
    """Integer floor division of a non-negative integer column."""
    return F.floor(a / F.lit(b)).cast("int")


def western_easter(year: Column) -> Column:
    """Gregorian Easter Sunday (anonymous Gregorian / Meeus-Jones-Butcher)."""
    y = year.cast("int")
    a = y % 19
    b = _div(y, 100)
    c = y % 100
    d = _div(b, 4)
    e = b % 4
    f = _div(b + 8, 25)
    g = _div(b - f + 1, 3)
    h = (a * 19 + b - d - g + 15) % 30
    i = _div(c, 4)
    k = c % 4
    ll = F.pmod(e * 2 + i * 2 - h - k + 32, F.lit(7))
    m = _div(a + h * 11 + ll * 22, 451)
    s = h + ll - m * 7 + 114
    return F.make_date(y, _div(s, 31), s % 31 + 1)


def orthodox_easter(year: Column) -> Column:
    """Julian-computus Easter expressed in the Gregorian calendar (1900-2099)."""
    y = year.cast("int")
    a = y % 4
    b = y % 7
    c = y % 19
    d = (c * 19 + 15) % 30
    e = F.pmod(a * 2 + b * 4 - d + 34, F.lit(7))
    s = d + e + 114
    julian = F.make_date(y, _div(s, 31), s % 31 + 1)
    return F.date_add(julian, 13)


def holiday_rules(country: str) -> dict:
    rules = HOLIDAY_RULES.get(country.upper())
    if rules is None:
        raise ValueError(f"no holiday rules for country {country!r}; "
                         f"known: {sorted(HOLIDAY_RULES)}")
    return rules


def last_listed_year(country: str) -> int | None:
    """The last year whose lunar holidays are listed; None where there are none."""
    rules = holiday_rules(country)
    return int(max(rules["dates"])[:4]) if "lunar" in rules else None


def is_holiday(date: Column, country: str) -> Column:
    """1 if ``date`` is a rule-based public holiday of ``country``, else 0. A date after
    the last listed lunar holiday raises: its answer is not known."""
    rules = holiday_rules(country)
    month, day, year = F.month(date), F.dayofmonth(date), F.year(date)

    def on_fixed(date: Column) -> Column:
        month, day, year = F.month(date), F.dayofmonth(date), F.year(date)
        found = F.lit(False)
        for m, d, first, last, _ in rules["fixed"]:
            c = (month == m) & (day == d)
            if first is not None:
                c = c & (year >= first)
            if last is not None:
                c = c & (year <= last)
            found = found | c
        return found

    cond = on_fixed(date)
    if rules.get("observed"):
        cond = cond | ((F.weekday(date) == 4) & on_fixed(F.date_add(date, 1)))
        cond = cond | ((F.weekday(date) == 0) & on_fixed(F.date_sub(date, 1)))
    for m, weekday, which, first, _ in rules.get("weekday", ()):
        place = (day > F.dayofmonth(F.last_day(date)) - 7 if which < 0
                 else F.floor((day - 1) / 7) + 1 == which)
        cond = cond | ((month == m) & (F.weekday(date) == weekday) & place & (year >= (first or 0)))
    easters = {"western": western_easter(year), "orthodox": orthodox_easter(year)}
    for cal, offset, _ in rules["easter"]:
        cond = cond | (date == F.date_add(easters[cal], offset))
    if rules["dates"]:
        cond = cond | date.isin(*[_dt.date.fromisoformat(d) for d in rules["dates"]])
    known, flag = last_listed_year(country), cond.cast("int")
    if known is None:
        return flag
    return F.when(year > known, F.raise_error(F.lit(
        f"holidays of {country.upper()} are listed up to {known}; give a table of later ones"))
        ).otherwise(flag)


def holiday_calendar(spark: SparkSession, countries: list[str], first_year: int,
                     last_year: int) -> DataFrame:
    """The calendar dimension ``(country, date, name)``: the rules of each country as
    rows, expanded over the years. A day with two names has two rows."""
    rows = []
    for country in dict.fromkeys(c.upper() for c in countries):
        rules, known = holiday_rules(country), last_listed_year(country)
        if known is not None and last_year > known:
            raise ValueError(f"holidays of {country} are listed up to {known}, not {last_year}")
        row = lambda kind, name, **values: rows.append(
            {"country": country, "kind": kind, "name": name, "observed": False, **values})
        for m, d, first, last, name in rules["fixed"]:
            row("fixed", name, month=m, day=d, first=first, last=last,
                observed=bool(rules.get("observed")))
        for m, weekday, which, first, name in rules.get("weekday", ()):
            row("weekday", name, month=m, day=weekday, which=which, first=first)
        for cal, offset, name in rules["easter"]:
            row(cal, name, which=offset)
        for d in rules["dates"]:
            row("date", rules.get("lunar", "holiday"), date=_dt.date.fromisoformat(d))
    names = ("country", "kind", "name", "observed", "month", "day", "which", "first", "last", "date")
    table = spark.createDataFrame(
        [tuple(r.get(c) for c in names) for r in rows],
        "country string, kind string, name string, observed boolean, month int, day int, which int, "
        "first int, last int, date date")
    start = F.greatest(F.lit(first_year), F.coalesce("first", F.lit(first_year)))
    end = F.least(F.lit(last_year), F.coalesce("last", F.lit(last_year)))
    yearly = table.filter(start <= end).withColumn("year", F.explode(F.sequence(start, end)))
    year, kind = F.col("year"), F.col("kind")
    month_start = F.make_date(year, F.coalesce("month", F.lit(1)), F.lit(1))
    first_hit = F.date_add(month_start, F.pmod(F.col("day") - F.weekday(month_start), F.lit(7)))
    month_end = F.last_day(month_start)
    last_hit = F.date_sub(month_end, F.pmod(F.weekday(month_end) - F.col("day"), F.lit(7)))
    day = (F.when(kind == "fixed", F.make_date(year, "month", "day"))
           .when((kind == "weekday") & (F.col("which") < 0), last_hit)
           .when(kind == "weekday", F.date_add(first_hit, (F.col("which") - 1) * 7))
           .when(kind == "western", F.date_add(western_easter(year), F.col("which")))
           .when(kind == "orthodox", F.date_add(orthodox_easter(year), F.col("which")))
           .when(F.year("date") == year, F.col("date")))
    shift = (F.when(F.col("observed") & (F.weekday("date") == 5), F.array(F.lit(0), F.lit(-1)))
             .when(F.col("observed") & (F.weekday("date") == 6), F.array(F.lit(0), F.lit(1)))
             .otherwise(F.array(F.lit(0))))
    days = yearly.withColumn("date", day).filter("date IS NOT NULL").withColumn(
        "shift", F.explode(shift))
    return days.select("country", F.date_add("date", F.col("shift")).alias("date"), F.when(
        F.col("shift") == 0, F.col("name")).otherwise(F.concat("name", F.lit(" (observed)"))).alias("name"))


def with_country_holidays(df: DataFrame, series_country: DataFrame, calendar: DataFrame) -> DataFrame:
    """Add ``country`` and ``is_holiday`` to a frame of many countries' series.

    ``series_country(drug_code, country)`` has one row per series; ``calendar`` is
    :func:`holiday_calendar`, a user's table of the same form, or both together.
    Series without a country get 0. How the tables are joined is the optimizer's
    choice.
    """
    days = calendar.select("country", "date").distinct().withColumn("__hit", F.lit(1))
    return (df.join(series_country.select("drug_code", "country"), "drug_code", "left")
            .join(days, ["country", "date"], "left")
            .withColumn("is_holiday", F.coalesce("__hit", F.lit(0))).drop("__hit"))


def with_holiday_flag(df: DataFrame, country: str, date_col: str = "date",
                      extra_holidays: DataFrame | None = None) -> DataFrame:
    """Add ``is_holiday``: rule holidays OR membership in ``extra_holidays``
    (one ``date`` column). How that calendar is joined is the optimizer's choice. A
    country without rules has the days of the table alone."""
    known = extra_holidays is None or country.upper() in HOLIDAY_RULES
    flag = is_holiday(F.col(date_col), country) if known else F.lit(0)
    if extra_holidays is None:
        return df.withColumn("is_holiday", flag)
    extra = (extra_holidays.select(F.col("date").cast("date").alias("__hday"))
             .distinct().withColumn("__hit", F.lit(1)))
    out = df.join(extra, F.col(date_col) == F.col("__hday"), "left")
    return (out.withColumn("is_holiday",
                           F.greatest(flag, F.coalesce(F.col("__hit"), F.lit(0))).cast("int"))
            .drop("__hday", "__hit"))


def time_feature_columns(date: Column) -> list[Column]:
    """The eight calendar features, Monday = 0, ISO week."""
    dow = F.weekday(date)
    return [
        dow.alias("day_of_week"),
        F.dayofmonth(date).alias("day_of_month"),
        F.month(date).alias("month"),
        F.quarter(date).alias("quarter"),
        F.weekofyear(date).alias("week_of_year"),
        (dow >= 5).cast("int").alias("is_weekend"),
        (F.dayofmonth(date) == 1).cast("int").alias("is_month_start"),
        (date == F.last_day(date)).cast("int").alias("is_month_end"),
    ]


def seasonal_index(month: Column, peak_month: int) -> Column:
    """Cosine index in [0, 1] with value 1 in ``peak_month``."""
    return F.lit(0.5) + F.lit(0.5) * F.cos(F.lit(2 * math.pi) * (month - peak_month) / F.lit(12))


def seasonal_columns(date: Column) -> list[Column]:
    m = F.month(date)
    return [seasonal_index(m, 1).alias("flu_season_index"),
            seasonal_index(m, 4).alias("allergy_season_index")]
