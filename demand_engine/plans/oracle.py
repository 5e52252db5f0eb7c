"""Reference SQL (DuckDB dialect) for the registered queries.

Written independently of the Spark code from the operator definitions:
self-joins and grouped aggregates where the Spark side uses carried window
state, so the two formulations check each other.
"""

from __future__ import annotations

from ..config import DEFAULT
from ..sources.tables import LINES_SQL, SALES_SQL
from . import catalog as C
from .fixture import RUN_1, RUN_1_DAYS_BACK, RUN_2, RUN_2_DAYS_BACK

H = DEFAULT.horizon
T = DEFAULT.test_days
NF = DEFAULT.cv_folds

ITEMS = """items AS (
  SELECT CAST(row_number() OVER (ORDER BY drug_code) AS BIGINT) AS id, drug_code,
         drug_code AS drug_name, drug_code AS atc_code
  FROM (SELECT DISTINCT drug_code FROM sales_daily))"""

FACT = """sales AS (
  SELECT i.id AS drug_id, s.date, s.quantity_sold
  FROM sales_daily s JOIN items i ON s.drug_code = i.drug_code)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _r(x: str, alias: str) -> str:
    return f"ROUND({x}, 6) AS {alias}"


def baseline_ctes(name: str, back_days: int, horizon: int = H) -> list[str]:
    """Forecast rows of all three baselines trained up to ``back_days`` before
    each series' last date: CTE ``fc_<name>`` with model_name and the values."""
    return [
        f"""train_{name} AS (
  SELECT s.drug_code, s.date, s.quantity_sold,
         row_number() OVER (PARTITION BY s.drug_code ORDER BY s.date DESC, s.quantity_sold DESC) AS rdesc
  FROM sales_daily s JOIN (SELECT drug_code, max(date) AS mx FROM sales_daily GROUP BY 1) m
       ON s.drug_code = m.drug_code
  WHERE s.date <= m.mx - {back_days})""",
        f"""cut_{name} AS (
  SELECT drug_code,
         max(date) FILTER (WHERE rdesc = 1) AS cutoff_date,
         CAST(max(quantity_sold) FILTER (WHERE rdesc = 1) AS DOUBLE) AS last_value,
         avg(quantity_sold) FILTER (WHERE rdesc <= {DEFAULT.ma_window}) AS ma_mean,
         stddev_samp(quantity_sold) FILTER (WHERE rdesc <= {DEFAULT.ma_window}) AS ma_std,
         avg(quantity_sold) AS hist_mean, stddev_samp(quantity_sold) AS hist_std
  FROM train_{name} GROUP BY drug_code)""",
        f"""steps_{name} AS (SELECT c.*, unnest(range(0, {horizon})) AS pos FROM cut_{name} c)""",
        f"""seas_{name} AS (
  SELECT st.*, CAST(st.cutoff_date + CAST(st.pos + 1 AS INTEGER) AS DATE) AS date,
         coalesce(CAST(t.quantity_sold AS DOUBLE), st.hist_mean) AS seas
  FROM steps_{name} st LEFT JOIN train_{name} t
    ON t.drug_code = st.drug_code
   AND t.date = st.cutoff_date - CAST({DEFAULT.season_length} - st.pos % {DEFAULT.season_length} AS INTEGER))""",
        f"""fc_{name} AS (
  SELECT drug_code, 'Naive' AS model_name, date, last_value AS predicted_demand,
         last_value * 0.8 AS lower_ci, last_value * 1.2 AS upper_ci FROM seas_{name}
  UNION ALL
  SELECT drug_code, 'Moving Average', date, ma_mean, greatest(0.0, ma_mean - 1.96 * ma_std),
         ma_mean + 1.96 * ma_std FROM seas_{name}
  UNION ALL
  SELECT drug_code, 'Seasonal Naive', date, seas,
         CASE WHEN hist_std IS NULL THEN NULL ELSE greatest(0.0, seas - 1.96 * hist_std) END,
         seas + 1.96 * hist_std FROM seas_{name})""",
    ]


HISTORY = [
    *baseline_ctes("r1", RUN_1_DAYS_BACK),
    *baseline_ctes("r2", RUN_2_DAYS_BACK),
    f"""hist_raw AS (
  SELECT drug_code, date, predicted_demand, lower_ci, upper_ci, model_name,
         TIMESTAMP '{RUN_1:%Y-%m-%d %H:%M:%S}' AS run_timestamp
  FROM fc_r1 WHERE model_name = 'Naive'
  UNION ALL
  SELECT drug_code, date, predicted_demand, lower_ci, upper_ci, model_name,
         TIMESTAMP '{RUN_2:%Y-%m-%d %H:%M:%S}'
  FROM fc_r2 WHERE model_name IN ('Moving Average', 'Seasonal Naive'))""",
    """forecasts AS (
  SELECT CAST(row_number() OVER (ORDER BY h.run_timestamp, h.model_name, i.id, h.date) AS BIGINT) AS id,
         i.id AS drug_id, h.date AS forecast_date, h.run_timestamp,
         CAST(h.predicted_demand AS DECIMAL(10,2)) AS predicted_demand,
         CAST(h.lower_ci AS DECIMAL(10,2)) AS lower_ci,
         CAST(h.upper_ci AS DECIMAL(10,2)) AS upper_ci, h.model_name
  FROM hist_raw h JOIN items i ON h.drug_code = i.drug_code)""",
]

STORE = [SALES_SQL, ITEMS, FACT, *HISTORY]

NEWEST = """newest AS (
  SELECT f.* FROM forecasts f
  WHERE f.run_timestamp = (SELECT max(run_timestamp) FROM forecasts g WHERE g.drug_id = f.drug_id))"""

ITEM_FC = """item_fc AS (
  SELECT * FROM (
    SELECT f.*, row_number() OVER (PARTITION BY drug_id, forecast_date ORDER BY id) AS rn
    FROM forecasts f
    WHERE f.run_timestamp >= (SELECT max(run_timestamp) FROM forecasts g WHERE g.drug_id = f.drug_id))
  WHERE rn = 1)"""

POS = """pos AS (
  SELECT drug_code, date, quantity_sold,
         CAST(row_number() OVER (PARTITION BY drug_code ORDER BY date, quantity_sold) - 1 AS INTEGER) AS idx,
         CAST(count(*) OVER (PARTITION BY drug_code) AS INTEGER) AS n
  FROM sales_daily)"""


def _cv_ctes(src_filter: str = "") -> list[str]:
    """Fold test rows joined to their cutoff row; predictions of the three models."""
    return [
        POS.replace("FROM sales_daily)", f"FROM sales_daily {src_filter})"),
        f"""stats AS (
  SELECT *,
    avg(quantity_sold) OVER (PARTITION BY drug_code ORDER BY idx ROWS BETWEEN {DEFAULT.ma_window - 1} PRECEDING AND CURRENT ROW) AS ma_mean,
    stddev_samp(quantity_sold) OVER (PARTITION BY drug_code ORDER BY idx ROWS BETWEEN {DEFAULT.ma_window - 1} PRECEDING AND CURRENT ROW) AS ma_std
  FROM pos)""",
        f"""tests AS (
  SELECT *, (n - 1 - idx) // {T} + 1 AS k, n - ((n - 1 - idx) // {T} + 1) * {T} AS test_start
  FROM pos)""",
        f"""joined AS (
  SELECT t.drug_code, {NF} + 1 - t.k AS fold, t.idx - t.test_start AS p, t.quantity_sold AS actual,
         c.date AS cutoff_date, CAST(c.quantity_sold AS DOUBLE) AS last_value, c.ma_mean,
         (SELECT avg(h.quantity_sold) FROM pos h WHERE h.drug_code = t.drug_code AND h.idx < t.test_start) AS hist_mean
  FROM tests t JOIN stats c ON c.drug_code = t.drug_code AND c.idx = t.test_start - 1
  WHERE t.k <= {NF} AND t.test_start >= {DEFAULT.baseline_min_train})""",
        f"""preds AS (
  SELECT j.drug_code, j.fold, j.actual, 'Naive' AS model_name, j.last_value AS predicted FROM joined j
  UNION ALL
  SELECT j.drug_code, j.fold, j.actual, 'Moving Average', j.ma_mean FROM joined j
  UNION ALL
  SELECT j.drug_code, j.fold, j.actual, 'Seasonal Naive',
         coalesce(CAST(l.quantity_sold AS DOUBLE), j.hist_mean)
  FROM joined j LEFT JOIN pos l
    ON l.drug_code = j.drug_code
   AND l.date = j.cutoff_date - CAST({DEFAULT.season_length} - j.p % {DEFAULT.season_length} AS INTEGER))""",
        """fold_metrics AS (
  SELECT drug_code, model_name, fold,
         avg(abs(actual - predicted)) AS mae,
         sqrt(avg((actual - predicted) * (actual - predicted))) AS rmse,
         avg(CASE WHEN actual > 0 THEN abs(actual - predicted) / actual END) AS mape,
         count(*) AS n_test
  FROM preds GROUP BY 1, 2, 3)""",
        """cv AS (
  SELECT drug_code, model_name, avg(mae) AS mae, avg(rmse) AS rmse, avg(mape) AS mape,
         count(*) AS n_folds
  FROM fold_metrics GROUP BY 1, 2)""",
    ]


# Holidays of MK in the years of the test tables, as dates (an independent list:
# the engine computes them from rules). Orthodox Easter Mondays and first days
# of Eid al-Fitr by year, and the days that are the same every year.
MOVING_DAYS = """1992-04-27 1993-04-19 1994-05-02 1995-04-24 1996-04-15 1997-04-28 1998-04-20
1999-04-12 2000-05-01 2001-04-16 2002-05-06 2003-04-28 2004-04-12 2005-05-02
1992-04-04 1993-03-24 1994-03-13 1995-03-02 1996-02-19 1997-02-08 1998-01-29 1999-01-18
2000-01-08 2000-12-27 2001-12-16 2002-12-05 2003-11-25 2004-11-14 2005-11-03""".split()
SAME_DAYS = "01-01 01-07 05-01 05-24 08-02 09-08 10-11 10-23 12-08".split()


def holiday_sql(date: str) -> str:
    moving = ", ".join(f"DATE '{d}'" for d in MOVING_DAYS)
    same = ", ".join(f"'{d}'" for d in SAME_DAYS)
    return f"CAST(({date} IN ({moving}) OR strftime({date}, '%m-%d') IN ({same})) AS INTEGER)"


MODEL_RANK = ("CASE model_name WHEN 'Naive' THEN 1 WHEN 'Moving Average' THEN 2 "
              "WHEN 'Seasonal Naive' THEN 3 WHEN 'Boosted Trees' THEN 4 ELSE 5 END")


def _lag(n):
    return f"lag(quantity_sold, {n}) OVER (PARTITION BY drug_code ORDER BY date, quantity_sold)"


def _roll(fn, n):
    return (f"{fn}(quantity_sold) OVER (PARTITION BY drug_code ORDER BY date, quantity_sold "
            f"ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)")


ROLL_FN = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}

TIME_COLS = """CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(day(date) AS INTEGER) AS day_of_month,
  CAST(month(date) AS INTEGER) AS month, CAST(quarter(date) AS INTEGER) AS quarter,
  CAST(weekofyear(date) AS INTEGER) AS week_of_year,
  CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend,
  CAST(day(date) = 1 AS INTEGER) AS is_month_start,
  CAST(date = last_day(date) AS INTEGER) AS is_month_end"""

SEASON_COLS = """ROUND(0.5 + 0.5 * cos(2 * pi() * (month(date) - 1) / 12), 6) AS flu_season_index,
  ROUND(0.5 + 0.5 * cos(2 * pi() * (month(date) - 4) / 12), 6) AS allergy_season_index"""


def _feature_sql() -> str:
    lags = ",\n  ".join(f"coalesce({_lag(n)}, 0) AS lag_{n}" for n in DEFAULT.lags)
    rolls = []
    for n in DEFAULT.rolling_windows:
        for s in ("mean", "std", "min", "max"):
            expr = f"coalesce({_roll(ROLL_FN[s], n)}, 0)"
            rolls.append(_r(expr, f"rolling_{s}_{n}") if s in ("mean", "std")
                         else f"{expr} AS rolling_{s}_{n}")
    return (_with(SALES_SQL) + f"""SELECT date, drug_code, quantity_sold,
  {TIME_COLS},
  {holiday_sql('date')} AS is_holiday,
  {SEASON_COLS},
  {lags},
  {", ".join(rolls)}
FROM sales_daily""")


def _fc_select(name: str, models: tuple[str, ...], with_model: bool) -> str:
    m = ", ".join(f"'{x}'" for x in models)
    cols = "drug_code, " + ("model_name, " if with_model else "") + "date, " + ", ".join(
        _r(c, c) for c in ("predicted_demand", "lower_ci", "upper_ci"))
    return f"SELECT {cols} FROM fc_{name} WHERE model_name IN ({m})"


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    s = _with(SALES_SQL)
    q["load_summary"] = s + """SELECT count(*) AS n_rows, count(DISTINCT drug_code) AS n_series,
  min(date) AS min_date, max(date) AS max_date FROM sales_daily"""
    # melting a pivot gives the rows back that have a value
    q["wide_to_long"] = s + """SELECT date, drug_code, quantity_sold FROM sales_daily
WHERE quantity_sold IS NOT NULL"""
    q["item_metadata"] = s + """SELECT DISTINCT drug_code, drug_code AS drug_name, drug_code AS atc_code
FROM sales_daily"""
    q["time_features"] = s + f"SELECT drug_code, date, {TIME_COLS} FROM sales_daily"
    q["seasonal_indices"] = s + f"SELECT drug_code, date, {SEASON_COLS} FROM sales_daily"
    q["holiday_flag"] = s + (f"SELECT drug_code, date, {holiday_sql('date')} "
                             "AS is_holiday FROM sales_daily")
    q["holidays_of_two_countries"] = _with(SALES_SQL, """easter AS (
  SELECT CAST(d AS DATE) AS d FROM (VALUES ('1995-04-16'), ('1996-04-07'), ('1997-03-30'),
    ('1998-04-12'), ('1999-04-04'), ('2000-04-23'), ('2001-04-15')) t(d))""") + """
SELECT drug_code, country, date, CAST(CASE
  WHEN country = 'DE' THEN strftime(date, '%m-%d') IN ('01-01', '05-01', '10-03', '12-25', '12-26')
    OR date IN (SELECT CAST(d + CAST(o AS INTEGER) AS DATE) FROM easter, (VALUES (-2), (1), (39), (50)) t(o))
  ELSE strftime(date, '%m-%d') IN ('01-01', '07-04', '11-11', '12-25')
    OR isodow(date) = 5 AND strftime(date + 1, '%m-%d') IN ('01-01', '07-04', '11-11', '12-25')
    OR isodow(date) = 1 AND strftime(date - 1, '%m-%d') IN ('01-01', '07-04', '11-11', '12-25')
    OR isodow(date) = 1 AND (month(date) IN (1, 2) AND day(date) BETWEEN 15 AND 21
      OR month(date) = 5 AND day(date) > 24 OR month(date) = 9 AND day(date) < 8
      OR month(date) = 10 AND day(date) BETWEEN 8 AND 14)
    OR isodow(date) = 4 AND month(date) = 11 AND day(date) BETWEEN 22 AND 28 END AS INTEGER) AS is_holiday
FROM (SELECT *, CASE WHEN length(drug_code) % 2 = 0 THEN 'US' ELSE 'DE' END AS country FROM sales_daily)"""
    q["lag_features"] = s + "SELECT drug_code, date, quantity_sold, " + ", ".join(
        f"{_lag(n)} AS lag_{n}" for n in DEFAULT.lags) + " FROM sales_daily"
    for stat, fn in ROLL_FN.items():
        cols = []
        for n in DEFAULT.rolling_windows:
            e = _roll(fn, n)
            cols.append(_r(e, f"rolling_{stat}_{n}") if stat in ("mean", "std")
                        else f"{e} AS rolling_{stat}_{n}")
        q[f"rolling_{stat}"] = s + "SELECT drug_code, date, " + ", ".join(cols) + " FROM sales_daily"
    q["feature_frame"] = _feature_sql()

    q["train_test_split"] = s + f"""SELECT date, drug_code, quantity_sold,
  date <= max(date) OVER (PARTITION BY drug_code) - {T} AS is_train FROM sales_daily"""
    q["min_history"] = s + f"""SELECT date, drug_code, quantity_sold FROM sales_daily
WHERE drug_code IN (SELECT drug_code FROM sales_daily GROUP BY 1 HAVING count(*) >= {DEFAULT.min_history_days})"""
    q["walk_forward_folds"] = _with(SALES_SQL, POS) + f"""SELECT date, drug_code, quantity_sold, idx, n,
  {NF} + 1 - k AS fold, test_start, idx - test_start AS pos
FROM (SELECT *, CAST((n - 1 - idx) // {T} + 1 AS INTEGER) AS k,
             CAST(n - ((n - 1 - idx) // {T} + 1) * {T} AS INTEGER) AS test_start FROM pos)
WHERE k <= {NF} AND test_start >= {DEFAULT.baseline_min_train}"""
    q["series_tail"] = _with(SALES_SQL, POS) + f"""SELECT drug_code, date, quantity_sold FROM pos
WHERE idx >= n - {max(DEFAULT.lags)}"""

    full = _with(SALES_SQL, *baseline_ctes("f", 0))
    q["naive_forecast"] = full + _fc_select("f", ("Naive",), False)
    q["moving_average_forecast"] = full + _fc_select("f", ("Moving Average",), False)
    q["seasonal_naive_forecast"] = full + _fc_select("f", ("Seasonal Naive",), False)
    q["forecast_calendar"] = full + "SELECT drug_code, date FROM fc_f WHERE model_name = 'Naive'"
    q["all_baseline_forecasts"] = full + _fc_select(
        "f", ("Naive", "Moving Average", "Seasonal Naive"), True)
    q["clamped_baselines"] = full + """SELECT drug_code, model_name, date,
  ROUND(greatest(0.0, predicted_demand), 6) AS predicted_demand,
  ROUND(greatest(0.0, lower_ci), 6) AS lower_ci, ROUND(greatest(0.0, upper_ci), 6) AS upper_ci
FROM fc_f"""

    cv = _with(SALES_SQL, *_cv_ctes())
    q["baseline_fold_metrics"] = cv + """SELECT drug_code, model_name, fold, ROUND(mae, 6) AS mae,
  ROUND(rmse, 6) AS rmse, ROUND(mape, 6) AS mape, n_test FROM fold_metrics"""
    q["baseline_cv"] = cv + """SELECT drug_code, model_name, ROUND(mae, 6) AS mae, ROUND(rmse, 6) AS rmse,
  ROUND(mape, 6) AS mape, n_folds FROM cv"""
    best = """SELECT drug_code, model_name, ROUND(mae, 6) AS mae, ROUND(rmse, 6) AS rmse,
  ROUND(mape, 6) AS mape, n_folds,
  coalesce(abs(mape - min(mape) OVER (PARTITION BY drug_code)) < 1e-9, false) AS is_best"""
    q["best_model_per_series"] = cv + best + " FROM cv"
    pcv = _with(SALES_SQL, *_cv_ctes(
        f"WHERE drug_code IN (SELECT drug_code FROM sales_daily GROUP BY 1 "
        f"HAVING count(*) >= {DEFAULT.min_history_days + T})"))
    q["model_comparison"] = pcv + best + f", {MODEL_RANK} AS model_rank FROM cv"
    q["model_summary"] = pcv + f"""SELECT model_name, ROUND(avg_mae, 6) AS avg_mae, ROUND(avg_rmse, 6) AS avg_rmse,
  ROUND(avg_mape, 6) AS avg_mape, n_series,
  coalesce(abs(avg_mape - min(avg_mape) OVER ()) < 1e-9, false) AS is_best, {MODEL_RANK} AS model_rank
FROM (SELECT model_name, avg(mae) AS avg_mae, avg(rmse) AS avg_rmse, avg(mape) AS avg_mape,
             count(DISTINCT drug_code) AS n_series FROM cv GROUP BY 1)"""
    prof = f"""SELECT drug_code, count(*) AS n_rows,
  ROUND(avg(CAST(quantity_sold = 0 AS DOUBLE)), 6) AS zero_fraction,
  ROUND(CASE WHEN avg(quantity_sold) = 0 THEN NULL ELSE stddev_samp(quantity_sold) / avg(quantity_sold) END, 6) AS cv,
  avg(CAST(quantity_sold = 0 AS DOUBLE)) > {DEFAULT.zero_fraction_warn} AS zero_inflated
FROM sales_daily GROUP BY drug_code"""
    q["series_profile"] = s + prof
    q["zero_inflated_suppliers"] = f"""WITH shipped AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS drug_code, CAST(l_shipdate AS DATE) AS date,
         CAST(trunc(sum(l_quantity)) AS INTEGER) AS q FROM lineitem GROUP BY ALL),
days AS (
  SELECT drug_code, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date
  FROM shipped GROUP BY drug_code),
sales_daily AS (
  SELECT d.drug_code, d.date, coalesce(s.q, 0) AS quantity_sold
  FROM days d LEFT JOIN shipped s ON s.drug_code = d.drug_code AND s.date = d.date)
SELECT * FROM ({prof}) WHERE zero_inflated"""
    q["zero_inflated_series"] = s + f"SELECT * FROM ({prof}) WHERE zero_inflated"

    # store
    q["upsert_items"] = s + """, meta AS (SELECT DISTINCT drug_code FROM sales_daily),
old AS (SELECT CAST(row_number() OVER (ORDER BY drug_code DESC) AS BIGINT) AS id, drug_code
        FROM meta WHERE length(drug_code) % 2 = 0)
SELECT id, drug_code, drug_code AS drug_name, drug_code AS atc_code FROM old
UNION ALL
SELECT CAST((SELECT max(id) FROM old) + row_number() OVER (ORDER BY drug_code) AS BIGINT),
       drug_code, drug_code, drug_code
FROM meta WHERE drug_code NOT IN (SELECT drug_code FROM old)"""
    q["upsert_sales"] = _with(SALES_SQL, LINES_SQL) + f"""SELECT drug_code, date, quantity_sold FROM line_counts
WHERE date >= DATE '{C.SALES_NEW_FROM}'
UNION ALL
SELECT drug_code, date, quantity_sold FROM sales_daily o
WHERE date <= DATE '{C.SALES_OLD_UNTIL}'
  AND NOT EXISTS (SELECT 1 FROM line_counts n WHERE n.date >= DATE '{C.SALES_NEW_FROM}'
                  AND n.drug_code = o.drug_code AND n.date = o.date)"""
    loaded = _with(SALES_SQL, LINES_SQL, ITEMS)
    q["store_first_load"] = loaded + """SELECT CAST(row_number() OVER (ORDER BY drug_id, date) AS BIGINT) AS id,
  drug_id, date, quantity_sold
FROM (SELECT i.id AS drug_id, b.date, max(b.quantity_sold) AS quantity_sold
      FROM (SELECT * FROM (SELECT drug_code, date, quantity_sold FROM sales_daily)
            UNION ALL SELECT drug_code, date, quantity_sold FROM line_counts) b
      JOIN items i ON i.drug_code = b.drug_code GROUP BY 1, 2)"""
    q["store_reload"] = loaded + f""", was AS (
  SELECT row_number() OVER (ORDER BY i.id, s.date) AS id, i.id AS drug_id, s.date, s.quantity_sold
  FROM sales_daily s JOIN items i ON i.drug_code = s.drug_code WHERE s.date <= DATE '{C.SALES_OLD_UNTIL}'),
batch AS (
  SELECT i.id AS drug_id, l.date, l.quantity_sold FROM line_counts l JOIN items i ON i.drug_code = l.drug_code
  WHERE l.date >= DATE '{C.SALES_NEW_FROM}')
SELECT CAST(w.id AS BIGINT) AS id, w.drug_id, w.date, coalesce(b.quantity_sold, w.quantity_sold) AS quantity_sold
FROM was w LEFT JOIN batch b ON b.drug_id = w.drug_id AND b.date = w.date
UNION ALL
SELECT CAST((SELECT max(id) FROM was) + row_number() OVER (ORDER BY drug_id, date) AS BIGINT),
       drug_id, date, quantity_sold
FROM batch b WHERE NOT EXISTS (SELECT 1 FROM was w WHERE w.drug_id = b.drug_id AND w.date = b.date)"""
    q["store_created_at"] = loaded + f""", was AS (
  SELECT i.id AS drug_id, s.date FROM sales_daily s JOIN items i ON i.drug_code = s.drug_code
  WHERE s.date <= DATE '{C.SALES_OLD_UNTIL}'),
batch AS (
  SELECT i.id AS drug_id, l.date FROM line_counts l JOIN items i ON i.drug_code = l.drug_code
  WHERE l.date >= DATE '{C.SALES_NEW_FROM}')
SELECT drug_id, from_first_write, count(*) AS n_rows, count(*) AS n_stamped, CAST(1 AS BIGINT) AS n_stamps
FROM (SELECT drug_id, true AS from_first_write FROM was
      UNION ALL SELECT drug_id, false FROM batch b
      WHERE NOT EXISTS (SELECT 1 FROM was w WHERE w.drug_id = b.drug_id AND w.date = b.date))
GROUP BY ALL"""
    readable = "dayofyear(date) % 40 <> 0 AND dayofyear(date) % 41 <> 0"
    q["csv_ingest"] = s + f"""SELECT date, drug_code, quantity_sold FROM sales_daily WHERE {readable}"""
    q["csv_rejected"] = s + f"""SELECT CASE WHEN dayofyear(date) % 40 = 0 THEN 'unreadable line'
  ELSE 'unreadable date' END AS reason, count(*) AS n_lines
FROM (SELECT DISTINCT date FROM sales_daily WHERE NOT ({readable})) GROUP BY ALL"""
    q["registered_forecaster"] = s + f"""SELECT drug_code, 'History Mean' AS model_name,
  CAST(last + CAST(i AS INTEGER) AS DATE) AS date, {_r('m', 'predicted_demand')},
  {_r('m - d', 'lower_ci')}, {_r('m + d', 'upper_ci')}
FROM (SELECT drug_code, max(date) AS last, avg(quantity_sold) AS m, stddev_samp(quantity_sold) AS d
      FROM sales_daily GROUP BY 1), range(1, {H} + 1) t(i)"""
    q["store_delete"] = loaded + f"""SELECT i.id AS drug_id, s.drug_code, s.date, s.quantity_sold
FROM sales_daily s JOIN items i ON i.drug_code = s.drug_code WHERE s.drug_code <> '{C.DELETED_CODE}'"""
    st = _with(*STORE)
    q["sales_with_ids"] = st + "SELECT drug_id, date, quantity_sold FROM sales"
    q["forecast_records"] = st + "SELECT * FROM forecasts"
    q["dq_constraints"] = st + """SELECT 'drugs.drug_code not null' AS rule, CAST(count(*) FILTER (WHERE drug_code IS NULL) AS BIGINT) AS violations FROM items
UNION ALL SELECT 'drugs.drug_name not null', count(*) FILTER (WHERE drug_name IS NULL) FROM items
UNION ALL SELECT 'drugs.drug_code unique', (SELECT count(*) FROM (SELECT drug_code FROM items GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'sales_daily (drug_id, date) unique', (SELECT count(*) FROM (SELECT drug_id, date FROM sales GROUP BY 1, 2 HAVING count(*) > 1))
UNION ALL SELECT 'sales_daily.quantity_sold >= 0', count(*) FILTER (WHERE quantity_sold < 0) FROM sales
UNION ALL SELECT 'sales_daily not null', count(*) FILTER (WHERE quantity_sold IS NULL OR date IS NULL OR drug_id IS NULL) FROM sales
UNION ALL SELECT 'sales_daily.drug_id references drugs', count(*) FROM sales WHERE drug_id NOT IN (SELECT id FROM items)
UNION ALL SELECT 'forecasts_daily.drug_id references drugs', count(*) FROM forecasts WHERE drug_id NOT IN (SELECT id FROM items)
UNION ALL SELECT 'forecasts_daily not null', count(*) FILTER (WHERE predicted_demand IS NULL OR model_name IS NULL OR run_timestamp IS NULL OR forecast_date IS NULL OR drug_id IS NULL) FROM forecasts
UNION ALL SELECT 'forecasts_daily lower <= predicted <= upper (info)', count(*) FILTER (WHERE NOT coalesce(lower_ci <= predicted_demand AND predicted_demand <= upper_ci, true)) FROM forecasts"""
    q["cascade_delete"] = st + f"""SELECT * FROM forecasts
WHERE drug_id NOT IN (SELECT id FROM items WHERE drug_code = '{C.DELETED_CODE}')"""
    q["latest_forecasts"] = st + """SELECT id, drug_id, forecast_date, run_timestamp, predicted_demand, lower_ci,
  upper_ci, model_name FROM (
  SELECT *, row_number() OVER (PARTITION BY drug_id, forecast_date ORDER BY run_timestamp DESC, id) AS rn
  FROM forecasts) WHERE rn = 1"""

    q["json_round_trip"] = q["latest_forecasts"]

    # reports
    view = """SELECT i.drug_code, i.drug_name, s.date, s.quantity_sold
FROM sales s JOIN items i ON s.drug_id = i.id"""
    q["view_sales"] = st + view
    q["view_sales_filtered"] = st + view + f" WHERE i.drug_code = '{C.FILTER_CODE}'"
    q["sales_head"] = st + view + " ORDER BY i.drug_code, s.date LIMIT 10"
    q["describe_sales"] = st + f"""SELECT drug_code, count(quantity_sold) AS count,
  ROUND(avg(quantity_sold), 6) AS mean, ROUND(stddev_samp(quantity_sold), 6) AS std,
  ROUND(CAST(min(quantity_sold) AS DOUBLE), 6) AS min,
  ROUND(quantile_cont(quantity_sold, 0.25), 6) AS p25, ROUND(quantile_cont(quantity_sold, 0.5), 6) AS p50,
  ROUND(quantile_cont(quantity_sold, 0.75), 6) AS p75, ROUND(CAST(max(quantity_sold) AS DOUBLE), 6) AS max
FROM ({view}) GROUP BY drug_code"""
    q["describe_sales_overall"] = st + f"""SELECT count(quantity_sold) AS count,
  ROUND(avg(quantity_sold), 6) AS mean, ROUND(stddev_samp(quantity_sold), 6) AS std,
  ROUND(CAST(min(quantity_sold) AS DOUBLE), 6) AS min,
  ROUND(quantile_cont(quantity_sold, 0.25), 6) AS p25, ROUND(quantile_cont(quantity_sold, 0.5), 6) AS p50,
  ROUND(quantile_cont(quantity_sold, 0.75), 6) AS p75, ROUND(CAST(max(quantity_sold) AS DOUBLE), 6) AS max
FROM ({view})"""
    q["risk_ranking"] = st + """, per_run AS (
  SELECT drug_id, run_timestamp, ROUND(avg(CAST(predicted_demand AS DOUBLE)), 6) AS avg_forecast
  FROM forecasts GROUP BY ALL),
newest AS (
  SELECT drug_id, arg_max(avg_forecast, run_timestamp) AS avg_forecast, max(run_timestamp) AS latest_run
  FROM per_run GROUP BY drug_id),
leveled AS (
  SELECT *, CASE WHEN avg_forecast <= 500 THEN 'low' WHEN avg_forecast <= 1000 THEN 'medium' ELSE 'high' END AS risk_level
  FROM newest)
SELECT i.id, i.drug_code, i.drug_name, avg_forecast, latest_run, risk_level,
       upper(risk_level[1]) || risk_level[2:] AS risk_label
FROM leveled n, items i WHERE i.id = n.drug_id
QUALIFY row_number() OVER (ORDER BY avg_forecast DESC, i.drug_code) <= 10"""
    q["risk_ranking_sql"] = q["risk_ranking"]
    counts = """counts AS (
  SELECT i.id, i.drug_code, i.drug_name, i.atc_code,
         coalesce((SELECT count(*) FROM sales s WHERE s.drug_id = i.id), 0) AS sales_count,
         coalesce((SELECT count(*) FROM forecasts f WHERE f.drug_id = i.id), 0) AS forecast_count
  FROM items i)"""
    q["item_overview"] = _with(*STORE, counts) + """SELECT id, drug_code, drug_name,
  coalesce(nullif(atc_code, ''), '-') AS atc_display, sales_count, forecast_count FROM counts"""
    q["dashboard_cards"] = _with(*STORE, counts) + """SELECT count(*) AS total_items,
  count(*) FILTER (WHERE forecast_count > 0) AS items_with_forecasts,
  CAST(coalesce(sum(sales_count), 0) AS BIGINT) AS total_sales_records FROM counts"""
    since = f"DATE '{C.AS_OF}' - INTERVAL 120 MONTH"
    q["item_stats"] = _with(*STORE, ITEM_FC) + f"""SELECT i.id, i.drug_code, i.drug_name,
  coalesce(nullif(i.atc_code, ''), 'N/A') AS atc_display,
  coalesce(s.sales_records, 0) AS sales_records, coalesce(f.forecast_points, 0) AS forecast_points,
  f.last_run, coalesce(ROUND(s.avg_q, 1), 0.0) AS avg_daily_demand
FROM items i
LEFT JOIN (SELECT drug_id, count(*) AS sales_records, avg(quantity_sold) AS avg_q FROM sales
           WHERE date >= {since} GROUP BY 1) s ON s.drug_id = i.id
LEFT JOIN (SELECT drug_id, count(*) AS forecast_points, max(run_timestamp) AS last_run FROM item_fc
           GROUP BY 1) f ON f.drug_id = i.id"""
    q["item_sales_history"] = st + f"SELECT * FROM sales WHERE date >= {since}"
    q["latest_run_forecasts"] = _with(*STORE, NEWEST) + """SELECT n.*, i.drug_code, i.drug_name
FROM newest n JOIN items i ON n.drug_id = i.id"""
    q["forecast_range"] = st + f"""SELECT f.*, i.drug_code, i.drug_name FROM forecasts f JOIN items i ON f.drug_id = i.id
WHERE f.drug_id = {C.ITEM_ID} AND f.forecast_date >= DATE '{C.RANGE_FROM}' AND f.forecast_date <= DATE '{C.RANGE_TO}'
  AND f.run_timestamp = (SELECT max(run_timestamp) FROM forecasts WHERE drug_id = {C.ITEM_ID})"""
    q["item_by_id"] = st + f"SELECT * FROM items WHERE id = {C.ITEM_ID}"
    q["recent_sales"] = st + """SELECT * FROM (
  SELECT drug_id, date, quantity_sold, CAST(row_number() OVER (PARTITION BY drug_id ORDER BY date DESC) AS INTEGER) AS rank
  FROM sales) WHERE rank <= 10"""
    q["item_forecasts"] = _with(*STORE, ITEM_FC) + """SELECT id, drug_id, forecast_date, run_timestamp,
  predicted_demand, lower_ci, upper_ci, model_name FROM item_fc"""
    q["chart_series"] = _with(*STORE, ITEM_FC) + f"""SELECT drug_id, strftime(date, '%Y-%m-%d') AS date,
  quantity_sold AS actual, CAST(NULL AS DOUBLE) AS predicted, CAST(NULL AS DOUBLE) AS lower_ci,
  CAST(NULL AS DOUBLE) AS upper_ci
FROM sales WHERE date >= {since}
UNION ALL
SELECT drug_id, strftime(forecast_date, '%Y-%m-%d'), NULL, CAST(predicted_demand AS DOUBLE),
  CASE WHEN lower_ci <> 0 THEN CAST(lower_ci AS DOUBLE) END,
  CASE WHEN upper_ci <> 0 THEN CAST(upper_ci AS DOUBLE) END
FROM item_fc"""
    q["run_totals"] = _with(*STORE, NEWEST) + """SELECT count(DISTINCT drug_id) AS series_forecast,
  count(*) AS forecasts_generated FROM newest"""

    # operators around the fitted model, with stand-ins
    eligible = f"""enough AS (
  SELECT * FROM pos WHERE n >= {DEFAULT.min_history_days})"""
    q["boosted_fold_sizes"] = _with(SALES_SQL, POS, eligible) + f"""SELECT drug_code, fold,
  count(*) FILTER (WHERE idx < start - {T}) AS n_train,
  count(*) FILTER (WHERE idx >= start - {T} AND idx < start) AS n_valid,
  count(*) FILTER (WHERE idx >= start) AS n_test
FROM (SELECT e.drug_code, e.idx, CAST({NF} + 1 - k AS INTEGER) AS fold, e.n - k * {T} AS start
      FROM enough e, range(1, {NF} + 1) f(k))
WHERE start >= {DEFAULT.min_history_days} AND idx < start + {T}
GROUP BY ALL"""
    q["model_reload"] = _with(SALES_SQL, POS, eligible) + f"""SELECT drug_code, date,
  CAST(0 AS DOUBLE) AS predicted_demand_change, CAST(0 AS DOUBLE) AS lower_ci_change,
  CAST(0 AS DOUBLE) AS upper_ci_change
FROM enough e WHERE date > (SELECT max(date) FROM enough x WHERE x.drug_code = e.drug_code) - {T}"""
    q["pinball_leaves_stand_in"] = _with(SALES_SQL, POS, eligible) + f"""
SELECT leaf, max(error) FILTER (WHERE r = greatest(1, ceil({DEFAULT.interval_alpha_low} * m))) AS lower_value,
       max(error) FILTER (WHERE r = ceil({DEFAULT.interval_alpha_high} * m)) AS upper_value
FROM (SELECT leaf, error, row_number() OVER (PARTITION BY leaf ORDER BY error) AS r,
             count(*) OVER (PARTITION BY leaf) AS m
      FROM (SELECT e.drug_code || '/' || (isodow(e.date) - 1) AS leaf,
                   CAST(e.quantity_sold - coalesce(b.quantity_sold, 0) AS DOUBLE) AS error
            FROM enough e LEFT JOIN enough b ON b.drug_code = e.drug_code AND b.idx = e.idx - 7))
GROUP BY leaf"""
    last_known = """ends AS (SELECT drug_code, max(date) AS last FROM enough GROUP BY 1)"""
    steps = f"""steps AS (SELECT e.*, unnest(range(1, {H} + 1)) AS i FROM ends e)"""
    # lag 1 repeats the last value; lag 7 repeats the last seven days (0 if missing)
    for lag in (1, 7):
        q[f"recursion_by_lag_{lag}"] = _with(SALES_SQL, POS, eligible, last_known, steps) + f"""
SELECT s.drug_code, CAST(s.last + CAST(s.i AS INTEGER) AS DATE) AS date,
       CAST(coalesce(e.quantity_sold, 0) AS DOUBLE) AS predicted_demand
FROM steps s LEFT JOIN enough e
  ON e.drug_code = s.drug_code AND e.idx >= e.n - {max(DEFAULT.lags)}
 AND e.date = s.last - CAST({lag} - 1 - (s.i - 1) % {lag} AS INTEGER)"""
    q["forecasting_run_stand_in"] = _with(SALES_SQL, ITEMS, POS, eligible, last_known, steps) + f"""
SELECT i.id AS drug_id, s.drug_code, CAST(s.last + CAST(s.i AS INTEGER) AS DATE) AS forecast_date,
       TIMESTAMP '{RUN_1}' AS run_timestamp,
       CAST(coalesce(e.quantity_sold, 0) AS DECIMAL(10, 2)) AS predicted_demand,
       CAST(NULL AS DECIMAL(10, 2)) AS lower_ci, CAST(NULL AS DECIMAL(10, 2)) AS upper_ci,
       'Last Week' AS model_name
FROM steps s JOIN items i ON i.drug_code = s.drug_code LEFT JOIN enough e
  ON e.drug_code = s.drug_code AND e.idx >= e.n - {max(DEFAULT.lags)}
 AND e.date = s.last - CAST(7 - 1 - (s.i - 1) % 7 AS INTEGER)"""
    q["bounded_predictions"] = _with(SALES_SQL) + f"""SELECT drug_code, date,
  greatest(0, p) AS predicted_demand,
  CASE WHEN both_known THEN greatest(0, p - abs(spread)) END AS lower_ci,
  CASE WHEN both_known THEN greatest(0, p + abs(spread)) END AS upper_ci
FROM (SELECT *, date <> last_day(date) AND day(date) <> 1 AS both_known,
             CAST(l7 AS DOUBLE) - CASE WHEN isodow(date) >= 6 THEN 400 ELSE 0 END AS p,
             l1 - l14 AS spread
      FROM (SELECT drug_code, date, count(*) OVER (PARTITION BY drug_code) AS n,
                   coalesce({_lag(1)}, 0) AS l1, coalesce({_lag(7)}, 0) AS l7,
                   coalesce({_lag(14)}, 0) AS l14 FROM sales_daily))
WHERE n >= {DEFAULT.min_history_days}"""
    stand_in = """, with_model AS (
  SELECT drug_code, model_name, mae, rmse, mape, n_folds FROM cv
  UNION ALL
  SELECT drug_code, 'Boosted Trees', 0.9 * mae, 0.9 * rmse, 0.9 * mape, n_folds FROM cv
  WHERE model_name = 'Naive')
"""
    q["comparison_stand_in"] = pcv + stand_in + best + f", {MODEL_RANK} AS model_rank FROM with_model"
    q["improvement_stand_in"] = pcv + stand_in + """, means AS (
  SELECT model_name, avg(mape) AS m FROM with_model GROUP BY 1),
two AS (
  SELECT min(m) FILTER (WHERE model_name <> 'Boosted Trees') AS base,
         max(m) FILTER (WHERE model_name = 'Boosted Trees') AS model FROM means)
SELECT 'Boosted Trees' AS model_name, ROUND(base, 6) AS best_baseline_mape, ROUND(model, 6) AS model_mape,
       ROUND((base - model) / nullif(base, 0) * 100, 6) AS improvement_pct FROM two"""
    return q
