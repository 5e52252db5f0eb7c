"""Every registered SQL-checked query equals its DuckDB SQL at sf0.01."""

import re

import pytest

import __spark_entry__ as E
from tools.check_oracle import compare, duck

SF = "/root/testdata/sf0.01"
KEYS = sorted(k for k in E.oracle_sql() if not re.fullmatch(r"op\d+_\w+|pipeline", k))


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql_or_is_model_based():
    model_based = {"boosted_cv", "boosted_fit_summary", "leaf_quantiles", "boosted_predict",
                   "interval_coverage", "recursive_forecast", "model_comparison_full",
                   "ml_improvement"}
    documents = {k for k in E.queries() if re.fullmatch(r"op\d+_\w+|pipeline", k)}
    assert set(E.queries()) - set(E.oracle_sql()) - documents == model_based
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_sql(spark, con, key):
    issues, *_ = compare(spark, key, E.queries()[key], E.oracle_sql()[key], con, SF)
    assert not issues, issues


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "model_name" in df.columns
