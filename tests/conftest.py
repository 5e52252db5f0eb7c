import datetime as dt
import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from demand_engine import get_spark
    yield get_spark("local[4]", 8, extra_conf={
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})


@pytest.fixture(scope="session")
def sample_pdf() -> pd.DataFrame:
    """Half a year of one item: a weekly rhythm on a slow rise, whole numbers."""
    start, n = dt.date(2019, 11, 4), 182
    demand = [60 + i // 6 + 9 * (i % 7) + (i * i) % 5 for i in range(n)]
    return pd.DataFrame({"date": [start + dt.timedelta(days=i) for i in range(n)],
                         "drug_code": "RHYTHM", "quantity_sold": demand})


@pytest.fixture(scope="session")
def sample_sales(spark, sample_pdf):
    return spark.createDataFrame(sample_pdf, "date date, drug_code string, quantity_sold int")


@pytest.fixture(scope="session")
def multi_sales(spark):
    """Several series with gaps, a one-row series, an all-zero series, a short series."""
    rng = np.random.default_rng(7)
    rows = []
    start = dt.date(2021, 1, 1)
    for code, n, gap_every in (("GAPS", 200, 9), ("FULL", 160, 0), ("ZERO", 130, 0),
                               ("SHORT", 45, 0), ("ONE", 1, 0), ("DUPS", 150, 0)):
        d = start
        for i in range(n):
            if gap_every and i % gap_every == 4:
                d += dt.timedelta(days=1)          # skip a day
            q = 0 if code == "ZERO" else int(rng.integers(0, 120))
            rows.append((d, code, q))
            if code != "DUPS" or i % 10 != 3:      # DUPS: every 10th day appears twice
                d += dt.timedelta(days=1)
    return spark.createDataFrame(rows, "date date, drug_code string, quantity_sold int")
