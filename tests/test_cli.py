"""End to end: the command line runs the whole forecasting run into a store."""

import pytest

from demand_engine.__main__ import main
from demand_engine.sources.store import ParquetStore


def test_run_then_view_sales(spark, tmp_path, capsys):
    wh, models = str(tmp_path / "wh"), str(tmp_path / "models")
    report = str(tmp_path / "report")
    main(["run", "--sf-dir", "/root/testdata/sf0.001", "--store", wh, "--models", models,
          "--horizon", "7", "--max-rounds", "6", "--report", report])
    out = capsys.readouterr().out
    assert "Boosted Trees" in out and "Moving Average" in out
    assert spark.read.json(report).select("drug_code").distinct().count() == 6
    st = ParquetStore(spark, wh)
    assert st.read("drugs").count() == 6
    fc = st.read("forecasts_daily")
    assert fc.count() == 6 * 7 and {r.model_name for r in fc.select("model_name").collect()} == {"Boosted Trees"}
    main(["view-sales", "--store", wh, "--code", "PROMO"])
    assert "PROMO" in capsys.readouterr().out


def test_run_requires_a_source():
    with pytest.raises(SystemExit):
        main(["run", "--store", "/tmp/nowhere"])
