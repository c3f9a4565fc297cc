import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from loomspan.functions import registry
from loomspan.plans import run
from loomspan.queries import research
from loomspan.sources import tables


def test_catalog_and_elision(spark, sf):
    cat = tables.Catalog(spark, sf)
    assert {"daily", "daily_basic", "trade_cal"} <= set(cat.tables())
    with pytest.raises(KeyError, match="daily"):
        cat.read("dayly")
    with pytest.raises(KeyError):
        cat.supply(["nothing_like_it"], ["daily"])
    plain = tables.load_daily(cat, ["close"], "2025-02-01", "2025-02-28", extra=["daily_basic"])
    plan = plain._jdf.queryExecution().executedPlan().toString()
    assert "daily_basic" not in plan and "PushedFilters" in plan and "GreaterThanOrEqual(trade_date" in plan
    assert "circ_mv" in tables.load_daily(cat, ["close", "circ_mv"], extra=["daily_basic"]).columns


def test_load_daily_keeps_every_row_once(spark, sf, tmp_path):
    d = dt.date(2025, 2, 3)
    spark.createDataFrame([("a", d, 1.0), ("a", d, 2.0), ("b", d, 3.0), (None, d, 4.0)], "ts_code string, trade_date date, close double").write.parquet(str(tmp_path / "daily"))
    spark.createDataFrame([("a", d, 7.0), ("a", d, 9.0), ("a", d, None), (None, d, 1.0)], "ts_code string, trade_date date, circ_mv double").write.parquet(str(tmp_path / "daily_basic"))
    got = tables.load_daily(tables.Catalog(spark, str(tmp_path)), ["close", "circ_mv"], extra=["daily_basic"]).select("close", "circ_mv")
    assert sorted(map(tuple, got.collect())) == [(1.0, 9.0), (2.0, 9.0), (3.0, None), (4.0, None)]
    whole, month = (research.QUERIES[q](spark, sf) for q in ("source_load_daily", "source_daily_enriched"))
    assert whole.count() == spark.read.parquet(f"{sf}/daily.parquet").count()
    assert whole.select(F.month("trade_date")).distinct().count() == 12 and month.select(F.month("trade_date")).distinct().count() == 1


def test_monthly_roundtrip_replaces_only_its_months(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2025, 1, 5), 1), (dt.date(2025, 2, 5), 2)], "d date, x int")
    tables.write_monthly(df, str(tmp_path / "t"), "d")
    tables.write_monthly(df.where("x = 2").withColumn("x", F.lit(3)), str(tmp_path / "t"), "d")
    assert [r["x"] for r in tables.read_month(spark, str(tmp_path / "t"), 2025, 2, ["x"]).collect()] == [3]
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_text_forms(spark):
    df = spark.createDataFrame([("1.5亿", 93000500), ("-3.4万", 145959999), ("56", 240000000), ("x", None)], "t string, h long")
    assert [tuple(r) for r in df.select(tables.amount_text(F.col("t")), tables.ms_of_day(F.col("h"))).collect()] == [(1.5e8, 34200500), (-34000.0, 53999999), (56.0, None), (None, None)]


def test_gbk_ticks(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes("名称,价\n平安,105\n坏行\n".encode("gbk"))
    assert tables.read_ticks(spark, str(tmp_path / "t.csv"), "name string, price int").collect()[0]["name"] == "平安"


def test_run_and_artifact(spark, tmp_path):
    rows = [(f"c{c}", dt.date(2024, 1, 1) + dt.timedelta(days=i), 10.0 + (c * i) % 7) for c in range(12) for i in range(30)]
    df = spark.createDataFrame(rows, "code string, date date, close double")
    spec = run.Spec.of({"name": "m", "formula": "signal = ts_delta(close, 1)", "process": ["zscore"], "universe": "close > 0", "horizon": 1, "start": "2024-01-05"})
    s = run.run_factor(df, spec)
    assert s.agg(F.min("date")).first()[0] == dt.date(2024, 1, 5) and run.evaluate_factor(s, spec)["n_dates"] > 10
    meta = tables.write_artifact(s.select("date", "code", "signal"), str(tmp_path / "a"), {"name": "m"})
    got, again = tables.read_artifact(spark, str(tmp_path / "a"))
    assert got.count() == meta["rows"] == again["rows"]
    with pytest.raises(FileNotFoundError):
        tables.read_artifact(spark, str(tmp_path / "b"))
    with pytest.raises(ValueError):
        run.Spec.of({"name": "m", "formula": "a = close", "nosuch": 1})


def test_plugins_roll_back(tmp_path):
    good, bad = tmp_path / "g.py", tmp_path / "b.py"
    good.write_text("from loomspan.functions.registry import factor_op\nfactor_op('ts_plugin_x', 'ts', 1)(lambda c, x: x)\n")
    bad.write_text("from loomspan.functions.registry import factor_op\nfactor_op('zz_plugin', 'ts', 1)(lambda c, x: x)\n")
    run.load_plugin(str(good))
    assert "ts_plugin_x" in registry.OPS
    registry.OPS.pop("ts_plugin_x")
    with pytest.raises(ValueError):
        run.load_plugin(str(bad))
    assert "zz_plugin" not in registry.OPS


def test_command_line(capsys):
    assert run.main(["ops", "--kind", "gp"]) == 0 and "gp_rank" in capsys.readouterr().out
    assert run.main(["lint", "a = ts_mean(close, 3)", "--columns", "close"]) == 0 and json.loads(capsys.readouterr().out)["columns"] == ["close"]
    assert run.main(["lint", "a = close and open"]) == 1
