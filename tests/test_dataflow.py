import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.operators import dataflow, evaluate, orderbook
from loomspan.plans import run
from loomspan.session import on_one_machine

D = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)


def test_codes_that_multiply_or_collide_are_an_error(spark):
    df = spark.createDataFrame([("1",), ("2",), (None,)], "code string")
    m = lambda rows: spark.createDataFrame(rows, "raw string, name string")
    assert sorted((r["code"] or "", r["name"]) for r in dataflow.canonical_codes(df, m([("1", "a"), ("1", "a"), (None, "x")]), "raw", "name").collect()) == [("", None), ("1", "a"), ("2", None)]
    for rows in ([("1", "a"), ("1", "b")], [("1", "a"), ("2", "a")]):
        with pytest.raises(ValueError):
            dataflow.canonical_codes(df, m(rows), "raw", "name")


def test_dates_and_flags(spark):
    df = spark.createDataFrame([(D(i), i) for i in range(9)] + [(None, 99)], "date date, x int")
    assert {r["x"] for r in dataflow.last_dates(df, 3).collect()} == {6, 7, 8}
    one, two = ({r["x"] for r in dataflow.seeded_dates(df, 4, s).collect()} for s in (1, 2))
    assert len(one) == len(two) == 4 and one != two and one == {r["x"] for r in dataflow.seeded_dates(df.repartition(3), 4, 1).collect()}
    assert dataflow.last_dates(df.limit(0), 3).count() == 0
    got = dataflow.any_per_group(df, ["date"], big=F.col("x") > 5, none=F.lit(None).cast("boolean")).collect()
    assert {r["date"]: r["big"] for r in got}[D(6)] and not any(r["none"] for r in got)


def test_cancels_name_one_order(spark):
    rows = [("a", D(0), "add", 1, None, "B", 9.0), ("a", D(0), "add", 2, None, "B", 9.0), ("a", D(0), "add", 2, None, "S", 8.0), ("a", D(0), "cancel", 3, 1, None, None), ("a", D(0), "cancel", 4, 2, None, None), ("a", D(1), "cancel", 5, 1, None, None)]
    df = spark.createDataFrame(rows, "code string, date date, kind string, id long, ref long, side string, price double")
    assert {r["id"]: (r["add_side"], r["add_price"]) for r in dataflow.link_cancels(df).collect()} == {3: ("B", 9.0), 4: (None, None), 5: (None, None)}


def test_daily_values_on_the_grid(spark):
    bars = spark.createDataFrame([("a", D(2), 0, 5.0), ("a", D(3), 0, float("nan")), ("b", D(2), 0, None)], "code string, date date, minute_index int, amount double")
    daily = spark.createDataFrame([("a", D(0), 1.0, 10.0, 1.0), ("a", D(2), 2.0, 20.0, 3.0)], "code string, date date, close double, amount double, volume double")
    got = {(r["code"], r["date"]): r for r in dataflow.inject_daily(dataflow.with_trade(bars), daily, 2).collect()}
    assert [got[k]["has_trade"] for k in (("a", D(2)), ("a", D(3)), ("b", D(2)))] == [True, False, False]
    r = got["a", D(2)]
    assert (r["eod_close"], r["prev_close"], r["day_amt"], r["adv20_amt"], r["adv20_vol"]) == (2.0, 1.0, 20.0, 15.0, 2.0) and got["a", D(3)]["eod_close"] is None


def test_composite_by_a_function(spark):
    s = lambda f: spark.createDataFrame([(D(i), c, f(i, k)) for i in range(8) for k, c in enumerate("abcdef")], "date date, code string, signal double")
    a, b = s(lambda i, k: float(k + i % 2)), s(lambda i, k: None if k == 5 else float(-k * k))
    got = {(r["date"], r["code"]): r["signal"] for r in evaluate.composite_apply({"a": a, "b": b}, lambda x, p: np.where(x.index == "c", np.inf, x["a"] + p["w"] * x["b"].fillna(0)), {"w": 2}).collect()}
    assert len(got) == 48 and got[D(1), "b"] == 2.0 - 2.0 and got[D(0), "f"] == 5.0 and got[D(0), "c"] is None
    with pytest.raises(Exception, match="rows"):
        evaluate.composite_apply({"a": a}, lambda x, p: [1.0]).collect()
    labels = a.withColumnRenamed("signal", "y").withColumn("y", F.col("y") * 2)
    rep = {r["name"]: r for r in evaluate.composite_report(a, {"a": a, "b": b}, labels, "y").collect()}
    assert set(rep) == {"composite", "equal", "a", "b"} and abs(rep["composite"]["ic_mean"] - 1) < 1e-9 and abs(rep["composite"]["lift_best"]) < 2.1


def test_band_and_late_events(spark):
    lv = spark.createDataFrame([("B", 10.0, 5.0), ("B", 11.0, 0.0), ("B", 9.0, 1.0), ("B", 7.0, 1.0), ("S", 12.0, 1.0), ("S", 13.0, 1.0), ("S", 15.0, 2.0)], "side string, price double, level_qty double").withColumn("g", F.lit(1))
    assert sorted((r["side"], r["price"], r["best"]) for r in orderbook.near_best(lv, 1, 1.0, ["g"]).collect()) == [("B", 9.0, 10.0), ("B", 10.0, 10.0), ("B", 11.0, 10.0), ("S", 12.0, 12.0), ("S", 13.0, 12.0)]
    t = lambda s, ms=0: dt.datetime(2024, 1, 1, 9, 30, s, ms * 1000)
    df = spark.createDataFrame([(1, t(59), t(59, 500)), (2, t(59), dt.datetime(2024, 1, 1, 9, 31, 2)), (3, t(1), None)], "k int, ts timestamp, arrival timestamp")
    got = {r["k"]: (r["late"], r["bucket"].minute) for r in orderbook.attribute_late(df, "ts", "arrival").collect()}
    assert got == {1: (False, 30), 2: (True, 31), 3: (False, 30)}


def test_specs_from_files(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"name": "f", "formula": "a = close", "outputs": ["a"]}))
    assert run.Spec.load(str(tmp_path / "a.json")).outputs == ["a"]
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text("name: f\nformula: |\n  a = close\nprocess: [zscore]\n")
    assert run.Spec.load(str(tmp_path / "a.yaml")).process == ["zscore"]
    (tmp_path / "b.yaml").write_text("name: f\nformula: a = close\nhow: 1\n")
    with pytest.raises(ValueError, match="how"):
        run.Spec.load(str(tmp_path / "b.yaml"))


def test_only_a_local_master_may_make_its_own_folder():
    assert all(on_one_machine(m) for m in ("local", "local[4]", "local[*]"))
    assert not any(on_one_machine(m) for m in ("local-cluster[3,2,5000]", "yarn", "spark://host:7077", "k8s://x"))
