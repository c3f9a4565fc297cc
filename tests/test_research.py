import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.functions import recursive
from loomspan.operators import evaluate, orderbook, portfolio, process, rules

D = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)


def test_newey_west():
    x = [1.0, 2.0, 3.0, 4.0]
    e = np.array(x) - 2.5
    assert math.isclose(evaluate.newey_west_t(x, 0), 2.5 / math.sqrt(e @ e / 4 / 4))
    assert math.isnan(evaluate.newey_west_t([1.0]))


def test_chain_parsing_and_unknown(spark):
    assert process.parse_item("winsorize(0.9)") == ("winsorize", [0.9], {})
    assert process.parse_item("fillna(method: industry_mean, value=1)") == ("fillna", [], {"method": "industry_mean", "value": 1.0})
    df = spark.createDataFrame([(D(0), "a", 1.0)], "date date, code string, signal double")
    with pytest.raises(ValueError):
        process.run_chain(df, ["nosuch"])
    with pytest.raises(ValueError):
        process.run_chain(df, ["neutralize(by=industry)"])
    assert process.run_chain(df, ["zscore"]).first()["signal"] is None


def test_buffer_keeps_holdings(spark):
    rows = [(D(0), "a", 3.0), (D(0), "b", 2.0), (D(0), "c", 1.0), (D(1), "c", 3.0), (D(1), "b", 2.5), (D(1), "a", 2.0), (D(2), "d", 9.0), (D(2), "c", 3.0), (D(2), "b", 2.0), (D(2), "a", 1.0)]
    df = spark.createDataFrame(rows, "date date, code string, signal double")
    got = {}
    for r in portfolio.buffered_top_k(df, 1, 2).collect():
        got.setdefault(r["decision_date"], []).append(r["code"])
    assert got == {D(0): ["a"], D(1): ["c"], D(2): ["c"]}


def test_account_identities(spark):
    px = spark.createDataFrame([(D(i), c, p + i, p + i) for i in range(6) for c, p in (("a", 10.0), ("b", 20.0))], "date date, code string, open double, close double")
    t = spark.createDataFrame([(D(0), "a", 0.5), (D(0), "b", 0.5), (D(3), "b", 1.0)], "decision_date date, code string, target_weight double")
    free = portfolio.Costs(0, 0, 0, 0, 0)
    got = portfolio.simulate(px, t, t, 1e5, free).orderBy("date").collect()
    assert [r["date"] for r in got] == [D(i) for i in range(1, 6)] and got[0]["nav"] == 1e5 and got[0]["fees"] == 0
    a, b = 45 * 100, 23 * 100
    a = int(0.5e5 / 11) // 100 * 100
    b = int(0.5e5 / 21) // 100 * 100
    assert math.isclose(got[1]["nav"], 1e5 + a + b) and got[0]["n_held"] == 2 and got[-1]["n_held"] == 1
    paid = portfolio.simulate(px, t, t, 1e5).orderBy("date").collect()
    assert all(r["cash"] >= 0 for r in paid) and paid[0]["nav"] < 1e5 and paid[0]["fees"] > 0


def test_lots_and_fillability(spark):
    df = spark.createDataFrame([(250, 180), (99, 99), (1000, 5000)], "q long, h long")
    assert [tuple(r) for r in df.select(portfolio.lot_quantity(F.col("q")), portfolio.sell_quantity(F.col("q"), F.col("h"))).collect()] == [(200, 180), (0, 99), (1000, 1000)]
    f = spark.createDataFrame([("BUY", True, True, False, 11.0, 11.0, 9.0), ("SELL", True, True, False, 11.0, 11.0, 9.0), ("BUY", True, True, True, 10.0, 11.0, 9.0), ("BUY", False, True, False, 10.0, 11.0, 9.0)], "side string, has_daily boolean, has_limit boolean, is_suspended_at_open boolean, open double, up_limit double, down_limit double")
    assert [r[0] for r in f.select(portfolio.fillability(f)).collect()] == ["UP_LIMIT", "FILLABLE", "SUSPENDED", "NO_DATA"]


def test_fifo(spark):
    ev = [(1, "add", "B", 10, 5, 1), (2, "add", "B", 10, 7, 2), (3, "fill", "B", 10, 5, 1), (4, "cancel", "B", 10, 2, 2), (4, "add", "B", 10, 1, 3)]
    df = spark.createDataFrame([("c", D(0), ms, i, k, s, p, q, o) for i, (ms, k, s, p, q, o) in enumerate(ev)], "code string, date date, ms long, seq long, kind string, side string, price long, qty long, id long")
    got = {r["id"]: (r["ahead"], r["filled"], r["left"], r["lifetime_ms"]) for r in orderbook.replay_fifo(df).collect()}
    assert got[1] == (0, 5, 0, 2.0) and got[2][:3] == (5, 0, 5) and got[3][0] == 7


def test_price_limits(spark):
    df = spark.createDataFrame([("a", D(i), 10.05) for i in range(7)], "code string, date date, pre_close double")
    got = rules.price_limits(df, {"main": 10}, F.lit("main")).orderBy("date").collect()
    assert got[4]["up_limit"] is None and (got[5]["up_limit"], got[5]["down_limit"]) == (11.06, 9.05)


def test_rule_split_and_verdict(spark):
    rows = [("000001.SZ", D(0), 10.0, 9.0, 9.5, 9.8, 9.8, 1.0, 1.0), ("000002.SZ", D(0), 10.0, 11.0, 9.5, 9.8, 9.8, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "code string, date date, open double, high double, low double, close double, pre_close double, vol double, amount double")
    v = rules.violations(df, rules.daily_rules(), ["code", "date"])
    clean, bad = rules.split(df, v, ["code", "date"])
    assert clean.count() == 1 and bad.count() == 1 and rules.verdict(v, 2).first()["status"] == "FAIL"


def test_bootstrap_is_seeded(spark):
    df = spark.createDataFrame([(0.01 * i,) for i in range(50)], "ret double").coalesce(1)
    a = [r[1] for r in portfolio.bootstrap(df, 20).orderBy("replicate").collect()]
    assert a == [r[1] for r in portfolio.bootstrap(df, 20).orderBy("replicate").collect()] and len(set(a)) > 10


def test_drift_and_missing(spark):
    a = spark.createDataFrame([(float(i),) for i in range(200)], "x double")
    same, far = rules.drift(a, a, ["x"]).first()["psi"], rules.drift(a, a.withColumn("x", F.col("x") + 150), ["x"]).first()["psi"]
    assert same < 1e-9 and far > 1
    d = spark.createDataFrame([("a", D(1)), ("a", D(3))], "code string, date date")
    days = spark.createDataFrame([(D(i),) for i in range(6)], "date date")
    listing = spark.createDataFrame([("a", D(1), D(5)), ("b", None, None)], "code string, list_date date, delist_date date")
    got = {(r["code"], r["date"]): r["cause"] for r in rules.classify_missing(d, listing, days).collect()}
    assert got == {("a", D(0)): "before_listing", ("a", D(2)): "gap", ("a", D(4)): "terminal", ("a", D(5)): "after_delisting", **{("b", D(i)): "terminal" for i in range(6)}}


def test_market_open(spark):
    from loomspan.sources import tables

    codes = spark.createDataFrame([("a",), ("b",)], "code string")
    daily = spark.createDataFrame([("a", D(1), 10.0), ("a", D(2), 11.0)], "code string, date date, open double")
    lim = spark.createDataFrame([("a", D(1), 11.0, 9.0)], "code string, date date, up_limit double, down_limit double")
    sus = spark.createDataFrame([("b", D(1)), ("b", D(1))], "code string, date date")
    got = {r["code"]: (r["has_daily"], r["has_limit"], r["is_suspended_at_open"]) for r in tables.market_open(codes, daily, lim, sus, D(1)).collect()}
    assert got == {"a": (True, True, False), "b": (False, False, True)}
    with pytest.raises(ValueError):
        tables.market_open(codes, daily, lim, sus, D(4))


def test_lag_rules_go_by_the_full_order(spark):
    cols = "code string, date date, open double, high double, low double, close double, pre_close double, vol double, amount double, id long"
    day = lambda i, close, k: ("000001.SZ", D(i), close, close, close, close, close, 1.0, 1.0, k)
    r = [day(0, 10.0, 1), day(1, 10.0, 2), day(1, 20.0, 3), day(2, 20.0, 4)]
    for rows in (r, r[::-1]):
        v = rules.violations(spark.createDataFrame(rows, cols).coalesce(1), rules.daily_rules(order=["id"]), ["id"])
        assert sorted((x["id"], x["rule"]) for x in v.collect()) == [(2, "duplicate_key"), (3, "duplicate_key"), (3, "jump"), (3, "order_of_days"), (3, "pre_close_gap")]


def test_chips_keep_their_step_over_a_wide_price_range():
    day = lambda lo, hi: (hi, lo, (lo + hi) / 2, 1.0, lo + 0.55)
    near, far = day(10.0, 11.0), day(10000.0, 10001.0)
    for part in ("winner", "cost"):
        alone, after = (recursive.chips(np.array(x).T, part, 0.1, 1.0, 0.5)[-1] for x in ([near], [far, near]))
        assert abs(alone - after) <= 0.1 and 0 < after != 10.0


def test_day_stats_of_fills_without_quantity(spark, tmp_path):
    """A day whose fills are all of quantity 0 has 0 / 0 as its share of large fills, as in SQL; the other days keep theirs."""
    from loomspan.queries import research
    from tests.oracle import connect, differences

    at = lambda d, s: dt.datetime(2024, 1, d, 10, 0, s)
    rows = [(1, at(1, 0), 5, "view", 0.0), (2, at(1, 1), 5, "signup", 3.0), (3, at(2, 0), 5, "view", 0.0), (4, at(2, 1), 5, "click", 4.0), (5, at(3, 1), 5, "error", 2.0), (6, at(1, 1), 6, "view", 2.0), (7, at(1, 1), 6, "view", 0.0)]
    path = f"{tmp_path}/events.parquet"
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").toPandas().astype({"ts": "datetime64[us]"}).to_parquet(path)
    got = {(r["code"], r["date"].day): r["large_share"] for r in research.orderbook_day_stats(spark, str(tmp_path)).collect()}
    assert math.isnan(got.pop(("5", 1))) and got == {("5", 2): 1.0, ("5", 3): None, ("6", 1): 1.0}
    more, less = differences(spark, connect(str(tmp_path)), str(tmp_path), research.orderbook_day_stats, research.ORACLE["orderbook_day_stats"])
    assert not more and not less, (more, less)
