import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from loomspan.operators import execution, score


def data(spark, n=600):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, 3))
    y = 1 + 2 * x[:, 0] - x[:, 1] + rng.normal(size=n) * 0.1
    d0 = dt.date(2022, 1, 1)
    rows = [(d0 + dt.timedelta(days=int(i) * 3), f"c{i % 7}", *map(float, x[i]), float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "date date, code string, a double, b double, c double, y double"), x, y


def test_models_from_moments(spark):
    df, x, y = data(spark)
    g = score.gram(score.moment_sums(df, ["a", "b", "c"], "y", []).first()["m"], 5)
    m = np.column_stack([np.ones(len(x)), x])
    assert np.allclose(score.ridge(g, 0.0), np.linalg.lstsq(m, y, rcond=None)[0], atol=1e-6)
    assert np.allclose(score.pls(g, 3), np.linalg.lstsq(m, y, rcond=None)[0], atol=1e-6)
    w = score.elastic_net(g, 0.05, 1.0)
    assert w[3] == 0 and w[1] > 1.8 and w[2] < -0.8
    assert score.feature_filter(df.withColumn("d", F.col("a") * 1.0001), ["a", "b", "c", "d"], "y", 0.1) in (["a", "b"], ["b", "d"])


def test_walk_forward_sees_only_the_past(spark):
    df, x, y = data(spark)
    s = score.walk_forward(df, ["a", "b", "c"], "y", "quarter", 2)
    assert s.agg(F.min("date")).first()[0] == dt.date(2022, 7, 2) or s.agg(F.min("date")).first()[0] >= dt.date(2022, 7, 1)
    j = s.join(df, ["date", "code"])
    assert j.agg(F.corr("signal", "y")).first()[0] > 0.99
    spoilt = df.withColumn("y", F.when(F.col("date") >= "2024-01-01", 1e6).otherwise(F.col("y")))
    cut = "2024-01-01"
    a = {(r["date"], r["code"]): r["signal"] for r in s.where(F.col("date") < cut).collect()}
    b = {(r["date"], r["code"]): r["signal"] for r in score.walk_forward(spoilt, ["a", "b", "c"], "y", "quarter", 2).where(F.col("date") < cut).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_huber_resists_outliers(spark):
    df, _, _ = data(spark, 200)
    df = df.withColumn("g", F.lit("g")).withColumn("y", F.when(F.col("a") > 1.8, 500.0).otherwise(F.col("y")))
    w = score.huber(df, ["a", "b", "c"], "y", "g", alpha=0.0, rounds=12).first()["w"]
    assert abs(w[1] - 2) < 0.3 and abs(w[2] + 1) < 0.3


def test_robust_z_and_screen(spark):
    df, _, _ = data(spark, 50)
    z = score.robust_z(df.withColumn("date", F.lit("2024-01-01").cast("date")), ["a"]).toPandas()
    assert abs(np.median(z.a)) < 1e-9 and z.a.abs().max() <= 3
    px = spark.createDataFrame([(f"c{c}", dt.date(2024, 1, 1) + dt.timedelta(days=i), 10.0 + c * i, 5.0) for c in range(3) for i in range(80)], "code string, date date, close double, volume double")
    f = score.screen_features(px)
    top = score.score_rank(f, {"r20": 1.0, "up": 1.0}, top=2).collect()
    assert [r["code"] for r in top] == ["c2", "c1"] or [r["code"] for r in top] == ["c1", "c2"]


def test_window_fills(spark):
    D = dt.date(2024, 1, 1)
    bars = spark.createDataFrame([("a", D, m, 10.0 + m, 3000.0) for m in range(5)], "code string, date date, minute_index int, close double, volume double")
    o = spark.createDataFrame([("a", D, "BUY", 700, 0, 4, 12.0), ("a", D, "BUY", 500, 1, 4, None), ("b", D, "SELL", 100, 0, 4, None)], "code string, date date, side string, quantity long, start int, end int, limit double")
    got = sorted((r["code"], r["quantity"], r["filled"], r["left"], r["vwap"]) for r in execution.window_fills(o, bars).collect())
    assert got[0] == ("a", 500, 500, 0, (300 * 11 + 200 * 12) / 500) and got[1] == ("a", 700, 700, 0, (300 * 10 + 300 * 11 + 100 * 12) / 700) and got[2][:4] == ("b", 100, 0, 100)


def test_actions_and_suspensions(spark):
    p = spark.createDataFrame([("a", 101), ("b", 7)], "code string, quantity long")
    e = spark.createDataFrame([("a", "1.3", "0.25")], "code string, share_ratio string, cash_per_share string")
    assert sorted((r["code"], r["quantity"], r["cash"]) for r in execution.corporate_actions(p, e).collect()) == [("a", 131, 25.25), ("b", 7, 0.0)]
    t = spark.createDataFrame([("09:30-10:00",), ("23:00-09:31",), ("10:00-11:00,13:00-14:00",), (None,), ("",)], "t string")
    assert [r[0] for r in t.select(execution.covers(F.col("t"), 570)).collect()] == [True, True, False, True, True]
    v = execution.value(p, spark.createDataFrame([("a", 2.0)], "code string, close double"), 10.0).first()
    assert v["nav"] == 212.0 and v["unmarked"] == 1
