import datetime as dt
import random

from loomspan.operators import trailing

D = lambda i: dt.date(2024, 12, 1) + dt.timedelta(days=i)
SCHEMA = "c string, d date, v double, p double"


def brute(rows):
    days = {}
    for c, d, v, p in rows:
        if c is None or d is None:
            continue
        k = days.setdefault(c, {})
        low = lambda r: tuple(-1.0 if x is None else x for x in r)
        k[d] = max(k.get(d, (None, None)), (v, p), key=low)
    out = {}
    for c, k in days.items():
        d = min(k)
        while d <= max(k):
            row = []
            for w in (7, 30):
                got = [k.get(d - dt.timedelta(days=i), (None, None)) for i in range(w)]
                ps = [p for _, p in got if p is not None]
                row += [round(sum(v or 0 for v, _ in got), 6), len(ps), round(sum(ps) / len(ps), 6) if ps else None]
            out[(c, d)] = tuple(row)
            d += dt.timedelta(days=1)
    return out


def run(spark, rows, **kw):
    got = trailing.trailing_totals(spark.createDataFrame(rows, SCHEMA), "c", "d", "v", "p", **kw).collect()
    r = lambda x: None if x is None else round(x, 6)
    return {(x["c"], x["d"]): (r(x["total_7"]), x["n_7"], r(x["avg_7"]), r(x["total_30"]), x["n_30"], r(x["avg_30"])) for x in got}


def test_against_brute_force(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("abc"), D(rnd.randrange(300)), rnd.choice([None, 0.0, 5.0, 2.5]), rnd.choice([None, 1.0, 3.0])) for _ in range(250)]
    rows += rows[:20] + [(None, D(1), 1.0, 1.0), ("a", None, 1.0, 1.0)]
    want = brute(rows)
    for tile in (16, 122):
        assert run(spark, rows, tile_days=tile) == want


def test_empty_and_single(spark):
    assert run(spark, []) == {}
    assert run(spark, [("a", D(0), None, None)]) == {("a", D(0)): (0.0, 0, None, 0.0, 0, None)}


def test_long_silence(spark):
    got = run(spark, [("a", D(0), 4.0, 2.0), ("a", D(200), 1.0, 1.0)], tile_days=30)
    assert len(got) == 201 and got[("a", D(8))][:4] == (0.0, 0, None, 4.0) and got[("a", D(100))] == (0.0, 0, None, 0.0, 0, None)


def test_nan_and_clashing_columns(spark):
    df = spark.createDataFrame([("a", D(0), float("nan"), float("nan"), 1)], SCHEMA + ", total_7 int")
    r = trailing.trailing_totals(df, "c", "d", "v", "p").first()
    assert r["total_7"] == 0 and r["avg_7"] is None


def test_of_revisions_the_latest_row_counts(spark):
    rows = [("a", D(0), 500.0, 9.0, 1), ("a", D(0), 100.0, 2.0, 3), ("a", D(0), 900.0, None, 2), ("a", D(1), 7.0, 1.0, None), ("a", D(1), None, 5.0, 0)]
    got = trailing.trailing_totals(spark.createDataFrame(rows, SCHEMA + ", seq int"), "c", "d", "v", "p", version=["seq"]).orderBy("d").collect()
    assert [(r["total_7"], r["avg_7"]) for r in got] == [(100.0, 2.0), (100.0, 3.5)]
