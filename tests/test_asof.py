import datetime as dt
import random

from pyspark.sql import functions as F

from loomspan.operators import asof

T = lambda d, h=0: dt.datetime(2025, 1, 1) + dt.timedelta(days=d, hours=h)


def brute(events, changes):
    out = []
    for i, e, t in events:
        ok = [c for c in changes if e is not None and t is not None and c[1] == e and None not in (c[2], c[3]) and c[2] <= t and c[3] <= t]
        out.append((i, max(ok, key=lambda c: (c[2], c[3], c[0]))[0] if ok else None))
    return sorted(out)


def run(spark, events, changes, tile):
    ev = spark.createDataFrame(events, "i long, e string, t timestamp")
    ch = spark.createDataFrame(changes, "id long, e string, v timestamp, k timestamp")
    got = asof.as_known_at(ev, "e", F.col("t"), {"h": asof.Attributes(ch, "e", "v", "k", ["v", "k", "id"])}, tile)
    return sorted((r["i"], r["h"]["id"] if r["h"] else None) for r in got.collect())


def test_against_brute_force(spark):
    rnd = random.Random(3)
    events = [(i, rnd.choice(["a", "b", "hot", None]), None if i % 37 == 0 else T(rnd.randrange(400), 15)) for i in range(400)]
    changes = [(i, rnd.choice(["a", "hot", "hot"]), None if i % 29 == 0 else T(rnd.randrange(400)), T(rnd.randrange(400), rnd.randrange(24))) for i in range(200)]
    want = brute(events, changes)
    for tile in (30 * 86400, 400 * 86400):
        assert run(spark, events, changes, tile) == want


def test_ties_repeats_and_empty(spark):
    events = [(1, "a", T(5, 15)), (2, "a", T(5, 15))]
    changes = [(1, "a", T(5), T(5, 15)), (2, "a", T(5), T(5, 15)), (2, "a", T(5), T(5, 15))]
    assert run(spark, events, changes, 86400) == [(1, 2), (2, 2)]
    assert run(spark, events, [], 86400) == [(1, None), (2, None)]
    assert run(spark, [], changes, 86400) == []


def test_never_later_knowledge(spark):
    assert run(spark, [(1, "a", T(5, 15))], [(1, "a", T(1), T(5, 16)), (2, "a", T(6), T(0))], 86400) == [(1, None)]


def test_extra_columns_survive(spark):
    ev = spark.createDataFrame([(1, "a", T(3), "x")], "i long, e string, t timestamp, id string")
    ch = spark.createDataFrame([(7, "a", T(1), T(1), "y")], "id long, e string, v timestamp, k timestamp, t string")
    r = asof.as_known_at(ev, "e", F.col("t"), {"h": asof.Attributes(ch, "e", "v", "k", ["id"])}).first()
    assert r["id"] == "x" and r["h"]["id"] == 7
