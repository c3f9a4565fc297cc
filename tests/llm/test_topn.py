import random

from loomspan.llm import topn

S = "g string, c string, x double, rank string"


def run(spark, rows, n=2):
    df = spark.createDataFrame([(*r, "z") for r in rows], S).drop("rank")
    return sorted((r["g"] or "", r["rank"], r["c"] or "", r["x"]) for r in topn.top_n(df, ["g"], "x", ["c"], n).collect())


def test_ties_and_bad_scores(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", "q", 1.0), ("a", "p", 1.0), ("a", "r", 1.0 + 2**-52), ("a", "s", nan), ("a", "t", inf), ("a", "u", -inf), ("a", "v", None), ("b", "p", -0.0), ("b", "o", 0.0), (None, "k", 3.0)]
    assert run(spark, rows) == [("", 1, "k", 3.0), ("a", 1, "r", 1.0 + 2**-52), ("a", 2, "p", 1.0), ("b", 1, "o", 0.0), ("b", 2, "p", 0.0)]


def test_empty_short_and_null_ties(spark):
    assert run(spark, []) == []
    assert run(spark, [("a", None, 1.0), ("a", "b", 1.0)], 5) == [("a", 1, "b", 1.0), ("a", 2, "", 1.0)]


def test_random_against_sorting(spark):
    rnd = random.Random(0)
    rows = [(rnd.choice(["hot", "hot", "hot", "a", "b"]), f"c{i:03d}", float(rnd.randrange(20))) for i in range(500)]
    want = []
    for g in ("a", "b", "hot"):
        want += [(g, k + 1, c, x) for k, (_, c, x) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))[:5])]
    assert run(spark, rows, 5) == want


def test_group_limit_prunes_before_the_shuffle(spark):
    df = spark.createDataFrame([("a", "b", 1.0)], "g string, c string, x double").repartition(3)
    plan = topn.top_n(df, ["g"], "x", ["c"], 2)._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_latest_version(spark):
    df = spark.createDataFrame([("k", 1, 5.0), ("k", 2, None), ("k", 2, None)], "k string, at int, x double")
    assert [tuple(r) for r in topn.latest_version(df, ["k"], ["at"], ["x"]).collect()] == [("k", None)]
