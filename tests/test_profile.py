import random

import pytest
from pyspark.sql import functions as F

from loomspan.operators import profile
from loomspan.queries import quality

FIELDS = {"x": "x", "s.t": "s"}
SCHEMA = "g string, l string, x double, s string"


def loads(spark, bad, per=30):
    rnd = random.Random(2)
    rows = []
    for i in range(10):
        for k in range(per):
            x, s = rnd.gauss(100, 2), f"v2025{i:04d}_01"
            if i == 4:
                x, s = bad(x, s, k)
            rows.append(("g", f"L{i}", x, s))
    c = profile.mask_counts(spark.createDataFrame(rows, SCHEMA), ["g", "l"], FIELDS)
    return sorted((r["l"], r["field"]) for r in profile.load_departures(c, "g", "l").where("departs").collect())


def test_steady_loads_do_not_depart(spark):
    assert loads(spark, lambda x, s, k: (x, s)) == []
    assert loads(spark, lambda x, s, k: (x, s), 4) == []


@pytest.mark.parametrize(
    "bad",
    [
        lambda x, s, k: (None, s), lambda x, s, k: (float("nan"), s), lambda x, s, k: (None if k % 2 else x, s), lambda x, s, k: (3 * x, s), lambda x, s, k: (1.3 * x, s), lambda x, s, k: (101.0, s),
        lambda x, s, k: (1000 * x, s), lambda x, s, k: (0.0, s), lambda x, s, k: (-x, s), lambda x, s, k: (100 + 10 * (x - 100), s),
    ],
    ids="null nan half_null x3 +30% stuck x1000 zero sign spread".split(),
)
def test_departures_of_a_number(spark, bad):
    assert loads(spark, bad) == [("L4", "x")]


def test_departures_of_a_text(spark):
    assert loads(spark, lambda x, s, k: (x, s[1:].upper() + "-TMP")) == [("L4", "s.t")]
    assert loads(spark, lambda x, s, k: (x, None if k % 2 else s)) == [("L4", "s.t")]


def test_masks_and_statistics(spark):
    df = spark.createDataFrame([("g", "L", 12.5, "Ab9中"), ("g", "L", None, None), ("g", "L", float("nan"), ""), ("g", "L", -0.002, "Ab8国"), ("g", "L", 0.0, "x"), ("g", "L", float("inf"), "Ab 1" * 100)], SCHEMA)
    counts = profile.mask_counts(df, ["g", "l"], FIELDS)
    got = {r["field"]: r for r in profile.statistics(counts, ["g", "l"]).collect()}
    assert {m["mask"] for m in got["x"]["masks"]} == {"+1.25e1", "<null>", "<nan>", "-2.00e-3", "0", "+<inf>"}
    assert [tuple(m) for m in got["s.t"]["masks"]] == [("Aa9W", 2 / 6), ("<empty>", 1 / 6), ("<long Aa9 2^8>", 1 / 6), ("<null>", 1 / 6), ("a", 1 / 6)]
    assert (got["x"]["min"], got["x"]["med"], got["x"]["max"], got["x"]["zero_share"], got["x"]["neg_share"]) == (-0.002, 0.0, 12.5, 1 / 6, 1 / 6)
    assert got["s.t"]["med"] is None and got["s.t"]["null_share"] == 1 / 6
    n = {r["field"]: r["n_distinct"] for r in profile.distinct_counts(df, ["g", "l"], FIELDS).collect()}
    assert n == {"x": 5, "s.t": 5}


def test_number_masks_at_their_edges(spark):
    xs = {0.98: "+9.80e-1", 1000.0: "+1.00e3", 999.9999999999: "+1.00e3", 1e-200: "+1.00e-200", -123456.0: "-1.23e5", 0.1 + 0.2: "+3.00e-1", -5e-324: "-<tiny>", 1.7e308: "+1.70e308"}
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert {r["x"]: r["m"] for r in df.select("x", profile.number_mask(F.col("x")).alias("m")).collect()} == xs


def test_empty_and_null_groups(spark):
    assert profile.profile_columns(spark.createDataFrame([], SCHEMA), "g", "l", FIELDS).count() == 0
    df = spark.createDataFrame([(None, None, 1.0, "a"), (None, "L", 1.0, "a")], SCHEMA)
    p = profile.profile_columns(df, "g", "l", FIELDS)
    assert p.count() == 4 and p.where("departs").count() == 0
    assert profile.profile_columns(df.limit(1), "g", "l", FIELDS).where("departs or mask_div is not null").count() == 0


def test_every_health_column_is_profiled_with_masks(spark, sf, tmp_path):
    h = spark.read.parquet(f"{sf}/ashare_daily.parquet")
    seg = h.groupBy("segment").agg(F.count_distinct("load_id").alias("k")).orderBy(F.desc("k"), "segment").first()["segment"]
    one = h.where(F.col("segment") == seg).orderBy("load_id").first()["load_id"]
    odd = F.col("load_id") == one
    h = h.where(F.col("segment") == seg).withColumn("validated_at", F.when(~odd, F.col("validated_at"))).withColumn("dataset_id", F.when(odd, "X-1").otherwise(F.col("dataset_id")))
    h.write.parquet(str(tmp_path / "ashare_daily.parquet"))
    p = {(r["load_id"], r["field"]): r for r in quality.p1_profile(spark, str(tmp_path)).collect()}
    flat = [f"{f.name}.{g.name}" for f in h.schema if f.dataType.typeName() == "struct" for g in f.dataType] + [f.name for f in h.schema if f.dataType.typeName() != "struct"]
    loads = {k for k, _ in p}
    assert len(loads) > 2 and set(p) == {(k, f) for k in loads for f in flat if f not in ("segment", "load_id")}
    assert {k for k in loads if p[k, "validated_at"]["departs"]} == {one} and {k for k in loads if p[k, "dataset_id"]["departs"]} == {one}
    x = p[one, "dataset_id"]
    assert [tuple(m) for m in x["masks"]] == [("A-9", 1.0)] and x["rare_share"] == 1.0 and x["mask_div"] > 0.99 and x["n_distinct"] == 1
    assert all([m["share"] for m in r["masks"]] == sorted((m["share"] for m in r["masks"]), reverse=True) for r in p.values())
