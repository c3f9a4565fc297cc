import datetime as dt

from loomspan.operators import reconcile

SCHEMA = "k string, d int, x double, y double, at int"


def run(spark, a, b, **kw):
    l, r = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    return sorted((x["k"] or "", x["d"] or 0, x["field"]) for x in reconcile.compare(l, r, ["k", "d"], ["x", "y"], 0.005, ["at"], ("a", "b"), **kw).collect())


def test_cells_and_keys(spark):
    a = [("p", 1, 1.0, 2.0, 1), ("q", 1, 1.0, None, 1), ("only", 1, 1.0, 1.0, 1)]
    b = [("p", 1, 1.004, 2.1, 1), ("q", 1, 1.0, 5.0, 1), ("other", 1, 1.0, 1.0, 1)]
    assert run(spark, a, b) == [("only", 1, "missing_in_b"), ("other", 1, "missing_in_a"), ("p", 1, "y"), ("q", 1, "y")]


def test_latest_row_counts_and_repeats_cancel(spark):
    a = [("p", 1, 9.0, 2.0, 1), ("p", 1, 1.0, 2.0, 2), ("p", 1, 1.0, 2.0, 2)]
    assert run(spark, a, [("p", 1, 1.0, 2.0, 1)]) == []


def test_nulls_nan_and_empty(spark):
    nan = float("nan")
    assert run(spark, [(None, None, nan, None, None)], [(None, None, None, None, None)]) == []
    assert run(spark, [], []) == []
    assert run(spark, [("a", 1, None, None, 1)], []) == [("a", 1, "missing_in_b")]


def test_exactly_the_tolerance_is_equal(spark):
    assert run(spark, [("p", 1, 10.0, 0.0, 1)], [("p", 1, 10.005, 0.0, 1)]) == []
    assert run(spark, [("p", 1, 10.0, 0.0, 1)], [("p", 1, 10.0051, 0.0, 1)]) == [("p", 1, "x")]


def test_clashing_extra_columns(spark):
    l = spark.createDataFrame([("p", 1, 1.0, 7)], "k string, d int, x double, field int")
    r = spark.createDataFrame([("p", 1, 2.0, "z")], "k string, d int, x double, sign string")
    assert reconcile.compare(l, r, ["k", "d"], ["x"]).count() == 1


def test_dates_as_keys(spark):
    l = spark.createDataFrame([("p", dt.date(2025, 1, 1), 1.0)], "k string, d date, x double")
    assert reconcile.compare(l, l, ["k", "d"], ["x"]).count() == 0
