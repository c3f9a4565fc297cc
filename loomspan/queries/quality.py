"""Queries of the data-quality problems: profile, units, reconcile, spikes, as-of, trailing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import asof, profile, reconcile, spikes, trailing, units
from loomspan.queries import quality_sql as sql
from loomspan.queries.common import table, ymd

HEALTH_FIELDS = {
    "dataset_id": "dataset_id",
    "shard": "shard",
    "partition_date": "partition_date",
    "data_version": "data_version",
    "health_status": "health_status",
    "completeness.status": "completeness.status",
    "completeness.expected_count": "completeness.expected_count",
    "completeness.actual_count": "completeness.actual_count",
    "completeness.coverage": "completeness.coverage",
    "quality.fatal_count": "quality.fatal_count",
    "quality.error_count": "quality.error_count",
    "quality.warning_count": "quality.warning_count",
    "quality.quarantine_count": "quality.quarantine_count",
    "quality.error_rate": "quality.error_rate",
    "quality.systematic_issue": "quality.systematic_issue",
    "validated_at": "validated_at",
}
LISTED = ("completeness.coverage", "quality.error_rate", "quality.quarantine_count", "data_version")


def p1_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of the health records but the keys, per load: statistics, masks (commonest first), distinct values and how far it is from the segment's other loads."""
    h = table(spark, sf_dir, "ashare_daily")
    p = profile.profile_columns(h, "segment", "load_id", HEALTH_FIELDS)
    d = profile.distinct_counts(h, ["segment", "load_id"], HEALTH_FIELDS).select(F.col("segment").alias("_s"), F.col("load_id").alias("_l"), F.col("field").alias("_f"), "n_distinct")
    return p.join(d, p["segment"].eqNullSafe(d["_s"]) & p["load_id"].eqNullSafe(d["_l"]) & (p["field"] == d["_f"])).drop("_s", "_l", "_f")


def p1_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile's plain columns, rounded."""
    p = profile.profile_columns(table(spark, sf_dir, "ashare_daily"), "segment", "load_id", HEALTH_FIELDS)
    r = lambda c: F.round(c, 6).alias(c)
    return p.select("segment", "load_id", "field", "n_rows", *map(r, ("null_share", "nan_share", "zero_share", "neg_share", "top_share", "min", "q1", "med", "q3", "max", "mask_div", "rare_share")), "level", "departs", F.col("masks")[0]["mask"].alias("top_mask"))


def p1_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each mask occurs per load and column."""
    return profile.mask_counts(table(spark, sf_dir, "ashare_daily"), ["segment", "load_id"], HEALTH_FIELDS).select("segment", "load_id", "field", "mask", "n")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = profile.mask_counts(table(spark, sf_dir, "ashare_daily"), ["segment", "load_id"], {k: v for k, v in HEALTH_FIELDS.items() if k in LISTED})
    return profile.load_departures(c, "segment", "load_id").where("departs").select("load_id", "field").distinct()


def _mirror_keys(mirror: DataFrame) -> DataFrame:
    """The mirror under the spelling of `daily`: digits identify a code; the date in any order its form tells."""
    d = F.trim("trade_date")
    iso = F.regexp_replace(d, r"[^0-9]", "")
    date = F.to_date(iso, "yyyyMMdd")
    return mirror.select(F.regexp_extract("ts_code", r"(\d{6})", 1).alias("digits"), date.alias("trade_date"), "open", "high", "low", "close", "loaded_at")


def p4_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys missing on a side, and open, high, low and close that differ, with both values."""
    cols = ["trade_date", "open", "high", "low", "close", "loaded_at"]
    daily = table(spark, sf_dir, "daily").select(F.regexp_extract("ts_code", r"(\d{6})", 1).alias("digits"), *cols, "ts_code")
    mirror = table(spark, sf_dir, "daily_mirror")
    diff = reconcile.compare(daily, _mirror_keys(mirror), ["digits", "trade_date"], ["open", "high", "low", "close"], 0.005, ["loaded_at"], ("daily", "mirror"))
    # canonical codes: one per digits; exchange from the spelling
    spelt = daily.select("digits", "ts_code").unionByName(mirror.select(F.regexp_extract("ts_code", r"(\d{6})", 1).alias("digits"), "ts_code"))
    names = spelt.groupBy("digits").agg(F.max(F.regexp_extract(F.upper("ts_code"), r"(SZ|SH|BJ)", 1)).alias("ex"))
    # a null code has no digits and stays null; a left join, so no difference is lost
    names = names.select(F.col("digits").alias("_n"), "ex")
    return diff.join(names, diff["digits"].eqNullSafe(names["_n"]), "left").select(F.when(F.col("digits").isNotNull(), F.concat_ws(".", F.when(F.col("digits") != "", F.col("digits")), F.when(F.col("ex") != "", F.col("ex")))).alias("ts_code"), ymd("trade_date").alias("ymd"), "field", "left_value", "right_value")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_differences(spark, sf_dir).select("ts_code", "ymd", "field")


def _as_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    adj, fund = table(spark, sf_dir, "adj_factor"), table(spark, sf_dir, "fundamentals")
    x = F.col("adj_factor")
    usable = (x > 0) & ~F.isnan(x) & (x < float("inf"))
    return asof.as_known_at(
        table(spark, sf_dir, "daily").select("row_id", "ts_code", "trade_date"),
        "ts_code",
        F.col("trade_date").cast("timestamp") + F.expr("interval 15 hours"),
        {
            "adj": asof.Attributes(adj, "ts_code", "trade_date", "known_at", ["trade_date", "known_at", "adj_id", "adj_factor"], usable),
            "fund": asof.Attributes(fund, "ts_code", "updated_date", "known_at", ["updated_date", "known_at", "fund_id"]),
        },
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.lit(0).cast("long")
    return _as_known(spark, sf_dir).select("row_id", F.coalesce("adj.adj_id", zero).alias("adj_id"), F.coalesce("fund.fund_id", zero).alias("fund_id"))


def p7_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing 7- and 30-day totals of vol and averages of close, for every code and calendar day."""
    t = _trailing(spark, sf_dir)
    return t.select("ts_code", "trade_date", *[c.alias(n) for w in (7, 30) for n, c in ((f"total_{w}", F.round(f"total_{w}", 4)), (f"n_{w}", F.col(f"n_{w}")), (f"avg_{w}", F.round(f"avg_{w}", 6)))])


def _trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trailing.trailing_totals(table(spark, sf_dir, "daily"), "ts_code", "trade_date", "vol", "close", version=["loaded_at", "row_id"])


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p7_trailing with vol brought to shares first, so that feeds in lots and in shares add up."""
    daily = table(spark, sf_dir, "daily")
    u = units.common_units_daily(daily, table(spark, sf_dir, "feeds")).select(F.col("row_id").alias("_id"), F.coalesce("vol_shares", F.lit(0.0)).alias("shares"))
    d = daily.select("row_id", "ts_code", "trade_date", "close", "loaded_at").join(u, F.col("row_id") == F.col("_id"))
    t = trailing.trailing_totals(d, "ts_code", "trade_date", "shares", "close", version=["loaded_at", "row_id"])
    return t.select("ts_code", "trade_date", "total_7", "n_7", "avg_7", "total_30", "n_30", "avg_30")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _trailing(spark, sf_dir)
    return t.where("total_7 = 0 and total_30 > 0").select("ts_code", ymd("trade_date").alias("ymd"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    feeds = table(spark, sf_dir, "feeds")
    d = units.common_units_daily(table(spark, sf_dir, "daily"), feeds)
    b = units.common_units_value(table(spark, sf_dir, "daily_basic"), feeds)
    cell = lambda f, p: F.when(F.col(p) != 0, F.lit(f))
    odd = d.select("row_id", F.explode(F.array_compact(F.array(cell("vol", "vol_power"), cell("amount", "amount_power")))).alias("field"))
    return odd.select(F.lit("daily").alias("tbl"), "row_id", "field").unionByName(b.where("mv_power <> 0").select(F.lit("daily_basic").alias("tbl"), "row_id", F.lit("total_mv").alias("field")))


def p3_remarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each remark of `daily`, its rows and the units it was read to name: what stays unread is seen."""
    return units.named_units(table(spark, sf_dir, "daily"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes.implausible_daily(table(spark, sf_dir, "daily"), table(spark, sf_dir, "feeds")).select("row_id", "field").distinct()


def p5_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes.implausible_daily(table(spark, sf_dir, "daily"), table(spark, sf_dir, "feeds"))


QUERIES = {f.__name__: f for f in (p1_found, p1_profile, p1_statistics, p1_masks, p3_found, p3_remarks, p4_found, p4_differences, p5_found, p5_states, p6_found, p7_found, p7_trailing, p7_shares)}
ORACLE = {"p1_found": sql.P1, "p1_statistics": sql.P1_STATISTICS, "p1_masks": sql.P1_MASKS, "p4_found": sql.P4, "p4_differences": sql.P4_ALL, "p6_found": sql.P6, "p7_found": sql.P7, "p7_trailing": sql.P7_ALL}
