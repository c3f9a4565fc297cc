"""Panels made of the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.queries.common import table

ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")


def _bars(spark: SparkSession, sf_dir: str, day: Column) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    key = F.struct(*ORDER)
    return li.groupBy(F.col("l_suppkey").cast("string").alias("code"), day.alias("date")).agg(
        F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, key).alias("close"),
        F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("amount"), (1 + F.avg("l_discount")).alias("adj_factor"),
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bars(spark, sf_dir, F.to_date("l_shipdate"))


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bars(spark, sf_dir, F.trunc("l_shipdate", "month"))


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    d = s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"]).join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])
    return d.select(F.col("s_suppkey").cast("string").alias("code"), F.col("n_name").alias("industry"), F.col("r_name").alias("region"), F.col("s_acctbal").alias("total_mv"))


def intraday(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    return e.select(F.col("user_id").cast("string").alias("code"), F.to_date("ts").alias("date"), (F.row_number().over(w) - 1).alias("minute_index"), F.col("value").alias("close"), F.col("value").alias("amount"), F.lit(1.0).alias("volume"))


def _bars_sql(day: str) -> str:
    order = ", ".join(ORDER)
    return f"""pk as (select l_suppkey::varchar as code, {day} as date, l_extendedprice / l_quantity as price, l_quantity, l_extendedprice, l_discount,
  row_number() over (partition by l_suppkey, {day} order by {order}) as i, row_number() over (partition by l_suppkey, {day} order by {order.replace(',', ' desc,')} desc) as j from lineitem),
pm as (select code, date, max(price) filter (where i = 1) as open, max(price) as high, min(price) as low, max(price) filter (where j = 1) as close, sum(l_quantity) as volume, sum(l_extendedprice) as amount, 1 + avg(l_discount) as adj_factor from pk group by 1, 2)"""


DAILY = _bars_sql("l_shipdate::date")
MONTHLY = _bars_sql("date_trunc('month', l_shipdate)::date")
ATTR = "att as (select s_suppkey::varchar as code, n_name as industry, r_name as region, s_acctbal as total_mv from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"
INTRADAY = "b as (select user_id::varchar as code, ts::date as date, row_number() over (partition by user_id, ts::date order by ts, event_id) - 1 as minute_index, value as close, value as amount, 1.0 as volume from events)"
