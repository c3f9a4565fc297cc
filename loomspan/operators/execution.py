"""Execution inside a day, corporate actions, suspensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def window_fills(orders: DataFrame, bars: DataFrame, participation: float = 0.1, lot: int = 100, code: str = "code", date: str = "date", minute: str = "minute_index") -> DataFrame:
    """Fills of an order over a window of minutes, each minute at most `participation` of its volume.

    orders: code, date, side, quantity, start, end, limit (null: none). A minute counts if it has
    volume and its close is within the limit. What is filled up to a minute is the running sum of
    capacity, cut at the order: one window per order, no loop. Columns: filled, vwap, minutes, left.
    """
    o = orders.withColumn("_id", F.monotonically_increasing_id())
    j = o.join(bars.select(F.col(code).alias("_c"), F.col(date).alias("_d"), F.col(minute).alias("_m"), F.col("close").alias("_px"), F.col("volume").alias("_v")), (F.col(code) == F.col("_c")) & (F.col(date) == F.col("_d")) & F.col("_m").between(F.col("start"), F.col("end")), "left")
    ok = (F.col("_v") > 0) & (F.col("limit").isNull() | F.when(F.col("side") == "BUY", F.col("_px") <= F.col("limit")).otherwise(F.col("_px") >= F.col("limit")))
    cap = F.coalesce(F.when(ok, F.floor(F.col("_v") * participation / lot) * lot), F.lit(0))
    w = Window.partitionBy("_id").orderBy("_m").rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumn("_cap", cap).withColumn("_upto", F.least(F.sum("_cap").over(w), F.col("quantity")))
    got = F.col("_upto") - F.greatest(F.coalesce(F.lag("_upto").over(Window.partitionBy("_id").orderBy("_m")), F.lit(0)), F.lit(0))
    g = j.withColumn("_got", got).groupBy("_id").agg(F.sum("_got").cast("long").alias("filled"), (F.sum(F.col("_got") * F.col("_px")) / F.nullif(F.sum("_got"), F.lit(0))).alias("vwap"), F.sum((F.col("_got") > 0).cast("int")).alias("minutes"))
    return o.join(g, "_id").withColumn("left", F.col("quantity") - F.col("filled")).drop("_id")


def corporate_actions(positions: DataFrame, events: DataFrame, code: str = "code") -> DataFrame:
    """Shares after an exact scaling, floored, and the cash dividend of the old shares.

    events: code, share_ratio decimal(38,18), cash_per_share decimal(38,18).
    """
    e = events.select(F.col(code).alias("_c"), F.coalesce(F.col("share_ratio").cast("decimal(38,18)"), F.lit(1).cast("decimal(38,18)")).alias("_r"), F.coalesce(F.col("cash_per_share").cast("decimal(38,18)"), F.lit(0).cast("decimal(38,18)")).alias("_k"))
    q = F.col("quantity").cast("decimal(18,0)")
    j = positions.join(e, F.col(code) == F.col("_c"), "left")
    return j.withColumn("cash", F.coalesce((q * F.col("_k")).cast("double"), F.lit(0.0))).withColumn("quantity", F.coalesce(F.floor(q * F.col("_r")).cast("long"), F.col("quantity"))).drop("_c", "_r", "_k")


def covers(timing: Column, at_minute: int) -> Column:
    """Whether a text of wall-clock intervals (hh:mm-hh:mm, comma separated, may pass midnight) covers a minute of the day.

    Null or empty text covers the whole day.
    """
    mins = lambda t: F.element_at(F.split(t, ":"), 1).cast("int") * 60 + F.element_at(F.split(t, ":"), 2).cast("int")

    def one(x: Column) -> Column:
        a, b = mins(F.element_at(F.split(F.trim(x), "-"), 1)), mins(F.element_at(F.split(F.trim(x), "-"), 2))
        return F.when(a <= b, (a <= at_minute) & (F.lit(at_minute) < b)).otherwise((F.lit(at_minute) >= a) | (F.lit(at_minute) < b))

    return F.when(timing.isNull() | (F.trim(timing) == ""), F.lit(True)).otherwise(F.exists(F.split(timing, ","), one))


def next_day(positions: DataFrame) -> DataFrame:
    """What was bought today can be sold from the next day on."""
    return positions.withColumn("sellable_quantity", F.col("quantity"))


def value(positions: DataFrame, marks: DataFrame, cash: float, code: str = "code") -> DataFrame:
    """Market value, cash and NAV of a state; `unmarked` counts positions without a price."""
    j = positions.join(marks.select(code, "close"), code, "left")
    return j.agg(F.coalesce(F.sum(F.col("quantity") * F.col("close")), F.lit(0.0)).alias("market_value"), F.sum(F.when(F.col("close").isNull(), 1).otherwise(0)).alias("unmarked")).withColumn("cash", F.lit(cash)).withColumn("nav", F.col("market_value") + cash)
