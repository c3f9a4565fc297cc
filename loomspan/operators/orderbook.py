"""Order-book events: replay, day statistics, tick sides, windows around events."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.numeric import fdiv

ADD, FILL, CANCEL = "add", "fill", "cancel"
PRIORITY = {ADD: 0, FILL: 1, CANCEL: 2}


def order_priority(kind: Column) -> Column:
    return F.when(kind == ADD, 0).when(kind == FILL, 1).otherwise(2)


def replay_levels(orders: DataFrame, code: str = "code", day: str = "date") -> DataFrame:
    """Book after every event, by signed quantities: (.., level_qty, side_qty).

    orders: code, date, ms, seq, kind, side, price, qty. The quantity resting at the event's
    price level and on its side are running sums in event order (time, then add before
    fill before cancel, then seq), one level or side per window.
    """
    signed = F.when(F.col("kind") == ADD, F.col("qty")).otherwise(-F.col("qty"))
    d = orders.withColumn("_q", signed).withColumn("_p", order_priority(F.col("kind")))
    order = ["ms", "_p", "seq"]
    lv = Window.partitionBy(code, day, "side", "price").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sd = Window.partitionBy(code, day, "side").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("level_qty", F.sum("_q").over(lv)).withColumn("side_qty", F.sum("_q").over(sd)).drop("_q", "_p")


def replay_fifo(events: DataFrame, code: str = "code", day: str = "date") -> DataFrame:
    """Queue position by order: (code, day, id, side, price, ahead, filled, left, lifetime_ms).

    ahead: quantity before the order at its level when it came. Exact FIFO state is sequential within
    one (code, day); sorted batches hold many of those groups, so small ones cost no task each.
    """
    from loomspan.operators.series import by_entity

    def run(g: pd.DataFrame) -> pd.DataFrame:
        out: list = []
        level: dict = {}
        orders: dict = {}
        now = None
        for c, d, ms, kind, side, price, qty, oid in zip(g["c"], g["d"], g["ms"], g["kind"], g["side"], g["price"], g["qty"], g["id"], strict=True):
            if now != (c, d):
                level, orders, now = {}, {}, (c, d)
            if kind == ADD:
                q = level.get((side, price), 0)
                o = orders[oid] = [c, d, oid, side, price, q, 0, qty, None, ms]
                out.append(o)
                level[(side, price)] = q + qty
            elif oid in orders:
                o = orders[oid]
                q = min(qty, o[7])
                o[7] -= q
                o[6] += q if kind == FILL else 0
                level[(o[3], o[4])] -= q
                if o[7] == 0 and o[8] is None:
                    o[8] = float(ms - o[9])
        return pd.DataFrame([o[:9] for o in out], columns=["c", "d", "id", "side", "price", "ahead", "filled", "left", "lifetime_ms"])

    t = dict(events.dtypes)
    fed = events.select(F.col(code).alias("c"), F.col(day).alias("d"), "ms", "seq", "kind", "side", "price", "qty", "id", order_priority(F.col("kind")).alias("_p"))
    fed = fed.repartition("c", "d").sortWithinPartitions("c", "d", "ms", "_p", "seq")
    out = fed.mapInPandas(lambda bs: map(run, by_entity(bs, "c", "d")), f"c {t[code]}, d {t[day]}, id {t['id']}, side string, price {t['price']}, ahead {t['qty']}, filled {t['qty']}, left {t['qty']}, lifetime_ms double")
    return out.withColumnRenamed("c", code).withColumnRenamed("d", day)


def day_stats(events: DataFrame, code: str = "code", day: str = "date", large: float = 0.9) -> DataFrame:
    """Per code and day: events by kind, quantities, 1-second bursts, gaps between fills, share of large fills (NaN where fills sum to 0)."""
    kinds = [F.sum((F.col("kind") == k).cast("long")).alias(f"n_{k}") for k in PRIORITY]
    base = events.groupBy(code, day).agg(*kinds, F.sum(F.when(F.col("kind") == FILL, F.col("qty"))).alias("filled"), F.percentile(F.when(F.col("kind") == FILL, F.col("qty").cast("double")), large).alias("large_at"))
    burst = events.groupBy(code, day, F.floor(F.col("ms") / 1000).alias("s")).agg(F.count(F.lit(1)).alias("n")).groupBy(code, day).agg(F.max("n").alias("max_burst"), F.avg("n").alias("mean_burst"))
    w = Window.partitionBy(code, day).orderBy("ms", "seq")
    fills = events.where(F.col("kind") == FILL).withColumn("gap", F.col("ms") - F.lag("ms").over(w))
    g = fills.groupBy(code, day).agg(F.avg("gap").alias("mean_gap"), F.max("gap").alias("max_gap"))
    big = events.where(F.col("kind") == FILL).join(base.select(code, day, "large_at"), [code, day]).groupBy(code, day).agg(F.sum(F.when(F.col("qty") >= F.col("large_at"), F.col("qty"))).alias("_large"), F.sum("qty").alias("_all"))
    big = big.select(code, day, fdiv(F.col("_large"), F.col("_all")).alias("large_share"))
    return base.join(burst, [code, day], "left").join(g, [code, day], "left").join(big, [code, day], "left")


def tick_side(price: Column, order: Sequence[str], keys: Sequence[str]) -> Column:
    """+1 / -1 by the last price change, carried over equal prices; 0 before any."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ch = F.signum(price - F.lag(price).over(w))
    return F.coalesce(F.last(F.when(ch != 0, ch), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))


def around_events(ticks: DataFrame, events: DataFrame, key: str, pre_ms: int, post_ms: int, value: str = "qty", bin_ms: int = 60_000) -> DataFrame:
    """Per event the sum and count of ticks in [t - pre, t) and [t, t + post].

    A range join made an equi-join: an event is copied to the time bins its window touches, so that
    each tick meets only events of its key and bin.
    """
    e = events.select(F.col(key).alias("_k"), F.col("event_id"), F.col("ms").alias("_t"))
    e = e.withColumn("_bin", F.explode(F.sequence(F.floor((F.col("_t") - pre_ms) / bin_ms), F.floor((F.col("_t") + post_ms) / bin_ms))))
    t = ticks.select(F.col(key).alias("_tk"), F.col("ms").alias("_m"), F.col(value).cast("double").alias("_v"), F.floor(F.col("ms") / bin_ms).alias("_tb"))
    j = e.join(t, (F.col("_k") == F.col("_tk")) & (F.col("_bin") == F.col("_tb")), "left")
    pre = (F.col("_m") >= F.col("_t") - pre_ms) & (F.col("_m") < F.col("_t"))
    post = (F.col("_m") >= F.col("_t")) & (F.col("_m") <= F.col("_t") + post_ms)
    agg = lambda c, n: [F.sum(F.when(c, F.col("_v"))).alias(f"sum_{n}"), F.sum(F.when(c, 1).otherwise(0)).alias(f"n_{n}")]
    return j.groupBy(F.col("_k").alias(key), "event_id").agg(*agg(pre, "pre"), *agg(post, "post"))


def shocks(bars: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], window: int = 40, least: int = 10, z: float = 3.0) -> DataFrame:
    """Rolling z against the `window` rows before (at least `least`): adds z and shock."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-window, -1)
    v = F.col(value)
    n, m, s = F.count(v).over(w), F.avg(v).over(w), F.stddev_samp(v).over(w)
    zed = F.when((n >= least) & (s > 0), (v - m) / s)
    return bars.withColumn("z", zed).withColumn("shock", F.coalesce(F.abs(F.col("z")) >= z, F.lit(False)))


def future_peak(df: DataFrame, h: int, high: str = "high", close: str = "close", code: str = "code", date: str = "date") -> DataFrame:
    """Label: greatest high of the next h rows over close, less 1; null unless all h are there."""
    w = Window.partitionBy(code).orderBy(date).rowsBetween(1, h)
    return df.withColumn(f"future_peak_{h}d", F.when(F.count(high).over(w) == h, F.max(high).over(w) / F.col(close) - 1))


def ranked_audit(df: DataFrame, k: int, label: Column, score: str = "signal", date: str = "date", code: str = "code") -> DataFrame:
    """precision, recall and lift of the top k per date against a boolean label."""
    w = Window.partitionBy(date).orderBy(F.col(score).desc_nulls_last(), F.col(code))
    d = df.withColumn("_y", F.coalesce(label, F.lit(False)).cast("int")).withColumn("_k", F.row_number().over(w) <= k)
    g = d.groupBy(date).agg(F.sum(F.when(F.col("_k"), F.col("_y"))).alias("hit"), F.sum("_y").alias("pos"), F.count(F.lit(1)).alias("n"), F.sum(F.col("_k").cast("int")).alias("k"))
    return g.select(date, (F.col("hit") / F.col("k")).alias("precision"), F.when(F.col("pos") > 0, F.col("hit") / F.col("pos")).alias("recall"), F.when(F.col("pos") > 0, F.col("hit") / F.col("k") / (F.col("pos") / F.col("n"))).alias("lift"))


def minute_checkpoints(orders: DataFrame, code: str = "code", day: str = "date", minute_ms: int = 60_000) -> DataFrame:
    """What rests at a price level at the end of each minute in which it changed: (code, day, minute, side, price, level_qty).

    A level keeps its quantity until its next row, so these rows are the whole book at any minute's end.
    """
    d = replay_levels(orders, code, day).withColumn("minute", F.floor(F.col("ms") / minute_ms).cast("int"))
    at = F.struct("ms", order_priority(F.col("kind")), "seq")
    return d.groupBy(code, day, "minute", "side", "price").agg(F.max_by("level_qty", at).alias("level_qty"))


def near_best(levels: DataFrame, ticks: int, tick: float, by: Sequence[str], buy: str = "B") -> DataFrame:
    """Levels at most `ticks` ticks from their side's best price among the levels of their group with something on them.

    The best is the highest price of side `buy`, the lowest of the other. A group with nothing resting has no rows.
    """
    live = F.when(F.col("level_qty") > 0, F.col("price"))
    w = Window.partitionBy(*by, "side")
    best = F.when(F.col("side") == buy, F.max(live).over(w)).otherwise(F.min(live).over(w))
    return levels.withColumn("best", best).where(F.abs(F.col("price") - F.col("best")) <= ticks * tick + 1e-9)


def attribute_late(df: DataFrame, ts: str, arrival: str, width: str = "1 minute", limit: str = "500 milliseconds") -> DataFrame:
    """Adds bucket and late: an event counts in the bucket of its own time, or, if it arrived more than `limit` after it, in
    that of its arrival, so that buckets already given out never change. Works on streams too. Without an arrival an event is in time.
    """
    late = F.coalesce(F.col(arrival) > F.col(ts) + F.expr(f"interval {limit}"), F.lit(False))
    return df.withColumn("late", late).withColumn("bucket", F.window(F.when(late, F.col(arrival)).otherwise(F.col(ts)), width)["start"])
