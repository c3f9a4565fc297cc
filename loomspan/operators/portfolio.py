"""Portfolio construction, costs, fills and the back-test loop.

What is a table stays a DataFrame operation over all dates at once (ranks, weights,
turnover, order and fill arithmetic). Only what is sequential by nature, holdings
that depend on the day before, is folded along dates: buffered selection and the
account itself, whose state is a few hundred rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.numeric import fdiv, fin


def rebalance_dates(days: DataFrame, frequency: str = "weekly", date: str = "date") -> DataFrame:
    """All days, or the last market day of each ISO week or month."""
    if frequency == "daily":
        return days.select(date).distinct()
    keys = {"weekly": [F.extract(F.lit("YEAROFWEEK"), F.col(date)), F.weekofyear(date)], "monthly": [F.trunc(date, "month")]}[frequency]
    return days.groupBy(*keys).agg(F.max(date).alias(date)).select(date)


def next_open_day(dates: DataFrame, days: DataFrame, date: str = "date") -> DataFrame:
    """Each decision date with the first market day after it; null after the last."""
    cal = days.agg(F.sort_array(F.collect_set(date)).alias("_cal"))
    d = dates.join(F.broadcast(cal), F.lit(True))
    return d.select(date, F.try_element_at(F.filter("_cal", lambda x: x > F.col(date)), F.lit(1)).alias("execution_date"))


def top_k_weights(
    df: DataFrame, k: int, weighting: str = "equal", signal: str = "signal", mv: str = "total_mv", date: str = "date", code: str = "code", direction: int = 1, gross: float = 1.0, insufficient: str = "use_available"
) -> DataFrame:
    """The k best signals per date (highest if `direction` is 1, lowest if -1; ties by code) with weights that sum to `gross`.

    equal; score: by the positive part of signal x direction, a date whose parts are all 0 holds cash; market_cap. Names without
    weight, in market_cap those without a positive market value, have no row. A date with fewer than k valid signals uses
    those (use_available) or holds cash (all_cash). A date in cash has no rows.
    """
    if direction not in (1, -1) or insufficient not in ("use_available", "all_cash"):
        raise ValueError("direction is 1 or -1, insufficient use_available or all_cash")
    x = fin(F.col(signal))
    w = Window.partitionBy(date).orderBy(F.col("_s").desc(), F.col(code))
    d = df.withColumn("_s", x * direction).where("_s is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    sec = Window.partitionBy(date)
    if weighting == "equal":
        raw = F.lit(1.0)
    elif weighting == "score":
        raw = F.greatest(F.col("_s"), F.lit(0.0))
    elif weighting == "market_cap":
        raw = F.when(fin(F.col(mv)) > 0, F.col(mv).cast("double")).otherwise(0.0)
    else:
        raise ValueError(f"no weighting {weighting!r}")
    d = d.withColumn("_w", raw)
    if insufficient == "all_cash":
        d = d.withColumn("_n", F.count(F.lit(1)).over(sec)).where(F.col("_n") == k)
    return d.select(F.col(date).alias("decision_date"), code, F.when(F.sum("_w").over(sec) > 0, F.col("_w") / F.sum("_w").over(sec) * gross).otherwise(0.0).alias("target_weight"), "rank").where("target_weight > 0")


def buffered_top_k(df: DataFrame, k: int, retain: int, signal: str = "signal", date: str = "date", code: str = "code", strategy: str | None = None) -> DataFrame:
    """Equal-weight selection with a buffer: a holding stays while ranked within `retain`, free places go to the best.

    Only ranks up to `retain` travel: a date's candidates are a bounded set. One
    group per strategy folds along its dates.
    """
    by = [strategy] if strategy else []
    w = Window.partitionBy(*by, date).orderBy(F.col("_s").desc(), F.col(code))
    d = df.withColumn("_s", fin(F.col(signal))).where("_s is not null").withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= max(k, retain))
    d = d.select(*[F.col(b).cast("string").alias("_g") for b in by] or [F.lit("").alias("_g")], F.col(date).alias("d"), F.col(code).alias("c"), "_k")

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        held: list = []
        out = []
        for day, one in g.sort_values(["d", "_k"]).groupby("d", sort=True):
            rank = dict(zip(one["c"], one["_k"], strict=True))
            kept = sorted((c for c in held if rank.get(c, retain + 1) <= retain), key=rank.get)[:k]
            new = [c for c in one["c"] if c not in kept][: k - len(kept)]
            held = kept + new
            out += [(g["_g"].iloc[0], day, c, 1.0 / len(held)) for c in held]
        return pd.DataFrame(out, columns=["_g", "d", "c", "w"])

    t = dict(df.dtypes)
    res = d.groupBy("_g").applyInPandas(fold, f"_g string, d {t[date]}, c {t[code]}, w double")
    return res.select(*([F.col("_g").alias(strategy)] if strategy else []), F.col("d").alias("decision_date"), F.col("c").alias(code), F.col("w").alias("target_weight"))


def weight_turnover(targets: DataFrame, decisions: DataFrame, code: str = "code") -> DataFrame:
    """One-side turnover per decision date: half the sum of absolute weight changes; a date without rows is all cash."""
    days = decisions.select("decision_date").distinct().withColumn("_i", F.row_number().over(Window.orderBy("decision_date")))
    t = targets.join(F.broadcast(days), "decision_date")
    now = t.select("_i", code, F.col("target_weight").alias("w"))
    before = t.select((F.col("_i") + 1).alias("_i"), code, (-F.col("target_weight")).alias("w"))
    ch = now.unionByName(before).groupBy("_i", code).agg(F.abs(F.sum("w")).alias("ch")).groupBy("_i").agg((F.sum("ch") / 2).alias("turnover"))
    return days.join(ch, "_i", "left").select("decision_date", F.coalesce("turnover", F.lit(0.0)).alias("turnover"))


def capacity(turnover: DataFrame, adv: float, rate: float = 0.1) -> DataFrame:
    return turnover.withColumn("capacity", fin(fdiv(F.lit(adv * rate), F.col("turnover"))))


@dataclass(frozen=True)
class Costs:
    slippage: float = 0.0005
    commission: float = 0.00025
    min_commission: float = 5.0
    stamp: float = 0.0005
    transfer: float = 0.00001


def execution_costs(df: DataFrame, costs: Costs = Costs(), price: str = "reference_price", quantity: str = "quantity", side: str = "side") -> DataFrame:
    """execution_price, gross_notional, commission, stamp_tax, transfer_fee, total_fees, effective_cash_delta of fills."""
    sign = F.when(F.col(side) == "BUY", 1).otherwise(-1)
    q = F.col(quantity).cast("double")
    d = df.withColumn("execution_price", F.col(price) * (1 + sign * costs.slippage)).withColumn("gross_notional", F.col("execution_price") * q)
    has = q > 0
    d = d.withColumn("commission", F.when(has, F.greatest(F.col("gross_notional") * costs.commission, F.lit(costs.min_commission))).otherwise(0.0))
    d = d.withColumn("stamp_tax", F.when(has & (F.col(side) == "SELL"), F.col("gross_notional") * costs.stamp).otherwise(0.0)).withColumn("transfer_fee", F.col("gross_notional") * costs.transfer)
    d = d.withColumn("total_fees", F.col("commission") + F.col("stamp_tax") + F.col("transfer_fee"))
    return d.withColumn("effective_cash_delta", -sign * F.col("gross_notional") - F.col("total_fees"))


def fillability(df: DataFrame) -> Column:
    """The first reason against a fill at the open, or FILLABLE: suspended, missing data, limit on the order's side."""
    return (
        F.when(F.coalesce("is_suspended_at_open", F.lit(False)), "SUSPENDED")
        .when(~F.coalesce("has_daily", F.lit(False)) | F.col("open").isNull() | (F.col("open") <= 0), "NO_DATA")
        .when(~F.coalesce("has_limit", F.lit(False)), "NO_LIMIT_DATA")
        .when((F.col("side") == "BUY") & (F.col("open") >= F.col("up_limit") - 1e-9), "UP_LIMIT")
        .when((F.col("side") == "SELL") & (F.col("open") <= F.col("down_limit") + 1e-9), "DOWN_LIMIT")
        .otherwise("FILLABLE")
    )


def lot_quantity(quantity: Column, lot: int = 100, least: int = 100) -> Column:
    q = F.floor(quantity / lot) * lot
    return F.when(q >= least, q).otherwise(0).cast("long")


def sell_quantity(quantity: Column, held: Column, lot: int = 100) -> Column:
    """Whole lots, or everything: an odd rest may only be sold as a whole."""
    return F.when(quantity >= held, held).otherwise(F.floor(quantity / lot) * lot).cast("long")


@dataclass
class Account:
    cash: float
    held: dict[str, int] = field(default_factory=dict)


def simulate(prices: DataFrame, targets: DataFrame, decisions: DataFrame, cash: float = 1e6, costs: Costs = Costs(), lot: int = 100, date: str = "date", code: str = "code", price: str = "open", mark: str = "close") -> DataFrame:
    """NAV per day of a long-only account that trades to target weights at the open after each decision.

    Sells come first; buys are scaled down together until the cash suffices. Fills are in
    whole lots, at `price` with slippage and fees; without a price there is no fill.
    Only prices of codes that are ever a target, on market days from the first execution on, reach the
    loop, which runs in one task as its state is the account. Rows: date, nav, cash, fees, n_held.
    """
    ex = next_open_day(decisions.select(F.col("decision_date").alias(date)).distinct(), prices.select(date).distinct(), date)
    plan = targets.join(ex.select(F.col(date).alias("decision_date"), "execution_date"), "decision_date")
    plan = plan.groupBy("execution_date").agg(F.map_from_entries(F.collect_list(F.struct(F.col(code).cast("string"), "target_weight"))).alias("plan"))
    sched = ex.where("execution_date is not null").select("execution_date").distinct().join(plan, "execution_date", "left")
    used = targets.select(F.col(code).alias("_c")).distinct()
    px = prices.join(used, F.col(code) == F.col("_c"), "left_semi").groupBy(date).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(code).cast("string"), F.col(price).cast("double")))).alias("px"), F.map_from_entries(F.collect_list(F.struct(F.col(code).cast("string"), F.col(mark).cast("double")))).alias("mk")
    )
    days = prices.select(date).distinct().join(px, date, "left").join(sched.withColumn("trades", F.lit(True)), F.col(date) == F.col("execution_date"), "left")
    feed = days.select(F.col(date).cast("date").alias("d"), "px", "mk", F.coalesce("trades", F.lit(False)).alias("trades"), "plan", F.lit(1).alias("_g"))

    def loop(g: pd.DataFrame) -> pd.DataFrame:
        acc, last, out, started = Account(cash), {}, [], False
        for r in g.sort_values("d").itertuples():
            px, mk = {k: v for k, v in dict(r.px or {}).items() if v and v > 0}, dict(r.mk or {})
            fees = 0.0
            if r.trades:
                started = True
                plan = dict(r.plan or {})
                equity = acc.cash + sum(q * px.get(c, last.get(c, 0.0)) for c, q in acc.held.items())
                want = {c: int(w * equity / px[c]) for c, w in plan.items() if c in px}
                for c in sorted(acc.held):
                    if c in px:
                        q = acc.held[c] - (want.get(c, 0) if c in plan else 0)
                        q = acc.held[c] if q >= acc.held[c] else max(0, q // lot * lot)
                        if q > 0:
                            gross = q * px[c] * (1 - costs.slippage)
                            fee = max(gross * costs.commission, costs.min_commission) + gross * (costs.stamp + costs.transfer)
                            acc.cash += gross - fee
                            fees += fee
                            acc.held[c] -= q
                acc.held = {c: q for c, q in acc.held.items() if q}
                buys = {c: want[c] - acc.held.get(c, 0) for c in sorted(want) if want[c] > acc.held.get(c, 0)}
                need = sum(q * px[c] * (1 + costs.slippage) for c, q in buys.items())
                scale = min(1.0, acc.cash / need) if need > 0 else 0.0
                for c, q in buys.items():
                    unit = px[c] * (1 + costs.slippage)
                    # what the cash pays for, by the rate and with the least commission
                    most = min((acc.cash + 1e-9) / (unit * (1 + costs.commission + costs.transfer)), (acc.cash - costs.min_commission) / (unit * (1 + costs.transfer)))
                    q = int(min(q * scale, max(most, 0.0))) // lot * lot
                    if q > 0:
                        gross = q * unit
                        fee = max(gross * costs.commission, costs.min_commission) + gross * costs.transfer
                        acc.cash -= gross + fee
                        fees += fee
                        acc.held[c] = acc.held.get(c, 0) + q
            last.update({c: v for c, v in mk.items() if v and v > 0})
            if started:
                nav = acc.cash + sum(q * last.get(c, px.get(c, 0.0)) for c, q in acc.held.items())
                out.append((r.d, nav, acc.cash, fees, len(acc.held)))
        return pd.DataFrame(out, columns=["date", "nav", "cash", "fees", "n_held"])

    return feed.groupBy("_g").applyInPandas(loop, "date date, nav double, cash double, fees double, n_held int")


def bootstrap(returns: DataFrame, n: int = 200, seed: int = 7, ret: str = "ret") -> DataFrame:
    """Monte Carlo of compounded returns: every replicate weighs each row by a Poisson(1) draw.

    The Poisson bootstrap needs no resampling join: weights come from a seeded hash of (row order, replicate).
    """
    idx = returns.select(F.col(ret).cast("double").alias("r")).where("r is not null").withColumn("_h", F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)))
    rep = idx.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    u = (F.pmod(F.xxhash64("_h", "replicate"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    # inverse of the Poisson(1) distribution function
    k = F.lit(0)
    cum, p = 0.0, 0.36787944117144233
    for i in range(8):
        cum += p
        k = k + F.when(u > cum, 1).otherwise(0)
        p /= i + 1
    return rep.groupBy("replicate").agg((F.exp(F.sum(k * F.log1p("r"))) - 1).alias("total_return"))
