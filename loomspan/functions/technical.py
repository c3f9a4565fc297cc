"""Technical indicators and price patterns (kind ts), composed of windows and exponential smoothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspan.functions.numeric import col, dbl, fdiv, rows, running
from loomspan.functions.timeseries import avg, bars_since, count_true, decay_exp, every, exist, high, lag, linear, low, std, total, ts  # noqa: F401


def ema(c, x, n) -> Column:
    return c.ewm(x, 2.0 / (int(n) + 1))


def rma(c, x, n) -> Column:
    return c.ewm(x, 1.0 / int(n))


def sma_cn(c, x, n, m=1) -> Column:
    return c.ewm(x, float(m) / int(n))


ts("ts_EMA ts_EXPMA", 1, 2)(lambda c, x, n=12: ema(c, x, n))
ts("ts_EXPMEMA", 1, 2)(lambda c, x, n=12: c.ewm(x, 2.0 / (int(n) + 1), int(n)))
ts("ts_DMA", 1, 2, "unbounded")(lambda c, x, a=0.5: c.ewm(x, float(a)))
ts("ts_RMA", 1, 2)(lambda c, x, n=14: rma(c, x, n))
ts("ts_SMA_CN", 3)(lambda c, x, n, m: sma_cn(c, x, n, m))
ts("ts_DEMA", 1, 2)(lambda c, x, n=30: 2 * ema(c, x, n) - ema(c, ema(c, x, n), n))


def tema(c, x, n=30) -> Column:
    a = ema(c, x, n)
    b = ema(c, a, n)
    return 3 * a - 3 * b + ema(c, b, n)


ts("ts_TEMA", 1, 2)(tema)


def trix(c, x, n=30) -> Column:
    t = ema(c, ema(c, ema(c, x, n), n), n)
    return (fdiv(t, lag(c, t)) - 1) * 100


ts("ts_TRIX", 1, 2)(trix)
ts("ts_TRIMA", 1, 2)(lambda c, x, n=30: avg(c, avg(c, x, (int(n) + 2) // 2), (int(n) + 1) // 2))
ts("ts_APO", 1, 4)(lambda c, x, f=12, s=26, *_: ema(c, x, f) - ema(c, x, s))
ts("ts_PPO", 1, 4)(lambda c, x, f=12, s=26, *_: fdiv(ema(c, x, f) - ema(c, x, s), ema(c, x, s)) * 100)


def macd(c, x, f=12, s=26, m=9) -> Column:
    dif = ema(c, x, f) - ema(c, x, s)
    sig = ema(c, dif, m)
    return F.struct(dif.alias("dif"), sig.alias("signal"), (dif - sig).alias("hist"))


ts("ts_MACD", 1, 4, returns="struct")(macd)


def true_range(c, h, l, x) -> Column:  # noqa: E741
    p = lag(c, dbl(x))
    return F.greatest(dbl(h) - dbl(l), F.abs(dbl(h) - p), F.abs(dbl(l) - p))


ts("ts_TR ts_TRANGE", 3, 3, "1")(true_range)
ts("ts_ATR", 3, 4, 3)(lambda c, h, l, x, n=14: rma(c, true_range(c, h, l, x), n))
ts("ts_NATR", 3, 4, 3)(lambda c, h, l, x, n=14: fdiv(rma(c, true_range(c, h, l, x), n), x) * 100)


def moves(c, h, l) -> tuple[Column, Column]:  # noqa: E741
    up, down = dbl(h) - lag(c, dbl(h)), lag(c, dbl(l)) - dbl(l)
    return F.when((up > down) & (up > 0), up).when(up.isNotNull(), 0.0), F.when((down > up) & (down > 0), down).when(down.isNotNull(), 0.0)


ts("ts_PLUS_DM", 2, 3, 2)(lambda c, h, l, n=14: rma(c, moves(c, h, l)[0], n) * int(n))
ts("ts_MINUS_DM", 2, 3, 2)(lambda c, h, l, n=14: rma(c, moves(c, h, l)[1], n) * int(n))


def di(c, h, l, x, n, side) -> Column:  # noqa: E741
    return fdiv(rma(c, moves(c, h, l)[side], n), rma(c, true_range(c, h, l, x), n)) * 100


ts("ts_PLUS_DI", 3, 4, 3)(lambda c, h, l, x, n=14: di(c, h, l, x, n, 0))
ts("ts_MINUS_DI", 3, 4, 3)(lambda c, h, l, x, n=14: di(c, h, l, x, n, 1))


def adx(c, h, l, x, n=14, m=None) -> Column:  # noqa: E741
    p, q = di(c, h, l, x, n, 0), di(c, h, l, x, n, 1)
    return rma(c, fdiv(F.abs(p - q), p + q) * 100, m or n)


ts("ts_ADX", 3, 5, 3)(adx)
ts("ts_ADXR", 3, 5, 3)(lambda c, h, l, x, n=14, m=None: (adx(c, h, l, x, n, m) + lag(c, adx(c, h, l, x, n, m), int(n))) / 2)


def rsi(c, x, n=14) -> Column:
    d = dbl(x) - lag(c, dbl(x))
    up, down = rma(c, F.when(d.isNotNull(), F.greatest(d, F.lit(0.0))), n), rma(c, F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0))), n)
    return 100 * fdiv(up, up + down)


ts("ts_RSI", 1, 2)(rsi)


def rsv(c, h, l, x, n=9) -> Column:  # noqa: E741
    lo, hi = low(c, l, n), high(c, h, n)
    return fdiv(dbl(x) - lo, hi - lo) * 100


ts("ts_RSV", 3, 4, 3)(rsv)
ts("ts_WILLR", 3, 4, 3)(lambda c, h, l, x, n=14: fdiv(high(c, h, n) - dbl(x), high(c, h, n) - low(c, l, n)) * -100)


def kdj(c, h, l, x, n=9, m1=3, m2=3) -> Column:  # noqa: E741
    k = sma_cn(c, rsv(c, h, l, x, n), m1)
    d = sma_cn(c, k, m2)
    return F.struct(k.alias("K"), d.alias("D"), (3 * k - 2 * d).alias("J"))


ts("ts_KDJ", 3, 6, 3, "struct")(kdj)
ts("ts_STOCHF", 3, 5, 3, "struct")(lambda c, h, l, x, n=5, m=3: F.struct(rsv(c, h, l, x, n).alias("K"), avg(c, rsv(c, h, l, x, n), m).alias("D")))
ts("ts_BOLL", 1, 3)(lambda c, x, d=20, k=2: avg(c, x, d) + float(k) * std(c, x, d, 1))
ts("BBANDS", 1, 5, returns="struct")(lambda c, x, d=5, up=2, dn=2, *_: F.struct((avg(c, x, d) + float(up) * std(c, x, d, 0)).alias("upper"), avg(c, x, d).alias("middle"), (avg(c, x, d) - float(dn) * std(c, x, d, 0)).alias("lower")))


def avedev(c, x, d=20) -> Column:
    """Mean absolute deviation from the window's mean."""
    x = dbl(x)
    arr = F.collect_list(x).over(rows(c.ts, int(d)))
    m = F.avg(x).over(rows(c.ts, int(d)))
    n = F.size(arr)
    return F.when(n >= int(d), F.aggregate(arr, F.lit(0.0), lambda a, v: a + F.abs(v - m)) / n)


ts("ts_AVEDEV", 1, 2)(avedev)


def cci(c, h, l, x, d=14) -> Column:  # noqa: E741
    tp = (dbl(h) + dbl(l) + dbl(x)) / 3
    return fdiv(tp - avg(c, tp, d), 0.015 * avedev(c, tp, d))


ts("ts_CCI", 3, 4, 3)(cci)
ts("ts_BIAS", 1, 2)(lambda c, x, d=6: (fdiv(x, avg(c, x, d)) - 1) * 100)
ts("ts_BBI", 1, 5)(lambda c, x, a=3, b=6, d=12, e=24: (avg(c, x, a) + avg(c, x, b) + avg(c, x, d) + avg(c, x, e)) / 4)
ts("ts_DPO", 1, 2)(lambda c, x, d=20: dbl(x) - lag(c, avg(c, x, d), int(d) // 2 + 1))
ts("ts_PSY", 1, 2)(lambda c, x, d=12: count_true(c, dbl(x) > lag(c, dbl(x)), d) / int(d) * 100)
ts("ts_MIDPOINT", 1, 2)(lambda c, x, d=14: (high(c, x, d) + low(c, x, d)) / 2)
ts("ts_MIDPRICE", 2, 3, 2)(lambda c, h, l, d=14: (high(c, h, d) + low(c, l, d)) / 2)
ts("ts_AROON", 2, 3, 2, "struct")(lambda c, h, l, d=14: F.struct((100 - 100.0 * bars_since(c, h, int(d) + 1, "max") / int(d)).alias("up"), (100 - 100.0 * bars_since(c, l, int(d) + 1, "min") / int(d)).alias("down")))


def ad(c, h, l, x, v) -> Column:  # noqa: E741
    clv = fdiv((dbl(x) - dbl(l)) - (dbl(h) - dbl(x)), dbl(h) - dbl(l))
    return F.sum(F.when(dbl(h) != dbl(l), clv * dbl(v)).otherwise(0.0)).over(running(c.ts))


ts("ts_AD", 4, 4, "unbounded")(ad)
ts("ts_ADOSC", 4, 6, 4)(lambda c, h, l, x, v, f=3, s=10: ema(c, ad(c, h, l, x, v), f) - ema(c, ad(c, h, l, x, v), s))
ts("ts_OBV", 2, 2, "unbounded")(lambda c, x, v: F.sum(F.coalesce(F.signum(dbl(x) - lag(c, dbl(x))), F.lit(0.0)) * dbl(v)).over(running(c.ts)))
ts("ts_BRAR_AR", 4, 5, 4)(lambda c, o, h, l, x, d=26: fdiv(total(c, dbl(h) - dbl(o), d), total(c, dbl(o) - dbl(l), d)) * 100)
_pos = lambda v: F.when(v.isNotNull(), F.greatest(v, F.lit(0.0)))
ts("ts_BRAR_BR", 4, 5, 4)(lambda c, o, h, l, x, d=26: fdiv(total(c, _pos(dbl(h) - lag(c, dbl(x))), d), total(c, _pos(lag(c, dbl(x)) - dbl(l)), d)) * 100)


def cr(c, h, l, d=26) -> Column:  # noqa: E741
    mid = lag(c, (dbl(h) + dbl(l)) / 2)
    return fdiv(total(c, _pos(dbl(h) - mid), d), total(c, _pos(mid - dbl(l)), d)) * 100


ts("ts_CR", 2, 3, 2)(cr)


def emv(c, h, l, v, d=14) -> Column:  # noqa: E741
    mid = (dbl(h) + dbl(l)) / 2
    return avg(c, fdiv((mid - lag(c, mid)) * (dbl(h) - dbl(l)), v), d)


ts("ts_EMV", 3, 4, 3)(emv)
ts("ts_MASS", 2, 4, 2)(lambda c, h, l, d=25, n=9: total(c, fdiv(ema(c, dbl(h) - dbl(l), n), ema(c, ema(c, dbl(h) - dbl(l), n), n)), d))


def mfi(c, h, l, x, v, d=14) -> Column:  # noqa: E741
    tp = (dbl(h) + dbl(l) + dbl(x)) / 3
    up = total(c, F.when(tp > lag(c, tp), tp * dbl(v)).otherwise(0.0), d)
    dn = total(c, F.when(tp < lag(c, tp), tp * dbl(v)).otherwise(0.0), d)
    return 100 * fdiv(up, up + dn)


ts("ts_MFI", 4, 5, 4)(mfi)


def vr(c, x, v, d=26) -> Column:
    ch = dbl(x) - lag(c, dbl(x))
    part = lambda cond: total(c, F.when(cond, dbl(v)).otherwise(0.0), d)
    flat = part(ch == 0)
    return fdiv(part(ch > 0) + flat / 2, part(ch < 0) + flat / 2) * 100


ts("ts_VR", 2, 3, 2)(vr)
ts("ts_signals_to_size", 4, 6, "unbounded")(lambda c, a, b, d, e, acc=False, action=False: c.stage("size", [dbl(v) for v in (a, b, d, e)], float(bool(acc)), float(bool(action))))
ts("ts_WINNER_COST", 5, 7, None, "struct")(lambda c, h, l, p, t, x, share=0.5, step=0.1: F.struct(c.stage("chips", [h, l, p, t, x], "winner", float(step), 1.0, float(share)).alias("winner"), c.stage("chips", [h, l, p, t, x], "cost", float(step), 1.0, float(share)).alias("cost")))
ts("ts_pred", 1, None, "unbounded")(lambda c, y, *xs, d=0: c.stage("rolling_ols", [dbl(y), *map(dbl, xs)], int(d), "pred"))
ts("ts_resid", 1, None, "unbounded")(lambda c, y, *xs, d=0: c.stage("rolling_ols", [dbl(y), *map(dbl, xs)], int(d), "resid"))


def up_stat(c, flag_) -> Column:
    """(T, N): limit-ups in the current streak's stretch of days, gaps of one day allowed between them."""
    from loomspan.functions.timeseries import flag, streak

    f = flag(flag_)
    gap = (f == 0) & (F.coalesce(F.lag(f).over(c.ts), F.lit(0)) == 0)
    grp = F.sum(F.when(gap, 1).otherwise(0)).over(running(c.ts))
    from pyspark.sql import Window

    w = Window.partitionBy(c.code, grp).orderBy(c.date).rowsBetween(Window.unboundedPreceding, 0)
    first = F.min(F.when(f == 1, F.row_number().over(c.ts))).over(w)
    n = F.sum(f).over(w)
    t = F.when(n > 0, F.row_number().over(c.ts) - first + 1).otherwise(0)
    return F.struct(t.alias("days"), n.alias("ups"), streak(c, flag_).alias("run"))


ts("ts_up_stat", 1, 1, "unbounded", "struct")(up_stat)

# ---- patterns: booleans of a few rows; body, shadow and volume ratios are parameters
bull = lambda o, x: dbl(x) > dbl(o)
bear = lambda o, x: dbl(x) < dbl(o)


def P(names, least, most=-1, window=None):
    return ts(names, least, most, window)


P("ts_N天内出现以涨停收盘 ts_N天内出现涨停", 1, 2, 1)(lambda c, f, n=5: exist(c, f, n))
P("ts_N天内经常涨停", 1, 3, 1)(lambda c, f, n=10, m=3: count_true(c, f, n) >= int(m))
P("ts_N天内有跳空向上缺口", 2, 4, 2)(lambda c, h, l, n=5, k=0.0: exist(c, dbl(l) > lag(c, dbl(h)) * (1 + float(k)), n))
P("ts_N日内上涨多于下跌", 1, 3, 1)(lambda c, x, n=10, r=0.5: count_true(c, dbl(x) > lag(c, dbl(x)), n) > int(n) * float(r))
P("ts_N日内下跌多于上涨", 1, 3, 1)(lambda c, x, n=10, r=0.5: count_true(c, dbl(x) < lag(c, dbl(x)), n) > int(n) * float(r))
P("ts_N日内阳线多于阴线", 2, 4, 2)(lambda c, o, x, n=10, r=0.5: count_true(c, bull(o, x), n) > int(n) * float(r))
P("ts_N日内阴线多于阳线", 2, 4, 2)(lambda c, o, x, n=10, r=0.5: count_true(c, bear(o, x), n) > int(n) * float(r))
P("ts_N日内创新高", 1, 2, 1)(lambda c, x, n=10: exist(c, dbl(x) > lag(c, high(c, x, n)), n))
P("ts_N日内创新低", 1, 2, 1)(lambda c, x, n=10: exist(c, dbl(x) < lag(c, low(c, x, n)), n))
P("ts_近日创历史新高", 1, 3, 1)(lambda c, x, n=5, *_: exist(c, dbl(x) >= F.max(dbl(x)).over(running(c.ts)), n))
P("ts_近日创历史新低", 1, 3, 1)(lambda c, x, n=5, *_: exist(c, dbl(x) <= F.min(dbl(x)).over(running(c.ts)), n))
P("ts_连续N天收阳线", 2, 3, 2)(lambda c, o, x, n=3: every(c, bull(o, x), n))
P("ts_连续N天收阴线", 2, 3, 2)(lambda c, o, x, n=3: every(c, bear(o, x), n))
P("ts_四串阳", 2)(lambda c, o, x: every(c, bull(o, x), 4))
P("ts_四串阴", 2)(lambda c, o, x: every(c, bear(o, x), 4))
P("ts_持续放量", 1, 2, 1)(lambda c, v, n=3: every(c, dbl(v) > lag(c, dbl(v)), n))
P("ts_持续缩量", 1, 2, 1)(lambda c, v, n=3: every(c, dbl(v) < lag(c, dbl(v)), n))
P("ts_单日放量", 2, 4)(lambda c, x, v, k=2.0, r=0.0: (dbl(v) > lag(c, dbl(v)) * float(k)) & (dbl(x) >= lag(c, dbl(x)) * (1 + float(r))))
P("ts_突然放量", 1, 3, 1)(lambda c, v, n=10, k=2.0: dbl(v) > lag(c, high(c, v, n)) * float(k) / 2)
P("ts_间隔放量", 1, 5, 1)(lambda c, v, n=5, k=1.5, *_: (dbl(v) > lag(c, avg(c, v, n)) * float(k)) & (lag(c, dbl(v), 1) < dbl(v)) & (lag(c, dbl(v), 2) > lag(c, avg(c, v, n), 2) * float(k)))
P("ts_阶段放量", 2, 4, 2)(lambda c, x, v, n=5, k=1.5: (avg(c, v, n) > lag(c, avg(c, v, n), int(n)) * float(k)) & (dbl(x) > lag(c, dbl(x), int(n))))
P("ts_阶段缩量", 2, 4, 2)(lambda c, x, v, n=5, k=0.67: (avg(c, v, n) < lag(c, avg(c, v, n), int(n)) * float(k)) & (dbl(x) < lag(c, dbl(x), int(n))))
P("ts_均线多头排列", 2, 6, 2)(lambda c, x, a=5, b=10, d=20, *_: (avg(c, x, a) > avg(c, x, b)) & (avg(c, x, b) > avg(c, x, d)))
P("ts_均线空头排列", 2, 6, 2)(lambda c, x, a=5, b=10, d=20, *_: (avg(c, x, a) < avg(c, x, b)) & (avg(c, x, b) < avg(c, x, d)))
P("ts_平台整理", 1, 3, 1)(lambda c, x, n=10, k=0.1: fdiv(high(c, x, n), low(c, x, n)) < 1 + float(k))
P("ts_强势整理", 2, 4, 2)(lambda c, h, l, n=10, k=0.1: (low(c, l, n) > lag(c, low(c, l, n), int(n))) & (fdiv(high(c, h, n), low(c, l, n)) < 1 + float(k)))
P("ts_拉升后多日调整", 1, 3, 1)(lambda c, x, n=3, k=0.09: (fdiv(lag(c, dbl(x), int(n)), lag(c, dbl(x), int(n) + 1)) > 1 + float(k)) & every(c, dbl(x) <= lag(c, dbl(x), int(n)), 1) & (high(c, x, n) <= lag(c, dbl(x), int(n))))
P("ts_突破长期盘整", 3, 5, 3)(lambda c, h, l, x, n=60, k=0.3: (lag(c, fdiv(high(c, h, n), low(c, l, n))) < 1 + float(k)) & (dbl(x) > lag(c, high(c, h, n))))
P("ts_低开大阳线", 2, 4)(lambda c, o, x, g=0.0, b=0.05: (dbl(o) < lag(c, dbl(x)) * (1 - float(g))) & (fdiv(x, o) > 1 + float(b)))
P("ts_高开大阴线", 2, 4)(lambda c, o, x, g=0.0, b=0.05: (dbl(o) > lag(c, dbl(x)) * (1 + float(g))) & (fdiv(x, o) < 1 - float(b)))
P("ts_跳空缺口选股", 2)(lambda c, h, l: dbl(l) > lag(c, dbl(h)))
P("ts_跳空高开或低开", 4, 5)(lambda c, o, h, l, x, k=0.02: (fdiv(o, lag(c, dbl(x))) > 1 + float(k)) | (fdiv(o, lag(c, dbl(x))) < 1 - float(k)))
P("ts_下跌多日再放量上涨", 3)(lambda c, o, x, v: lag(c, every(c, dbl(x) < lag(c, dbl(x)), 3)) & bull(o, x) & (dbl(v) > lag(c, dbl(v)) * 1.5))
P("ts_价量渐低后阳包阴", 3)(lambda c, o, x, v: lag(c, every(c, (dbl(x) < lag(c, dbl(x))) & (dbl(v) < lag(c, dbl(v))), 2)) & lag(c, bear(o, x)) & bull(o, x) & (dbl(o) <= lag(c, dbl(x))) & (dbl(x) >= lag(c, dbl(o))))
P("ts_低点搜寻", 3, 4, 3)(lambda c, h, l, x, n=21: (low(c, l, n) == dbl(l)) & (dbl(x) > (dbl(h) + dbl(l)) / 2))
P("ts_出水芙蓉", 2, 5, 2)(lambda c, o, x, a=5, b=10, d=20: (dbl(o) < F.least(avg(c, x, a), avg(c, x, b), avg(c, x, d))) & (dbl(x) > F.greatest(avg(c, x, a), avg(c, x, b), avg(c, x, d))))
P("ts_出水芙蓉II", 2, 4)(lambda c, o, x, a=20, b=40: (dbl(o) < F.least(avg(c, x, a), avg(c, x, b))) & (dbl(x) > F.greatest(avg(c, x, a), avg(c, x, b))) & (fdiv(x, o) > 1.03))
P("ts_剑", 6)(lambda c, o, h, l, x, v, k: (F.least(dbl(o), dbl(x)) - dbl(l) > 2 * F.abs(dbl(x) - dbl(o))) & (dbl(h) - F.greatest(dbl(o), dbl(x)) < F.abs(dbl(x) - dbl(o))) & (dbl(v) > lag(c, dbl(v)) * dbl(k)))
P("ts_小步碎阳", 6, 7, 6)(lambda c, o, h, l, x, v, k, n=5: every(c, bull(o, x) & (fdiv(x, o) < 1 + dbl(k)), n))
P("ts_揉搓线", 5, 6, 5)(lambda c, o, h, l, x, k=2.0, n=1: lag(c, dbl(h) - F.greatest(dbl(o), dbl(x)) > dbl(k) * F.abs(dbl(x) - dbl(o)), n) & (F.least(dbl(o), dbl(x)) - dbl(l) > dbl(k) * F.abs(dbl(x) - dbl(o))))
P("ts_放量上攻", 3, 7, 4)(lambda c, o, x, v, k=1.5, n=5, *_: bull(o, x) & (dbl(v) > lag(c, avg(c, v, n)) * float(k)) & (dbl(x) > lag(c, high(c, x, n))))
P("ts_温和放量上攻", 3, 4, 3)(lambda c, o, x, v, n=5: bull(o, x) & (dbl(v) > lag(c, avg(c, v, n))) & (dbl(v) < lag(c, avg(c, v, n)) * 2) & (dbl(x) > lag(c, avg(c, x, n))))
P("ts_早晨之星", 2)(lambda c, o, x: lag(c, bear(o, x), 2) & (lag(c, F.abs(dbl(x) - dbl(o))) < 0.3 * lag(c, F.abs(dbl(x) - dbl(o)), 2)) & bull(o, x) & (dbl(x) > lag(c, (dbl(o) + dbl(x)) / 2, 2)))
P("ts_旭日初升", 2, 3, 2)(lambda c, o, x, n=2: lag(c, bear(o, x)) & bull(o, x) & (dbl(o) > lag(c, dbl(x))) & (dbl(x) > lag(c, dbl(o))))
P("ts_昨日底部十字星", 4, 5, 4)(lambda c, o, h, l, x, n=20: lag(c, (F.abs(dbl(x) - dbl(o)) <= 0.1 * (dbl(h) - dbl(l))) & (dbl(l) == low(c, l, n))))
P("ts_蜻蜓点水", 1, 2, 1)(lambda c, x, n=20: (lag(c, dbl(x)) >= lag(c, avg(c, x, n))) & (dbl(x) >= avg(c, x, n)) & (fdiv(dbl(x), avg(c, x, n)) < 1.01))
