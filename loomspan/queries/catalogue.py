"""Queries of further catalogue operators: bundles of formulas on the monthly panel, each with its SQL expression.

The SQL is staged: y and z hold windowed values whose lags, smoothings or windows the expressions need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions.numeric import dbl
from loomspan.functions.recursive import StagedContext, run_stages
from loomspan.functions.registry import OPS
from loomspan.plans import formula
from loomspan.queries import panels
from loomspan.queries.common import table
from loomspan.queries.operators import HELPERS, NUDGE, WINDOWS, ema, g

MORE_WINDOWS = WINDOWS + ", r3 as (partition by code order by date rows between 2 preceding and current row), r4 as (partition by code order by date rows between 3 preceding and current row)"


def full(e: str, d: int) -> str:
    return f"case when count(*) over r{d} = {d} then {e} end"


def smooth(x: str, a: str) -> str:
    """Recursive smoothing; null where the value is."""
    return f"case when {x} is not null then {ema(x, a)} end"


_Y = f"""y as (select *, case when close < pc then 1 else 0 end as dn, case when close < open then 1 else 0 end as bear, abs(close - open) as body, high - low as hl, close / open as u, volume / 100 as v,
  ln(close) - ln(pc) as ld, case when high - ph > pl - low and high - ph > 0 then high - ph when ph is not null then 0 end as pdm, case when pl - low > high - ph and pl - low > 0 then pl - low when pl is not null then 0 end as mdm,
  case when high <> low then ((close - low) - (high - close)) / (high - low) * volume else 0 end as clv, case when close = open then 0 when close > open then 1 else -1 end as sg,
  {g('avg(close) over r2', 2)} as av2, {g('avg(close) over r5', 5)} as av5, {g('avg(close) over r10', 10)} as av10, {g('max(close) over r2', 2)} as hi2, {g('max(close) over r5', 5)} as hi5, {g('min(close) over r5', 5)} as lo5,
  {g('max(high) over r5', 5)} as hh5, {g('min(low) over r5', 5)} as ll5, {g('max(high) over r10', 10)} as hh10, {g('min(low) over r10', 10)} as ll10, {g('max(volume) over r5', 5, 'volume')} as vhi5, {g('avg(volume) over r5', 5, 'volume')} as vav5,
  max(close) over cum as mx, min(close) over cum as mn, {ema('close', '2.0 / 6')} as e5, {ema('close', '2.0 / 11')} as e10, {ema('high - low', '2.0 / 6')} as h5, list(close) over cum as seen,
  quantile_cont(close, 0.5) over cs as med from x {MORE_WINDOWS}),
z as (select *, {full('sum(dn) over r3', 3)} = 3 as down3, {full('sum(case when close < pc and volume < pv then 1 else 0 end) over r2', 2)} = 2 as lower2, {full('sum(bear) over r2', 2)} = 2 as below2, close > lag(hi5) over w as new_high, close < lag(lo5) over w as new_low,
  sum(clv) over cum as ad, case when sg is not distinct from lag(sg) over w then 0 else 1 end as turn, sum(case when up = 0 then 1 else 0 end) over cum as grp, {ema('e5', '2.0 / 6')} as ee5, {ema('h5', '2.0 / 6')} as hh_5, e5 - e10 as dif, {smooth('pdm', '0.2')} as pr, {smooth('mdm', '0.2')} as mr, {ema('tr', '0.2')} as trr,
  (close - ll10) / (hh10 - ll10) * 100 as rsv, {g('avg(tp) over r10', 10, 'tp')} as atp, list(tp) over r10 as ltp, list(u) over r10 as lx, list(v) over r10 as ly, list(high / low) over r10 as lz, avg(u) over r10 as ux, avg(v) over r10 as uy, avg(high / low) over r10 as uz,
  abs(close - med) as adev, avg(volume * close) over cs / avg(volume) over cs as wc, avg(volume * open) over cs / avg(volume) over cs as wo, dense_rank() over (partition by date, up order by close) - 1 as lev from y {MORE_WINDOWS}),
z2 as (select *, sum(turn) over cum as run, {ema('ee5', '2.0 / 6')} as eee5, {smooth('dif', '2.0 / 5')} as sig, pr / trr * 100 as pdi, mr / trr * 100 as mdi, {smooth('rsv', '1.0 / 3')} as k3, quantile_cont(adev, 0.5) over cs as mad, h5 / hh_5 as mass, {ema('ad', '2.0 / 6')} as ad5, {ema('ad', '2.0 / 11')} as ad10 from z {MORE_WINDOWS}),
z3 as (select *, {smooth('k3', '1.0 / 3')} as d3, abs(pdi - mdi) / nullif(pdi + mdi, 0) * 100 as dx, least(greatest(close, med - 3 * 1.4826 * mad), med + 3 * 1.4826 * mad) as mc, least(greatest(close, quantile_cont(close, 0.025) over cs), quantile_cont(close, 0.975) over cs) as qc from z2 {MORE_WINDOWS}),
z4 as (select *, {smooth('dx', '0.2')} as adx, (mc - avg(mc) over cs) / nullif(stddev_samp(mc) over cs, 0) as mz, (close - avg(close) over cs) / nullif(stddev_samp(close) over cs, 0) as cz, sum(volume * (open - wo) * (close - wc)) over cs / nullif(sum(volume * (open - wo) * (open - wo)) over cs, 0) as wb from z3 {MORE_WINDOWS}),
z5 as (select *, mz - avg(mz) over cs - coalesce(covar_samp(mz, volume) over cs / nullif(var_samp(volume) over cs, 0), 0) * (volume - avg(volume) over cs) as mzr, close - avg(close) over cs - coalesce(covar_samp(close, volume) over cs / nullif(var_samp(volume) over cs, 0), 0) * (volume - avg(volume) over cs) as cr from z4 {MORE_WINDOWS})"""


def mom(*powers: int) -> str:
    """Mean over the window lists lx, ly, lz of the product of centred values to powers."""
    prod = " * ".join(f"pow({a}[i] - {m}, {p})" for (a, m), p in zip((("lx", "ux"), ("ly", "uy"), ("lz", "uz")), powers, strict=False) if p)
    return f"list_avg(list_transform(range(1, 11), lambda i: {prod}))"


def moment(e: str) -> str:
    return f"case when len(lx) = 10 then {e} end"


def most(d: int, k: str) -> str:
    """The greatest values of close in the window."""
    return f"list_reverse_sort(list(close) over r{d})[1:{k}]"


RES = "{0} - avg({0}) over cs - coalesce(covar_samp({0}, volume) over cs / nullif(var_samp(volume) over cs, 0), 0) * (volume - avg(volume) over cs)"
Z = "({0} - avg({0}) over cs) / nullif(stddev_samp({0}) over cs, 0)"
REG = "covar_pop(u, v) over r10 / var_pop(v) over r10"

BUNDLES: dict[str, list[tuple[str, str, str]]] = {
    "op_el_trigonometry": [
        ("a", "cos(close)", "cos(close)"), ("b", "sin(close)", "sin(close)"), ("c", "tan(close / 10000)", "tan(close / 10000)"), ("d", "arc_cos(low / high / 2)", "acos(low / high / 2)"), ("e", "arc_sin(low / high / 2)", "asin(low / high / 2)"), ("f", "arc_tan(close / 1000)", "atan(close / 1000)"),
        ("g", "arc_tan2(open, close)", "atan2(open, close)"), ("h", "cosh(close / 100000)", "(exp(close / 100000) + exp(-close / 100000)) / 2"), ("i", "sinh(close / 100000)", "(exp(close / 100000) - exp(-close / 100000)) / 2"), ("j", "tanh(close / 2000)", "1 - 2 / (exp(close / 1000) + 1)"),
        ("k", "cot(close / 10000)", "1 / tan(close / 10000)"), ("l", "degrees(close / 1000)", "degrees(close / 1000)"), ("m", "radians(close)", "radians(close)"), ("n", "expm1(low / high)", "exp(low / high) - 1"), ("o", "log1p(close)", "ln(1 + close)"), ("p", "log2(close)", "log2(close)"),
        ("q", "logit(low / high * 0.9)", "ln(low / high * 0.9 / (1 - low / high * 0.9))"), ("r", "cube(close / 1000)", "pow(close / 1000, 3)"), ("s", "square(close / 1000)", "pow(close / 1000, 2)"), ("t", "inverse(close / 1000)", "1000 / close"),
    ],
    "op_el_logic": [
        ("a", "or_(close > open, volume > 100)", "(close > open or volume > 100)::int"), ("b", "xor(close > open, volume > 100)", "((close > open) <> (volume > 100))::int"), ("c", "not_(close > open)", "(not close > open)::int"), ("d", "equal(floor(close / 700), floor(open / 700))", "(floor(close / 700) = floor(open / 700))::int"),
        ("e", "less(close, open)", "(close < open)::int"), ("f", "BETWEEN(close, high, open)", "(close >= least(high, open) and close <= greatest(high, open))::int"), ("g", "RANGE(close, low, high)", "(close > low and close < high)::int"), ("h", "IFN(close > open, high, low)", "case when close > open then low else high end"),
        ("i", "bool_(sign(close - open))", "(close <> open)::int"), ("j", "is_null(ts_delay(close, 1))", "(pc is null)::int"), ("k", "is_not_null(ts_delay(close, 1))", "(pc is not null)::int"), ("l", "is_finite(log(close - open))", "(close > open)::int"), ("m", "is_nan(log(close - open))", "(close < open)::int"),
        ("n", "is_not_nan(log(close - open))", "(close >= open)::int"), ("o", "is_not_finite(log(close - open))", "(close <= open)::int"), ("p", "purify(log(close - open))", "case when close > open then ln(close - open) end"), ("q", "fill_nan(log(close - open + 0.001))", "case when close - open + 0.001 > 0 then ln(close - open + 0.001) end"),
        ("r", "fill_null(ts_delay(close, 1), 3)", "coalesce(pc, 3)"), ("s", "int_(close)", "trunc(close)"), ("t", "float_(close > open)", "(close > open)::int"), ("u", "lit_(2) * close", "2 * close"), ("v", "nop(close)", "close"),
        ("w1", "left_tail(close, 1300)", "case when close <= 1300 then close end"), ("w2", "right_tail(close, 1300)", "case when close >= 1300 then close end"), ("w3", "tail(close, 1200, 1500, 7)", "case when close between 1200 and 1500 then 7 else close end"),
    ],
    "op_el_arithmetic": [
        ("a", "MUL(open, close, 0.001)", "open * close * 0.001"), ("b", "SUB(close, open)", "close - open"), ("c", "DIV(close, open)", "close / open"), ("d", "POW(close / 1000, 1.5)", "pow(close / 1000, 1.5)"), ("e", "negate(close)", "-close"), ("f", "MEDPRICE(high, low)", "(high + low) / 2"),
        ("h", "round_down(close / 7, 1)", "floor(close / 7 * 10) / 10"), ("i", "std(open, high, low)", "sqrt((pow(open - (open + high + low) / 3, 2) + pow(high - (open + high + low) / 3, 2) + pow(low - (open + high + low) / 3, 2)) / 2)"),
        ("j", "var(open / close, high / close)", "pow(open / close - high / close, 2) / 2"), ("k", "ROUND(close / 7.0003, 1)", "round(close / 7.0003, 1)"), ("l", "ROUND2(close / 7.0003, 1)", "round(close / 7.0003, 1)"),
    ],
    "op_ts_windows": [
        ("a", "ts_ROCR(close, 5)", "close / lag(close, 5) over w"), ("b", "ts_BOLL_M(close, 10)", "av10"), ("c", "ts_STD(close, 10)", g("stddev_samp(close) over r10", 10)), ("d", "ts_STDDEV(close, 5, 2)", g("2 * stddev_pop(close) over r5", 5)), ("e", "ts_STDP(close, 10)", g("stddev_pop(close) over r10", 10)),
        ("f", "ts_VAR(close / open, 5)", g("var_samp(u) over r5", 5)), ("h", "ts_decay_exp_window(close, 3, 0.5)", "(close + 0.5 * pc + 0.25 * lag(close, 2) over w) / 1.75"), ("i", "ts_count_eq(floor(close / open), 5, 1)", full("sum(case when floor(u) = 1 then 1 else 0 end) over r5", 5)),
        ("j", "ts_count_nulls(ts_delay(close, 1), 5)", full("sum(case when pc is null then 1 else 0 end) over r5", 5)), ("k", "ts_count_nans(log(close - open), 5)", full("sum(case when close < open then 1 else 0 end) over r5", 5)), ("l", "ts_cum_prod(1 + returns(close) / 100)", "product(1 + ret / 100) over cum"),
        ("m", "ts_min_diff(close, 5)", "close - lo5"), ("n", "ts_min_max_cps(close, 5)", "lo5 + hi5 - 2 * close"), ("o", "ts_realized_volatility(close, 5)", g("sqrt(sum(ld * ld) over r5)", 5, "ld")), ("p", "ts_weighted_sum(close / open, volume / 100, 5)", g("sum(u * v) over r5", 5)),
        ("q", "ts_BARSSINCEN(close > open, 5)", "rn - min(case when up = 1 then rn end) over r5"), ("r", "ts_LONGCROSS(close, open, 2)", "(close > open and lag(below2) over w)::int"), ("s", "ts_DOWNNDAY(close, 2)", full("(sum(dn) over r2 = 2)::int", 2)),
        ("t", "ts_EXISTR(close > open, 5, 2)", "(max(up) over (partition by code order by date rows between 5 preceding and 2 preceding) = 1)::int"), ("u", "ts_LAST(close > open, 3, 2)", "(min(up) over (partition by code order by date rows between 3 preceding and 2 preceding) = 1)::int"),
        ("v", "ts_MAXINDEX(close, 10)", g("arg_max(rn, close) over r10 - 1", 10)), ("w1", "ts_MININDEX(close, 10)", g("arg_min(rn, close) over r10 - 1", 10)), ("w2", "ts_cum_sum_reset(close - open)", "sum(close - open) over (partition by code, run order by date)"),
        ("w3", "ts_cum_sum_by(volume, close > open)", "case when up = 1 then sum(case when up = 1 then volume end) over (partition by code, grp order by date) else 0 end"), ("w4", "ts_cum_prod_by(returns(close) / 100, close > open)", "case when up = 1 then product(1 + coalesce(ret, 0) / 100) over (partition by code, grp order by date) else 1 end"),
    ],
    "op_ts_comoments": [
        ("a", "ts_co_skewness(close / open, volume / 100, 10)", moment(f"{mom(1, 2)} / (sqrt({mom(2)}) * {mom(0, 2)})")), ("b", "ts_co_kurtosis(close / open, volume / 100, 10)", moment(f"{mom(1, 3)} / (sqrt({mom(2)}) * pow({mom(0, 2)}, 1.5))")),
        ("c", "ts_triple_corr(close / open, volume / 100, high / low, 10)", moment(f"{mom(1, 1, 1)} / sqrt({mom(2)} * {mom(0, 2)} * {mom(0, 0, 2)})")),
        ("d", "ts_partial_corr(close / open, volume / 100, high / low, 10)", g("(corr(u, v) over r10 - corr(u, high / low) over r10 * corr(v, high / low) over r10) / sqrt((1 - pow(corr(u, high / low) over r10, 2)) * (1 - pow(corr(v, high / low) over r10, 2)))", 10)),
        ("e", "ts_regression_intercept(close / open, volume / 100, 10)", g(f"avg(u) over r10 - {REG} * avg(v) over r10", 10)), ("f", "ts_regression_pred(close / open, volume / 100, 10)", g(f"avg(u) over r10 + {REG} * (v - avg(v) over r10)", 10)),
        ("h", "ts_pred(close / open, volume / 100, d=10)", g(f"avg(u) over r10 + {REG} * (v - avg(v) over r10)", 10)), ("i", "ts_resid(close / open, volume / 100, d=10)", g(f"u - (avg(u) over r10 + {REG} * (v - avg(v) over r10))", 10)),
    ],
    "op_ts_high_low": [
        ("a", "ts_mean_hl(close, 5, 2)", g(f"list_avg({most(5, '2')})", 5)), ("b", "ts_sum_hl(close, 5, -2)", g("list_sum(list_sort(list(close) over r5)[1:2])", 5)), ("c", "ts_std_hl(close, 5, 3)", g(f"list_stddev_samp({most(5, '3')})", 5)), ("d", "ts_var_hl(close, 5, 3) / close / close", g(f"list_var_samp({most(5, '3')}) / close / close", 5)),
    ],
    "op_ts_smoothed": [
        ("a", "ts_DEMA(close, 5)", "2 * e5 - ee5"), ("b", "ts_TEMA(close, 5)", "3 * e5 - 3 * ee5 + eee5"), ("c", "ts_TRIX(close, 5)", "(eee5 / lag(eee5) over w - 1) * 100"), ("d", "ts_PPO(close, 5, 10)", "(e5 - e10) / e10 * 100"),
        ("e", "ts_EXPMEMA(close, 5)", "case when len(seen) >= 5 then list_reduce(list_concat([list_avg(seen[1:5])], seen[6:]), lambda s, v: s + 2.0 / 6 * (v - s)) end"), ("f", "ts_NATR(high, low, close, 5)", "trr / close * 100"), ("h", "ts_PLUS_DM(high, low, 5)", "pr * 5"), ("i", "ts_MINUS_DM(high, low, 5)", "mr * 5"),
        ("j", "ts_PLUS_DI(high, low, close, 5)", "pdi"), ("k", "ts_MINUS_DI(high, low, close, 5)", "mdi"), ("l", "ts_ADX(high, low, close, 5)", "adx"), ("m", "ts_ADXR(high, low, close, 5)", "(adx + lag(adx, 5) over w) / 2"), ("n", "ts_TRIMA(close, 9)", g("avg(av5) over r5", 5, "av5")),
        ("o", "ts_CCI(high, low, close, 10)", g("(tp - atp) / (0.015 * list_avg(list_transform(ltp, lambda t: abs(t - atp))))", 10)), ("p", "ts_DPO(close, 10)", "close - lag(av10, 6) over w"), ("q", "ts_MASS(high, low, 5, 5)", g("sum(mass) over r5", 5, "mass")), ("r", "ts_ADOSC(high, low, close, volume, 5, 10)", "ad5 - ad10"),
        ("s", "ts_BRAR_BR(open, high, low, close, 10)", g("sum(greatest(high - pc, 0)) over r10 / sum(greatest(pc - low, 0)) over r10 * 100", 10, "pc")),
    ],
    "op_patterns_runs": [
        ("a", "ts_N天内出现以涨停收盘(close > open, 5)", full("(sum(up) over r5 > 0)::int", 5)), ("b", "ts_N天内出现涨停(close > open, 5)", full("(sum(up) over r5 > 0)::int", 5)), ("c", "ts_N天内经常涨停(close > open, 5, 3)", full("(sum(up) over r5 >= 3)::int", 5)), ("d", "ts_N天内有跳空向上缺口(high, low, 5)", full("(sum(case when low > ph then 1 else 0 end) over r5 > 0)::int", 5)),
        ("e", "ts_N日内下跌多于上涨(close, 5)", full("(sum(dn) over r5 > 2.5)::int", 5)), ("f", "ts_N日内阳线多于阴线(open, close, 5)", full("(sum(up) over r5 > 2.5)::int", 5)), ("h", "ts_N日内阴线多于阳线(open, close, 5)", full("(sum(bear) over r5 > 2.5)::int", 5)), ("i", "ts_N日内创新高(close, 5)", full("(sum(case when new_high then 1 else 0 end) over r5 > 0)::int", 5)),
        ("j", "ts_N日内创新低(close, 5)", full("(sum(case when new_low then 1 else 0 end) over r5 > 0)::int", 5)), ("k", "ts_近日创历史新高(close, 5)", full("(sum(case when close >= mx then 1 else 0 end) over r5 > 0)::int", 5)), ("l", "ts_近日创历史新低(close, 5)", full("(sum(case when close <= mn then 1 else 0 end) over r5 > 0)::int", 5)),
        ("m", "ts_连续N天收阴线(open, close, 2)", full("(sum(bear) over r2 = 2)::int", 2)), ("n", "ts_四串阳(open, close)", full("(sum(up) over r4 = 4)::int", 4)), ("o", "ts_四串阴(open, close)", full("(sum(bear) over r4 = 4)::int", 4)), ("p", "ts_持续缩量(volume, 2)", full("(sum(case when volume < pv then 1 else 0 end) over r2 = 2)::int", 2)),
        ("q", "ts_小步碎阳(open, high, low, close, volume, 0.3, 2)", full("(sum(case when up = 1 and u < 1.3 then 1 else 0 end) over r2 = 2)::int", 2)),
    ],
    "op_patterns_volume": [
        ("a", "ts_突然放量(volume, 5, 2)", "(volume > lag(vhi5) over w * 2 / 2)::int"), ("b", "ts_间隔放量(volume, 5, 1.1)", "(volume > lag(vav5) over w * 1.1 and pv < volume and lag(volume, 2) over w > lag(vav5, 2) over w * 1.1)::int"), ("c", "ts_阶段放量(close, volume, 5, 1.1)", "(vav5 > lag(vav5, 5) over w * 1.1 and close > lag(close, 5) over w)::int"),
        ("d", "ts_阶段缩量(close, volume, 5, 0.9)", "(vav5 < lag(vav5, 5) over w * 0.9 and close < lag(close, 5) over w)::int"), ("e", "ts_放量上攻(open, close, volume, 1.1, 5)", "(close > open and volume > lag(vav5) over w * 1.1 and close > lag(hi5) over w)::int"),
        ("f", "ts_温和放量上攻(open, close, volume, 5)", "(close > open and volume > lag(vav5) over w and volume < lag(vav5) over w * 2 and close > lag(av5) over w)::int"), ("h", "ts_下跌多日再放量上涨(open, close, volume)", "(lag(down3) over w and close > open and volume > pv * 1.5)::int"),
        ("i", "ts_价量渐低后阳包阴(open, close, volume)", "(lag(lower2) over w and pc < po and close > open and open <= pc and close >= po)::int"),
    ],
    "op_patterns_shapes": [
        ("a", "ts_均线空头排列(close, 2, 5, 10)", "(av2 < av5 and av5 < av10)::int"), ("b", "ts_强势整理(high, low, 5, 40)", "(ll5 > lag(ll5, 5) over w and hh5 / ll5 < 41)::int"), ("c", "ts_拉升后多日调整(close, 2, 0.09)", "(lag(close, 2) over w / lag(close, 3) over w > 1.09 and coalesce(close <= lag(close, 2) over w, false) and hi2 <= lag(close, 2) over w)::int"),
        ("d", "ts_突破长期盘整(high, low, close, 10, 80)", "(lag(hh10 / ll10) over w < 81 and close > lag(hh10) over w)::int"), ("e", "ts_高开大阴线(open, close, 0, 0.01)", "(open > pc and u < 0.99)::int"), ("f", "ts_跳空高开或低开(open, high, low, close, 0.02)", "(open / pc > 1.02 or open / pc < 0.98)::int"),
        ("h", "ts_低点搜寻(high, low, close, 5)", "(ll5 = low and close > (high + low) / 2)::int"), ("i", "ts_出水芙蓉(open, close, 2, 5, 10)", "(open < least(av2, av5, av10) and close > greatest(av2, av5, av10))::int"), ("j", "ts_出水芙蓉II(open, close, 5, 10)", "(open < least(av5, av10) and close > greatest(av5, av10) and u > 1.03)::int"),
        ("k", "ts_剑(open, high, low, close, volume, 1)", "(least(open, close) - low > 2 * body and high - greatest(open, close) < body and volume > pv)::int"), ("l", "ts_揉搓线(open, high, low, close, 0.5)", "(lag(high - greatest(open, close) > 0.5 * body) over w and least(open, close) - low > 0.5 * body)::int"),
        ("m", "ts_早晨之星(open, close)", "(lag(close < open, 2) over w and lag(body) over w < 0.3 * lag(body, 2) over w and close > open and close > lag((open + close) / 2, 2) over w)::int"), ("n", "ts_昨日底部十字星(open, high, low, close, 5)", "(lag(body <= 0.1 * (high - low) and low = ll5) over w)::int"),
        ("o", "ts_蜻蜓点水(close, 5)", "(pc >= lag(av5) over w and close >= av5 and close / av5 < 1.01)::int"),
    ],
    "op_cs_residuals": [
        ("a", "cs_fill_except_all_null(if_else(close > open, close / open), 0)", "case when count(case when up = 1 then u end) over cs > 0 then coalesce(case when up = 1 then u end, 0) end"), ("b", "cs_fill_min(if_else(close > open, close / open))", "coalesce(case when up = 1 then u end, min(case when up = 1 then u end) over cs)"),
        ("c", "cs_fill_null(if_else(close > open, close / open), 5)", "coalesce(case when up = 1 then u end, 5)"), ("d", "cs_mad(close)", "mc"), ("e", "cs_mad_zscore(close)", "mz"), ("f", "cs_mad_zscore_resid(close, volume)", "mzr"), ("h", "cs_mad_zscore_resid_zscore(close, volume)", Z.format("mzr")),
        ("i", "cs_zscore_resid(close, volume)", RES.format("cz")), ("j", "cs_resid_zscore(close, volume)", Z.format("cr")), ("k", "cs_quantile_zscore(close)", Z.format("qc")), ("l", "cs_regression_neut(close, volume)", "cr"), ("m", "cs_resid_w(volume, close, open)", "close - wc - coalesce(wb, 0) * (open - wo)"),
        ("n", "cs_rank_if(close > open, close)", "case when up = 1 then lev / greatest(1, max(lev) over (partition by date, up))::double end"),
    ],
}

#: operators that give several values or look ahead: (operator, arguments, field or None, SQL)
DIRECT: list[tuple[str, str, tuple, str | None, str]] = [
    ("a1", "ts_MACD", ("close", 5, 10, 4), "dif", "dif"), ("a2", "ts_MACD", ("close", 5, 10, 4), "signal", "sig"), ("a3", "ts_MACD", ("close", 5, 10, 4), "hist", "dif - sig"),
    ("b1", "ts_KDJ", ("high", "low", "close", 10, 3, 3), "K", "k3"), ("b2", "ts_KDJ", ("high", "low", "close", 10, 3, 3), "D", "d3"), ("b3", "ts_KDJ", ("high", "low", "close", 10, 3, 3), "J", "3 * k3 - 2 * d3"),
    ("c1", "ts_STOCHF", ("high", "low", "close", 10, 5), "K", "rsv"), ("c2", "ts_STOCHF", ("high", "low", "close", 10, 5), "D", g("avg(rsv) over r5", 5, "rsv")),
    ("d1", "BBANDS", ("close", 10, 2, 2), "upper", g("avg(close) over r10 + 2 * stddev_pop(close) over r10", 10)), ("d2", "BBANDS", ("close", 10, 2, 2), "middle", "av10"), ("d3", "BBANDS", ("close", 10, 2, 2), "lower", g("avg(close) over r10 - 2 * stddev_pop(close) over r10", 10)),
    ("e1", "ts_AROON", ("high", "low", 4), "up", g("100 - 25.0 * (rn - arg_max(rn, high) over r5)", 5)), ("e2", "ts_AROON", ("high", "low", 4), "down", g("100 - 25.0 * (rn - arg_min(rn, low) over r5)", 5)),
    ("f1", "ts_sum_split_by", ("close", "volume", 5, 2), "high", g("list_sum(list_transform(list_reverse_sort(list({'k': volume, 'n': rn, 'v': close}) over r5)[1:2], lambda s: s.v))", 5)),
    ("f2", "ts_sum_split_by", ("close", "volume", 5, 2), "low", g("list_sum(list_transform(list_sort(list({'k': volume, 'n': rn, 'v': close}) over r5)[1:2], lambda s: s.v))", 5)),
    ("g1", "ts_REFX", ("close", 2), None, "lead(close, 2) over w"),
    ("h1", "ts_signals_to_size", (("close", ">", "open"), ("volume", ">", 100), ("close", "<", "open"), ("volume", "<", 40)), None, "list_reduce(list_prepend(0, list(16 + up + 2 * (volume > 100)::int + 4 * bear + 8 * (volume < 40)::int) over cum), lambda s, v: case when (v - 16) % 2 = 1 and ((v - 16) // 2) % 2 = 0 then 1 when ((v - 16) // 4) % 2 = 1 and ((v - 16) // 8) % 2 = 0 then -1 when (s > 0 and ((v - 16) // 2) % 2 = 1) or (s < 0 and (v - 16) // 8 = 1) then 0 else s end)"),
]


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.monthly(spark, sf_dir).join(panels.attributes(spark, sf_dir), "code")


def _query(bundle: str):
    items = BUNDLES[bundle]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        names = [n for n, _, _ in items]
        out = formula.compute(_panel(spark, sf_dir), "\n".join(f"{n} = {f}" for n, f, _ in items), names)
        return out.select("code", "date", *[F.round(F.col(n) * NUDGE, 6).alias(n) for n in names])

    run.__name__ = bundle
    return run


def _sql(cols: list[tuple[str, str]]) -> str:
    made = ", ".join(f"round(({e})::double * {NUDGE!r}::double, 6) as {n}" for n, e in cols)
    return f"with {panels.MONTHLY}, {panels.ATTR}, {HELPERS}, {_Y} select code, date, {made} from z5 {MORE_WINDOWS}"


def op_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operators with several values, or ones that formulas refuse, called on the panel."""
    ctx = StagedContext("code", "date")
    arg = lambda a: F.col(a) if isinstance(a, str) else (F.col(a[0]) > (F.col(a[2]) if isinstance(a[2], str) else a[2]) if a[1] == ">" else F.col(a[0]) < (F.col(a[2]) if isinstance(a[2], str) else a[2])).cast("int") if isinstance(a, tuple) else a
    made = {}
    for n, op, args, part, _ in DIRECT:
        c = OPS[op].fn(ctx, *map(arg, args))
        made[n] = c[part] if part else c
    df = run_stages(_panel(spark, sf_dir), ctx)
    return df.select("code", "date", *[F.round(dbl(c) * NUDGE, 6).alias(n) for n, c in made.items()])


def op_fromopen(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return formula.compute(e, "a = FROMOPEN(ts)\nb = FROMOPEN_1(ts, 3)", ["a", "b"], code="user_id", date="event_id").select("event_id", "a", "b")


_M = "(hour(ts) * 60 + minute(ts))"
FROMOPEN = f"select event_id, s::double as a, (s + 3)::double as b from (select event_id, greatest(0, least({_M} - 570, 120)) + greatest(0, least({_M} - 780, 120)) as s from events)"


def op_cs_rank_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of signals in which values a few last bits apart tie; whole signal_panel, the latest row of an item."""
    t = table(spark, sf_dir, "signal_panel")
    best = t.groupBy("factor", "date", "code").agg(F.max(F.struct("loaded_at", "row_id", "signal")).alias("b")).select("code", F.concat_ws("|", "factor", "date").alias("section"), F.col("b.signal").alias("signal"))
    return formula.compute(best, "level = cs_rank(signal, False)", ["level"], code="code", date="section")


RANK = """with v as (select code, concat_ws('|', factor, date::varchar) as section, case when isfinite(signal) then signal end as x, row_number() over (partition by factor, date, code order by loaded_at desc, row_id desc) as k from signal_panel),
a as (select code, section, x, greatest(abs(x), 2.3e-308) as m from v where k = 1),
p as (select code, section, x, lag(x) over (partition by section, x is null order by x) as q from a),
s as (select *, floor(log2(greatest(abs(q), 2.3e-308))) as e from p),
n as (select *, x - q <= 4 * greatest(pow(2.0, case when pow(2.0, e) > abs(q) then e - 1 when pow(2.0, e) <= abs(q) / 2 then e + 1 else e end - 52), 4.9e-324) as near from s)
select code, section, case when x is not null then (sum(case when near then 0 else 1 end) over (partition by section, x is null order by x) - 1)::double end as level from n"""

QUERIES = {b: _query(b) for b in BUNDLES} | {"op_direct": op_direct, "op_fromopen": op_fromopen, "op_cs_rank_near": op_cs_rank_near}
ORACLE = {b: _sql([(n, e) for n, _, e in items]) for b, items in BUNDLES.items()} | {"op_direct": _sql([(n, e) for n, _, _, _, e in DIRECT]), "op_fromopen": FROMOPEN, "op_cs_rank_near": RANK}
