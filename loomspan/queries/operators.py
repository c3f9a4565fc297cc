"""Queries of the formula operators: bundles of formulas on the monthly panel, each with its SQL expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.plans import formula
from loomspan.queries import panels

#: Prices are cents over small integers, often exactly half-way at six digits, where engines round either way:
#: results are compared a billionth part off, alike on both sides.
NUDGE = 1.000000001
WINDOWS = """window w as (partition by code order by date), r2 as (partition by code order by date rows between 1 preceding and current row),
r5 as (partition by code order by date rows between 4 preceding and current row), r10 as (partition by code order by date rows between 9 preceding and current row),
r20 as (partition by code order by date rows between 19 preceding and current row), r14 as (partition by code order by date rows between 13 preceding and current row),
cum as (partition by code order by date rows unbounded preceding), cs as (partition by date), gp as (partition by date, industry)"""
HELPERS = """x0 as (select pm.*, industry, total_mv, lag(close) over (partition by code order by date) as pc, lag(high) over (partition by code order by date) as ph, lag(low) over (partition by code order by date) as pl, lag(volume) over (partition by code order by date) as pv,
lag(open) over (partition by code order by date) as po, lag((high + low + close) / 3) over (partition by code order by date) as ptp, lag((high + low) / 2) over (partition by code order by date) as pmid,
row_number() over (partition by code order by date) as rn, (high + low + close) / 3 as tp from pm join att using (code)),
x as (select *, close - pc as d1, close / pc - 1 as ret, greatest(high - low, abs(high - pc), abs(low - pc)) as tr, avg(close) over (partition by date) as m_close, case when close > open then 1 else 0 end as up from x0)"""


def g(e: str, d: int, x: str = "close") -> str:
    return f"case when count({x}) over r{d} = {d} then {e} end"


def ema(x: str, a: str) -> str:
    """Recursive smoothing in SQL: a fold over the list of all values so far."""
    return f"list_reduce(list({x}) filter (where {x} is not null) over cum, lambda s, v: s + ({a}) * (v - s))"


BUNDLES: dict[str, list[tuple[str, str, str]]] = {
    "op_el_math": [
        ("a", "abs(close - open)", "abs(close - open)"), ("b", "log(close)", "ln(close)"), ("c", "sqrt(volume)", "sqrt(volume)"), ("d", "sign(close - open)", "sign(close - open)"),
        ("e", "log10(amount)", "log10(amount)"), ("f", "exp(close / 10000)", "exp(close / 10000)"), ("g", "floor(close / 7)", "floor(close / 7)"), ("h", "CEILING(close / 7)", "ceil(close / 7)"),
        ("i", "mod(close, 7)", "close - floor(close / 7) * 7"), ("j", "signed_power(close - open, 0.5)", "sign(close - open) * pow(abs(close - open), 0.5)"), ("k", "FRACPART(close)", "close - floor(close)"),
        ("l", "s_log_1p(close - open)", "sign(close - open) * ln(1 + abs(close - open))"), ("m", "sigmoid((close - open) / 1000)", "1 / (1 + exp(-(close - open) / 1000))"), ("n", "cbrt(volume)", "cbrt(volume)"),
    ],
    "op_el_rowwise": [
        ("a", "max_(open, close)", "greatest(open, close)"), ("b", "min_(open, close, low)", "least(open, close, low)"), ("c", "mean(open, high, low, close)", "(open + high + low + close) / 4"),
        ("d", "AVGPRICE(open, high, low, close)", "(open + high + low + close) / 4"), ("e", "TYPPRICE(high, low, close)", "(high + low + close) / 3"), ("f", "WCLPRICE(high, low, close)", "(high + low + 2 * close) / 4"),
        ("g", "clamp(close, 1200, 1500)", "least(greatest(close, 1200), 1500)"), ("h", "if_else(close > open, high, low)", "case when close > open then high else low end"), ("i", "cut(close, 1200, 1500)", "case when close <= 1200 then 0 when close <= 1500 then 1 else 2 end"),
        ("j", "close if close > open else open", "case when close > open then close else open end"), ("k", "(close - open).abs()", "abs(close - open)"), ("l", "add(open, close, 1)", "open + close + 1"), ("m", "softsign(close - open)", "(close - open) / (1 + abs(close - open))"),
    ],
    "op_ts_lag": [
        ("a", "ts_delay(close, 2)", "lag(close, 2) over w"), ("b", "close[3]", "lag(close, 3) over w"), ("c", "ts_delta(close, 1)", "close - lag(close, 1) over w"), ("d", "ts_returns(close, 2)", "close / lag(close, 2) over w - 1"),
        ("e", "ts_ROC(close, 5)", "(close / lag(close, 5) over w - 1) * 100"), ("f", "ts_ROCR100(close, 5)", "close / lag(close, 5) over w * 100"), ("g", "ts_log_diff(close, 1)", "ln(close) - ln(lag(close) over w)"), ("h", "returns(close)", "close / pc - 1"),
        ("i", "ts_weighted_decay(close, 0.3)", "0.7 * pc + 0.3 * close"),
    ],
    "op_ts_rolling": [
        ("a", "ts_mean(close, 5)", g("avg(close) over r5", 5)), ("b", "ts_sum(volume, 5)", g("sum(volume) over r5", 5)), ("c", "ts_max(high, 5)", g("max(high) over r5", 5)), ("d", "ts_min(low, 10)", g("min(low) over r10", 10)),
        ("e", "ts_std_dev(close, 5)", g("stddev_samp(close) over r5", 5)), ("f", "ts_VARP(close / open, 10)", g("var_pop(close / open) over r10", 10)), ("g", "ts_median(close, 5)", g("quantile_cont(close, 0.5) over r5", 5)), ("h", "ts_percentage(close, 10, 0.25)", g("quantile_cont(close, 0.25) over r10", 10)),
        ("i", "ts_zscore(close, 10)", g("(close - avg(close) over r10) / nullif(stddev_samp(close) over r10, 0)", 10)), ("j", "ts_ir(close, 10)", g("avg(close) over r10 / stddev_samp(close) over r10", 10)), ("k", "ts_max_diff(close, 5)", g("close - max(close) over r5", 5)),
        ("l", "ts_scale(close, 10)", g("(close - min(close) over r10) / (max(close) over r10 - min(close) over r10)", 10)), ("m", "adv20(volume)", g("avg(volume) over r20", 20)), ("n", "ts_product(1 + returns(close) / 10, 5)", "case when count(pc) over r5 = 5 then product(1 + ret / 10) over r5 end"),
        ("o", "ts_l2_norm(close, 5)", g("sqrt(sum(close * close) over r5)", 5)),
    ],
    "op_ts_pair": [
        ("a", "ts_corr(close, volume, 10)", g("corr(close, volume) over r10", 10)), ("b", "ts_covariance(close, volume, 10)", g("covar_samp(close, volume) over r10", 10)), ("c", "ts_regression_slope(close, volume, 10)", g("covar_pop(close, volume) over r10 / var_pop(volume) over r10", 10)),
        ("d", "ts_regression_resid(close, volume, 10)", g("close - (avg(close) over r10 + covar_pop(close, volume) over r10 / var_pop(volume) over r10 * (volume - avg(volume) over r10))", 10)),
        ("e", "ts_weighted_mean(close, volume, 5)", g("sum(close * volume) over r5 / sum(volume) over r5", 5)),
    ],
    "op_ts_cumulative": [
        ("a", "ts_cum_sum(volume)", "sum(volume) over cum"), ("b", "ts_cum_max(close)", "max(close) over cum"), ("c", "ts_cum_min(close)", "min(close) over cum"), ("d", "ts_cum_count(close)", "count(close) over cum"), ("e", "vwap(high, low, close, volume)", "sum(tp * volume) over cum / sum(volume) over cum"),
        ("f", "ts_OBV(close, volume)", "sum(coalesce(sign(d1), 0) * volume) over cum"), ("g", "ts_VALUEWHEN(close > open, close)", "last_value(case when up = 1 then close end ignore nulls) over cum"),
    ],
    "op_ts_conditions": [
        ("a", "ts_count(close > open, 5)", "case when count(*) over r5 = 5 then sum(up) over r5 end"), ("b", "ts_ALL(close > open, 2)", "case when count(*) over r2 = 2 then (sum(up) over r2 = 2)::int end"), ("c", "ts_EXIST(close > open, 5)", "case when count(*) over r5 = 5 then (sum(up) over r5 > 0)::int end"),
        ("d", "ts_BARSLAST(close > open)", "rn - max(case when up = 1 then rn end) over cum"), ("e", "ts_BARSLASTCOUNT(close > open)", "rn - max(case when up = 0 then rn else 0 end) over cum"), ("f", "ts_SUMIF(close > open, volume, 5)", "sum(case when up = 1 then volume else 0 end) over r5"),
        ("g", "ts_CROSS(close, open)", "(close > open and lag(close) over w <= lag(open) over w)::int"), ("h", "ts_UPNDAY(close, 2)", "case when count(*) over r2 = 2 then (sum(case when d1 > 0 then 1 else 0 end) over r2 = 2)::int end"),
    ],
    "op_ts_window_list": [
        ("a", "ts_rank(close, 5)", g("(len(list_filter(list(close) over r5, lambda v: v < close)) + (len(list_filter(list(close) over r5, lambda v: v = close)) - 1) / 2.0) / 4", 5)), ("b", "ts_decay_linear(close, 3)", "(3 * close + 2 * lag(close) over w + lag(close, 2) over w) / 6"), ("c", "ts_AVEDEV(close, 5)", g("list_avg(list_transform(list(close) over r5, lambda v: abs(v - list_avg(list(close) over r5))))", 5)),
    ],
    "op_ts_ema": [
        ("a", "ts_EMA(close, 5)", ema("close", "2.0 / 6")), ("b", "ts_RMA(close, 7)", ema("close", "1.0 / 7")), ("c", "ts_SMA_CN(close, 6, 2)", ema("close", "2.0 / 6")), ("d", "ts_DMA(volume, 0.25)", ema("volume", "0.25")), ("e", "ts_APO(close, 5, 10)", f"{ema('close', '2.0 / 6')} - {ema('close', '2.0 / 11')}"),
        ("f", "ts_ATR(high, low, close, 5)", f"case when tr is not null then {ema('tr', '0.2')} end"),
    ],
    "op_ta": [
        ("a", "ts_WILLR(high, low, close, 10)", g("(max(high) over r10 - close) / (max(high) over r10 - min(low) over r10) * -100", 10)), ("b", "ts_RSV(high, low, close, 10)", g("(close - min(low) over r10) / (max(high) over r10 - min(low) over r10) * 100", 10)), ("c", "ts_BIAS(close, 5)", g("(close / avg(close) over r5 - 1) * 100", 5)),
        ("d", "ts_BOLL(close, 20, 2)", g("avg(close) over r20 + 2 * stddev_samp(close) over r20", 20)), ("e", "ts_PSY(close, 10)", "case when count(*) over r10 = 10 then sum(case when d1 > 0 then 1 else 0 end) over r10 * 10.0 end"), ("f", "ts_TR(high, low, close)", "case when pc is null then high - low else tr end"), ("g", "ts_MIDPRICE(high, low, 10) / close", g("(max(high) over r10 + min(low) over r10) / 2 / close", 10)),
        ("h", "ts_RSI(close, 6)", f"case when d1 is not null then 100 * {ema('greatest(d1, 0)', '1.0 / 6').replace('filter (where greatest(d1, 0) is not null)', 'filter (where d1 is not null)')} / ({ema('greatest(d1, 0)', '1.0 / 6').replace('filter (where greatest(d1, 0) is not null)', 'filter (where d1 is not null)')} + {ema('greatest(-d1, 0)', '1.0 / 6').replace('filter (where greatest(-d1, 0) is not null)', 'filter (where d1 is not null)')}) end"),
    ],
    "op_cs_moments": [
        ("a", "cs_zscore(close)", "(close - avg(close) over cs) / nullif(stddev_samp(close) over cs, 0)"), ("b", "cs_demean(close)", "close - avg(close) over cs"), ("c", "cs_scale(close - open)", "(close - open) / nullif(sum(abs(close - open)) over cs, 0)"), ("d", "cs_minmax(close)", "(close - min(close) over cs) / (max(close) over cs - min(close) over cs)"),
        ("e", "cs_3sigma(close, 1)", "least(greatest(close, avg(close) over cs - stddev_samp(close) over cs), avg(close) over cs + stddev_samp(close) over cs)"), ("f", "cs_truncate(volume, 0.01)", "least(volume, 0.01 * sum(volume) over cs)"), ("g", "cs_one_side(close)", "close - min(close) over cs"),
    ],
    "op_cs_quantiles": [
        ("a", "cs_quantile(close, 0.1, 0.9)", "least(greatest(close, quantile_cont(close, 0.1) over cs), quantile_cont(close, 0.9) over cs)"), ("b", "cs_robust_scale(close)", "(close - quantile_cont(close, 0.5) over cs) / (quantile_cont(close, 0.75) over cs - quantile_cont(close, 0.25) over cs)"),
    ],
    "op_cs_rank": [
        ("a", "cs_rank(volume, True, 0)", "(dense_rank() over (partition by date order by volume) - 1) / greatest(1, (select count(distinct volume) - 1 from x y where y.date = x.date))"), ("b", "gp_rank(industry, close)", "rank() over (partition by date, industry order by close) + (count(*) over (partition by date, industry, close) - 1) / 2.0"), ("c", "gp_mean(industry, close)", "avg(close) over gp"),
        ("d", "cs_top_bottom(close, 3)", "case when row_number() over (partition by date order by close desc, code) <= 3 then 1 when row_number() over (partition by date order by close, code) <= 3 then -1 else 0 end"),
    ],
    "op_cs_regression": [
        ("a", "cs_resid(close, volume)", "close - avg(close) over cs - coalesce(covar_samp(close, volume) over cs / nullif(var_samp(volume) over cs, 0), 0) * (volume - avg(volume) over cs)"), ("b", "cs_regression_proj(close, volume)", "avg(close) over cs + coalesce(covar_samp(close, volume) over cs / nullif(var_samp(volume) over cs, 0), 0) * (volume - avg(volume) over cs)"),
    ],
    "op_patterns": [
        ("a", "ts_连续N天收阳线(open, close, 2)", "case when count(*) over r2 = 2 then (sum(up) over r2 = 2)::int end"), ("b", "ts_平台整理(close, 5, 0.3)", g("(max(close) over r5 / min(close) over r5 < 1.3)::int", 5)), ("c", "ts_跳空缺口选股(high, low)", "(low > ph)::int"), ("d", "ts_持续放量(volume, 2)", "case when count(*) over r2 = 2 then (sum(case when volume > pv then 1 else 0 end) over r2 = 2)::int end"),
        ("e", "ts_低开大阳线(open, close, 0, 0.01)", "(open < pc and close / open > 1.01)::int"), ("f", "ts_单日放量(close, volume, 1.5)", "(volume > pv * 1.5 and close >= pc)::int"),
    ],
    "op_ts_shape": [
        ("a", "ts_arg_max(close, 5)", g("rn - arg_max(rn, close) over r5", 5)), ("b", "ts_arg_min(close, 5)", g("rn - arg_min(rn, close) over r5", 5)), ("c", "ts_skewness(close, 10)", g("list_avg(list_transform(list(close) over r10, lambda v: pow(v - list_avg(list(close) over r10), 3))) / pow(var_pop(close) over r10, 1.5)", 10)),
        ("d", "ts_kurtosis(close, 10)", g("list_avg(list_transform(list(close) over r10, lambda v: pow(v - list_avg(list(close) over r10), 4))) / pow(var_pop(close) over r10, 2) - 3", 10)), ("e", "ts_min_max_diff(close, 5, 0.5) / close", g("1 - 0.5 * (min(close) over r5 + max(close) over r5) / close", 5)), ("f", "ts_HOD(close, 5)", g("len(list_filter(list(close) over r5, lambda v: v > close)) + 1", 5)),
        ("g", "ts_LOD(close, 5)", g("len(list_filter(list(close) over r5, lambda v: v < close)) + 1", 5)), ("h", "ts_moment(close / open, 10, 2)", g("var_pop(close / open) over r10", 10)),
    ],
    "op_ta_volume": [
        ("a", "ts_MFI(high, low, close, volume, 10)", "case when count(*) over r10 = 10 then 100 * sum(case when tp > ptp then tp * volume else 0 end) over r10 / (sum(case when tp > ptp then tp * volume else 0 end) over r10 + sum(case when tp < ptp then tp * volume else 0 end) over r10) end"),
        ("b", "ts_VR(close, volume, 10)", "case when count(*) over r10 = 10 then (sum(case when d1 > 0 then volume else 0 end) over r10 + sum(case when d1 = 0 then volume else 0 end) over r10 / 2) / (sum(case when d1 < 0 then volume else 0 end) over r10 + sum(case when d1 = 0 then volume else 0 end) over r10 / 2) * 100 end"),
        ("c", "ts_EMV(high, low, volume, 5)", "case when count((high + low) / 2 - pmid) over r5 = 5 then avg(((high + low) / 2 - pmid) * (high - low) / volume) over r5 end"), ("d", "ts_AD(high, low, close, volume)", "sum(case when high <> low then ((close - low) - (high - close)) / (high - low) * volume else 0 end) over cum"),
        ("e", "ts_CR(high, low, 10)", "case when count(pmid) over r10 = 10 then sum(greatest(high - pmid, 0)) over r10 / sum(greatest(pmid - low, 0)) over r10 * 100 end"), ("f", "ts_BRAR_AR(open, high, low, close, 10)", g("sum(high - open) over r10 / sum(open - low) over r10 * 100", 10)),
        ("g", "ts_BBI(close, 2, 5, 10, 20) / close", g("(avg(close) over r2 + avg(close) over r5 + avg(close) over r10 + avg(close) over r20) / 4 / close", 20)), ("h", "ts_MIDPOINT(close, 10) / close", g("(max(close) over r10 + min(close) over r10) / 2 / close", 10)),
    ],
    "op_ts_events": [
        ("a", "ts_BARSSINCE(close > open)", "rn - min(case when up = 1 then rn end) over cum"), ("b", "ts_NDAY(close, open, 2)", "case when count(*) over r2 = 2 then (sum(up) over r2 = 2)::int end"), ("c", "ts_count_ge(close / open, 5, 1)", "case when count(*) over r5 = 5 then sum(case when close / open >= 1 then 1 else 0 end) over r5 end"),
        ("d", "ts_均线多头排列(close, 2, 5, 10)", f"({g('avg(close) over r2', 2)} > {g('avg(close) over r5', 5)} and {g('avg(close) over r5', 5)} > {g('avg(close) over r10', 10)})::int"), ("e", "ts_旭日初升(open, close)", "(pc < po and close > open and open > pc and close > po)::int"), ("f", "ts_N日内上涨多于下跌(close, 10)", "case when count(*) over r10 = 10 then (sum(case when d1 > 0 then 1 else 0 end) over r10 > 5)::int end"),
        ("g", "ts_fill_null(if_else(close > open, close), 3)", "last_value(case when up = 1 then close end ignore nulls) over (partition by code order by date rows between 3 preceding and current row)"),
    ],
    "op_cs_fill_bucket": [
        ("a", "cs_fill_mean(if_else(close > open, close / open))", "coalesce(case when up = 1 then close / open end, avg(case when up = 1 then close / open end) over cs)"), ("b", "cs_qcut(close, 5)", "greatest(0, least(4, floor((2 * (rank() over (partition by date order by close) + (count(*) over (partition by date, close) - 1) / 2.0) - 1) * 5 / (2.0 * count(*) over cs))))"),
        ("c", "cs_fill_max(if_else(close > open, close / open))", "coalesce(case when up = 1 then close / open end, max(case when up = 1 then close / open end) over cs)"), ("d", "cs_scale_down(volume, 0.5)", "(volume - min(volume) over cs) / (max(volume) over cs - min(volume) over cs) - 0.5"), ("e", "cs_zscore(close, 0)", "(close - avg(close) over cs) / nullif(stddev_pop(close) over cs, 0)"),
        ("f", "gp_demean(industry, volume)", "volume - avg(volume) over gp"),
    ],
    "op_macros": [
        ("a", "def f(x, n=5):\n    return ts_mean(x, n) / x\nt = f(close)\na = t", g("avg(close) over r5 / close", 5)),
        ("b", "u = close / open\nb = u - 1", "close / open - 1"),
    ],
}


def _query(bundle: str):
    items = BUNDLES[bundle]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = panels.monthly(spark, sf_dir).join(panels.attributes(spark, sf_dir), "code")
        text = "\n".join(f if "=" in f and f.split("=")[0].strip().isidentifier() or f.startswith("def ") else f"{n} = {f}" for n, f, _ in items)
        names = [n for n, _, _ in items]
        out = formula.compute(df, text, names)
        return out.select("code", "date", *[F.round(F.col(n) * NUDGE, 6).alias(n) for n in names])

    run.__name__ = bundle
    return run


def _sql(bundle: str) -> str:
    cols = ", ".join(f"round(({e})::double * {NUDGE!r}::double, 6) as {n}" for n, _, e in BUNDLES[bundle])
    return f"with {panels.MONTHLY}, {panels.ATTR}, {HELPERS} select code, date, {cols} from x {WINDOWS}"


def op_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = panels.table(spark, sf_dir, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    calls = {"a": "vec_avg(v)", "b": "vec_max(v)", "c": "vec_min(v)", "d": "vec_range(v)", "e": "vec_count(v)", "f": "vec_sum(v)", "g": "vec_l2_norm(v)", "h": "vec_norm(v)", "i": "vec_choose(v, 2)", "j": "vec_median(v)", "k": "vec_percentage(v, 0.25)", "l": "vec_stddev(v)", "m": "vec_ir(v)", "n": "vec_powersum(v, 4)", "o": "vec_kurtosis(v)"}
    out = formula.compute(e, "\n".join(f"{n} = {f}" for n, f in calls.items()), list(calls), code="vec_id", date="label")
    return out.select("vec_id", *[F.round(F.col(n) * NUDGE, 6).alias(n) for n in calls])


VEC = f"""with e as (select vec_id, embedding::double[] as v from embeddings), m as (select *, list_avg(v) as mu from e)
select vec_id, {', '.join(f'round(({x})::double * {NUDGE!r}::double, 6) as {n}' for n, x in {'a': 'mu', 'b': 'list_max(v)', 'c': 'list_min(v)', 'd': 'list_max(v) - list_min(v)', 'e': 'len(v)', 'f': 'list_sum(v)', 'g': 'sqrt(list_sum(list_transform(v, lambda x: x * x)))', 'h': 'list_sum(list_transform(v, lambda x: abs(x)))', 'i': 'v[3]', 'j': 'list_median(v)', 'k': "list_aggregate(v, 'quantile_cont', 0.25)", 'l': 'list_stddev_samp(v)', 'm': 'mu / list_stddev_samp(v)', 'n': 'list_sum(list_transform(v, lambda x: pow(x, 4)))', 'o': 'list_avg(list_transform(v, lambda x: pow(x - mu, 4))) / pow(list_var_pop(v), 2) - 3'}.items())} from m"""
QUERIES = {b: _query(b) for b in BUNDLES}
QUERIES["op_vec"] = op_vec
ORACLE = {b: _sql(b) for b in BUNDLES} | {"op_vec": VEC}
