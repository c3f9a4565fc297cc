"""Queries of the panel, evaluation, processing, portfolio, rule, intraday, order-book and streaming operators."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import evaluate, orderbook, panel, portfolio, process, rules
from loomspan.plans import formula
from loomspan.queries import panels
from loomspan.queries.common import table
from loomspan.queries.panels import ATTR, DAILY, INTRADAY, MONTHLY
from loomspan.streaming import streams

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def r6(df: DataFrame, *skip: str, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes])


def _pm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.monthly(spark, sf_dir).join(panels.attributes(spark, sf_dir), "code")


SIGNAL = "signal = ts_mean(close, 3) / ts_delay(close, 1) - 1"
SIGNAL_SQL = f"""{MONTHLY}, {ATTR}, s0 as (select pm.*, industry, total_mv, case when count(close) over (partition by code order by date rows between 2 preceding and current row) = 3 then avg(close) over (partition by code order by date rows between 2 preceding and current row) end / lag(close) over (partition by code order by date) - 1 as signal,
lead(close * adj_factor, 1) over (partition by code order by date) / (close * adj_factor) - 1 as f1, lead(close * adj_factor, 5) over (partition by code order by date) / (close * adj_factor) - 1 as f5 from pm join att using (code))"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _pm(spark, sf_dir)
    s = formula.compute(df, SIGNAL, keep=("industry", "total_mv", "close", "open", "adj_factor", "volume"))
    return panel.forward_returns(s, F.col("close") * F.col("adj_factor"), (1, 5))


RANKS = "rank() over (partition by date order by {0}) + (count(*) over (partition by date, {0}) - 1) / 2.0"
VALID = f"v as (select * from s0 where signal is not null and f1 is not null), rk as (select *, {RANKS.format('signal')} as rs, {RANKS.format('f1')} as rf, count(*) over (partition by date) as n from v)"
IC_SQL = f"{SIGNAL_SQL}, {VALID}, ic as (select date, count(*) as n, corr(rs, rf) as rank_ic, corr(signal, f1) as ic from rk group by date having count(*) >= 3)"


@query(f"with {IC_SQL} select date, n, round(rank_ic, 6) as rank_ic, round(ic, 6) as ic from ic")
def eval_ic_series(spark, sf_dir):
    return r6(evaluate.ic_series(_scored(spark, sf_dir), "signal", "forward_return_1d"))


@query(f"""with {IC_SQL}, k as (select *, row_number() over (order by date desc) as k from ic where rank_ic is not null)
select count(*) as n_dates, round(avg(rank_ic), 6) as ic_mean, round(stddev_samp(rank_ic), 6) as ic_std, round(avg(rank_ic) filter (where k <= 26), 6) as ic_recent, round(avg((rank_ic > 0)::int), 6) as positive_share,
round(avg(rank_ic) / stddev_samp(rank_ic), 6) as ic_ir, round(avg(rank_ic) / stddev_samp(rank_ic) * sqrt(count(*)), 6) as ic_t from k""")
def eval_ic_summary(spark, sf_dir):
    return r6(evaluate.ic_summary(evaluate.ic_series(_scored(spark, sf_dir), "signal", "forward_return_1d")))


@query(f"""with {SIGNAL_SQL}, h as (select 1 as horizon, date, signal, f1 as f from s0 union all select 5, date, signal, f5 from s0), v as (select * from h where signal is not null and f is not null),
rk as (select *, rank() over (partition by horizon, date order by signal) + (count(*) over (partition by horizon, date, signal) - 1) / 2.0 as rs, rank() over (partition by horizon, date order by f) + (count(*) over (partition by horizon, date, f) - 1) / 2.0 as rf from v),
ic as (select horizon, date, corr(rs, rf) as ic from rk group by 1, 2 having count(*) >= 3)
select horizon, round(avg(ic), 6) as ic_mean, round(stddev_samp(ic), 6) as ic_std, count(ic) as n_dates from ic group by 1""")
def eval_ic_decay(spark, sf_dir):
    return r6(evaluate.ic_decay(_scored(spark, sf_dir), "signal", (1, 5)))


BUCKET_SQL = f"{SIGNAL_SQL}, {VALID}, bk as (select *, greatest(0, least(4, floor((2 * rs - 1) * 5 / (2.0 * n))))::int as bucket from rk)"


@query(f"with {BUCKET_SQL} select date, bucket, round(avg(f1), 6) as ret, count(*) as n from bk group by 1, 2")
def eval_bucket_returns(spark, sf_dir):
    return r6(evaluate.bucket_returns(_scored(spark, sf_dir), "signal", "forward_return_1d", 5))


@query(f"with {BUCKET_SQL}, b as (select date, bucket, avg(f1) as ret from bk group by 1, 2) select date, round(max(ret) filter (where bucket = 4) - max(ret) filter (where bucket = 0), 6) as spread from b group by 1")
def eval_spread(spark, sf_dir):
    return r6(evaluate.spread(evaluate.bucket_returns(_scored(spark, sf_dir), "signal", "forward_return_1d", 5), 5))


@query(f"""with {BUCKET_SQL}, wt as (select date, bucket, code, f1, 1.0 / count(*) over (partition by date, bucket) as w from bk), di as (select date, row_number() over (order by date) as i from (select distinct date from bk)),
x as (select bucket, code, i, w, f1, date from wt join di using (date)), m as (select bucket, code, i, w as a, 0.0 as b from x union all select bucket, code, i + 1, 0.0, w from x),
t as (select bucket, i, sum(ch) as ch from (select bucket, code, i, abs(sum(a) - sum(b)) as ch from m group by 1, 2, 3) group by 1, 2),
r as (select date, bucket, i, avg(f1) as ret from x group by 1, 2, 3), o as (select r.*, case when r.i = 1 then 1.0 else ch / 2 end as turnover from r join t using (bucket, i))
select date, bucket, round(ret, 6) as ret, round(turnover, 6) as turnover, round(ret - turnover * 0.001, 6) as net, round(ln(product(1 + ret - turnover * 0.001) over (partition by bucket order by date rows unbounded preceding)), 6) as log_nav from o""")
def eval_layered(spark, sf_dir):
    return r6(evaluate.layered(_scored(spark, sf_dir), "signal", "forward_return_1d", 5, 0.001).withColumn("log_nav", F.log("nav")).drop("nav"))


@query(f"with {SIGNAL_SQL} select date, count(*) as n, count(signal) as n_valid, round(1 - count(signal) / count(*), 6) as invalid_share, 1 - count(signal) / count(*) >= 0.99 as dead from s0 group by 1")
def eval_coverage(spark, sf_dir):
    return r6(evaluate.coverage(_scored(spark, sf_dir)))


@query(f"""with {SIGNAL_SQL}, q as (select code, date, date_trunc('quarter', date)::date as period, rank() over (partition by date order by signal) + (count(*) over (partition by date, signal) - 1) / 2.0 as r, count(*) over (partition by date) as n from s0 where signal is not null),
b as (select code, date, period, greatest(0, least(4, floor((2 * r - 1) * 5 / (2.0 * n)))) as bucket from q),
l as (select code, period, arg_max(bucket, date) as bucket from b group by 1, 2), i as (select period, row_number() over (order by period) as i from (select distinct period from l)),
c as (select period, i - lag(i) over w as step, bucket, lag(bucket) over w as before from l join i using (period) window w as (partition by code order by i))
select period, round(avg((bucket <> before)::int), 6) as turnover, count(*) as n from c where step = 1 group by 1""")
def eval_bucket_turnover(spark, sf_dir):
    return r6(evaluate.bucket_turnover(_scored(spark, sf_dir), groups=5, period="quarter"))


@query(f"""with {SIGNAL_SQL}, v as (select *, close / open - 1 as other from s0), w as (select * from v where signal is not null and other is not null),
rk as (select date, rank() over (partition by date order by signal) + (count(*) over (partition by date, signal) - 1) / 2.0 as a, rank() over (partition by date order by other) + (count(*) over (partition by date, other) - 1) / 2.0 as b, signal, other from w),
c as (select date, corr(a, b) as r, corr(signal, other) as p from rk group by 1 having count(*) >= 6)
select 'signal' as a, 'other' as b, round(avg(r), 6) as rank_corr, round(avg(p), 6) as corr, count(*) as n_dates from c""")
def analysis_factor_correlation(spark, sf_dir):
    d = _scored(spark, sf_dir).withColumn("other", F.col("close") / F.col("open") - 1)
    return r6(evaluate.factor_correlation(d, ["signal", "other"], least=5))


@query(f"""with {SIGNAL_SQL}, v as (select *, case when signal is not null then volume end as x from s0),
q as (select *, signal - avg(signal) over cs - coalesce(covar_samp(signal, x) over cs / nullif(var_samp(x) over cs, 0), 0) * (x - avg(x) over cs) as res from v window cs as (partition by date)),
w as (select * from q where res is not null and f1 is not null), rk as (select date, rank() over (partition by date order by res) + (count(*) over (partition by date, res) - 1) / 2.0 as a, {RANKS.format('f1')} as b from w),
r2 as (select date, 1 - var_pop(res) / nullif(var_pop(signal), 0) as r2 from q where res is not null group by 1)
select date, round(corr(a, b), 6) as residual_ic, round(any_value(r2), 6) as r2 from rk join r2 using (date) group by 1 having count(*) >= 3""")
def analysis_residual_ic(spark, sf_dir):
    return r6(evaluate.residual_ic(_scored(spark, sf_dir), "signal", ["volume"], "forward_return_1d").select("date", "residual_ic", "r2"))


@query(f"""with {SIGNAL_SQL}, r as (select date, code, signal, close / open - 1 as other from s0),
a as (select date, code, (rank() over (partition by date order by signal) + (count(*) over (partition by date, signal) - 1) / 2.0) / count(*) over (partition by date) as x from r where signal is not null),
b as (select date, code, (rank() over (partition by date order by other) + (count(*) over (partition by date, other) - 1) / 2.0) / count(*) over (partition by date) as y from r where other is not null)
select date, code, round(0.5 * x + 0.5 * y, 6) as signal from a join b using (date, code)""")
def analysis_composite(spark, sf_dir):
    d = _scored(spark, sf_dir)
    other = formula.compute(_pm(spark, sf_dir), "signal = close / open - 1")
    return r6(evaluate.composite({"a": d.select("date", "code", "signal"), "b": other}, rank=True))


@query(f"""with {SIGNAL_SQL}, o as (select *, row_number() over (partition by date, signal is null order by signal) as k, count(signal) over (partition by date) as n from s0), q as (select *, max(case when signal is not null and k = floor((n - 1) * ((1 - 0.9::double) / 2) + 0.5) + 1 then signal end) over cs as lo, max(case when signal is not null and k = floor((n - 1) * ((1 + 0.9::double) / 2) + 0.5) + 1 then signal end) over cs as hi from o window cs as (partition by date)), c as (select *, least(greatest(signal, lo), hi) as x from q),
z as (select *, (x - avg(x) over cs) / nullif(stddev_samp(x) over cs, 0) as y from c window cs as (partition by date)) select code, date, round(y - avg(y) over (partition by date, industry), 6) as signal from z""")
def process_winsorize_zscore_industry(spark, sf_dir):
    return r6(process.run_chain(_scored(spark, sf_dir), ["winsorize(quantile=0.9)", "zscore", "neutralize(by=industry)"]).select("code", "date", "signal"))


@query(f"with {SIGNAL_SQL} select code, date, round(case when signal is not null then (rank() over (partition by date, signal is null order by signal) + (count(*) over (partition by date, signal) - 1) / 2.0) / (count(signal) over (partition by date) + 1) end, 6) as signal from s0")
def process_csranknorm(spark, sf_dir):
    return r6(process.run_chain(_scored(spark, sf_dir), ["csranknorm"]).select("code", "date", "signal"))


@query(f"""with {SIGNAL_SQL}, m as (select *, signal - quantile_cont(signal, 0.5) over (partition by date) as dev from s0), d as (select *, quantile_cont(abs(dev), 0.5) over (partition by date) * 1.4826 as mad from m),
z as (select *, case when mad > 0 then dev / mad end as z from d) select code, date, round(coalesce(case when z < -3 then -3 when z > 3 then 3 else z end, 0), 6) as signal from z""")
def process_robust_clip_fill(spark, sf_dir):
    return r6(process.run_chain(_scored(spark, sf_dir), ["robustzscore", "clip(-3, 3)", "fillna(value, value: 0)"]).select("code", "date", "signal"))


@query(f"""with {SIGNAL_SQL}, m as (select *, case when total_mv > 0 then total_mv end as mv from s0), d as (select *, case when mv is not null then floor((row_number() over (partition by date, mv is null order by mv, code) - 1) * 10 / count(*) over (partition by date, mv is null)) end as dec from m)
select code, date, round(case when dec is not null then signal - avg(signal) over (partition by date, dec) end, 6) as signal from d""")
def process_neutralize_size(spark, sf_dir):
    return r6(process.run_chain(_scored(spark, sf_dir), ["neutralize(by=size)"]).select("code", "date", "signal"))


@query(f"""with {DAILY}, l as (select *, last_value(adj_factor ignore nulls) over (partition by code order by date rows between unbounded preceding and unbounded following) as la from pm)
select code, date, round(ln(close * adj_factor / la), 6) as qfq, round(ln(close * adj_factor), 6) as hfq from l""")
def panel_price_views(spark, sf_dir):
    d = panels.daily(spark, sf_dir)
    q = panel.view_prices(d, "qfq", cols=("close",)).select("code", "date", F.log("close").alias("qfq"))
    h = panel.view_prices(d, "hfq", cols=("close",)).select("code", "date", F.log("close").alias("hfq"))
    return r6(q.join(h, ["code", "date"]))


@query(f"""with {DAILY}, b as (select code, arg_max(adj_factor, date) filter (where adj_factor is not null) as base from pm where date <= date '1998-06-30' group by 1) select code, date, round(ln(close * adj_factor / base), 6) as close from pm left join b using (code)""")
def panel_price_view_pit(spark, sf_dir):
    return r6(panel.view_prices(panels.daily(spark, sf_dir), "pit_qfq", "1998-06-30", cols=("close",)).select("code", "date", F.log("close").alias("close")))


@query(f"with {DAILY}, s as (select code, min(date) as first, max(date) as last from pm group by 1), c as (select distinct date from pm) select s.code, c.date, round(ln(p.close), 6) as close, round(ln(last_value(p.close ignore nulls) over (partition by s.code order by c.date rows unbounded preceding)), 6) as filled from s join c on c.date between s.first and s.last left join pm p on p.code = s.code and p.date = c.date")
def panel_skeleton_fill(spark, sf_dir):
    d = panels.daily(spark, sf_dir)
    spans = d.groupBy("code").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    sk = panel.skeleton(d.select("date").distinct(), spans).join(d.select("code", "date", "close"), ["code", "date"], "left").withColumn("filled", F.col("close"))
    return r6(panel.forward_fill(sk, ["filled"]).withColumns({c: F.log(c) for c in ("close", "filled")}))


@query(f"with {DAILY} select code, arg_max(close, date) filter (where close is not null and date < date '1998-01-01') as close, arg_max(volume, date) filter (where date < date '1998-01-01') as volume from pm where date < date '1998-01-01' group by 1")
def panel_fill_state(spark, sf_dir):
    return panel.fill_state(panels.daily(spark, sf_dir), "1998-01-01", ["close", "volume"])


@query(f"with {DAILY}, r as (select code, date, row_number() over (partition by code order by date desc) as k from pm where date < date '1998-01-01') select code, min(date) as tail_date from r where k <= 20 group by 1")
def panel_tail_dates(spark, sf_dir):
    return panel.tail_dates(panels.daily(spark, sf_dir), "1998-01-01", 20)


@query(f"with {DAILY}, d as (select *, isoyear(date) as y, weekofyear(date) as k from pm), e as (select *, max(date) over (partition by y, k) as last, max(date) over (partition by code, y, k) as mine from d) select code, last as date, round(ln(close), 6) as close from e where date = mine")
def panel_week_end(spark, sf_dir):
    return r6(panel.week_end(panels.daily(spark, sf_dir)).select("code", "date", F.log("close").alias("close")))


@query(f"with {DAILY}, k as (select date, row_number() over (order by date) - 1 as i from (select distinct date from pm)) select code, pm.date, round(ln(close), 6) as close from pm join k using (date) where i % 5 = 0")
def panel_every_kth_date(spark, sf_dir):
    return r6(panel.every_kth_date(panels.daily(spark, sf_dir), 5).select("code", "date", F.log("close").alias("close")))


@query("""select i.ts_code as code, c.cal_date as date, (c.cal_date >= i.list_date and (i.delist_date is null or c.cal_date < i.delist_date)) and date_diff('day', i.list_date, c.cal_date) >= 60 and right(i.ts_code, 2) <> 'BJ' as in_universe,
c.cal_date >= i.list_date and (i.delist_date is null or c.cal_date < i.delist_date) as is_listed from instrument_basic i join trade_cal c on c.is_open = 1 and c.cal_date >= date '2025-01-06' and (i.delist_date is null or c.cal_date <= i.delist_date)""")
def panel_membership(spark, sf_dir):
    inst, cal = table(spark, sf_dir, "instrument_basic"), panel.calendar(table(spark, sf_dir, "trade_cal"), "cal_date", "is_open")
    codes = inst.select(F.col("ts_code").alias("code"), F.lit("2025-01-06").cast("date").alias("first"), F.col("delist_date").alias("last"))
    listing = inst.select(F.col("ts_code").alias("code"), "list_date", "delist_date")
    return panel.membership(panel.skeleton(cal, codes), listing, min_list_days=60, exclude_bj=True).select("code", "date", F.coalesce("in_universe", F.lit(False)).alias("in_universe"), "is_listed")


@query(f"""with {SIGNAL_SQL}, u as (select *, case when industry < 'K' then signal end as x from s0) select code, date, round((x - avg(x) over (partition by date)) / nullif(stddev_samp(x) over (partition by date), 0), 6) as z from u""")
def formula_universe_mask(spark, sf_dir):
    return r6(formula.compute(_pm(spark, sf_dir), SIGNAL + "\nz = cs_zscore(signal)", ["z"], mask=F.col("industry") < "K"))


@query(f"with {MONTHLY} select code, date, coalesce(close > open and volume > avg(volume) over (partition by date), false) as in_universe from pm")
def formula_pool(spark, sf_dir):
    return formula.pool(panels.monthly(spark, sf_dir), "and_(close > open, volume > volume - cs_demean(volume))").select("code", "date", "in_universe")


@query(f"""with {SIGNAL_SQL}, k as (select date, code, row_number() over (partition by date order by signal desc, code) as r from s0 where signal is not null) select date as decision_date, code, round(1.0 / count(*) over (partition by date), 6) as target_weight, r as rank from k where r <= 5""")
def portfolio_top_k(spark, sf_dir):
    t = portfolio.top_k_weights(_scored(spark, sf_dir), 5)
    return t.select("decision_date", "code", F.round("target_weight", 6).alias("target_weight"), F.col("rank").cast("long").alias("rank"))


@query(f"""with {SIGNAL_SQL}, k as (select date, code, case when total_mv > 0 then total_mv else 0 end as m, row_number() over (partition by date order by signal desc, code) as r from s0 where signal is not null), t as (select *, sum(m) over (partition by date) as s from k where r <= 5)
select date as decision_date, code, round(m / s, 6) as target_weight from t where m > 0""")
def portfolio_market_cap(spark, sf_dir):
    return portfolio.top_k_weights(_scored(spark, sf_dir), 5, "market_cap").select("decision_date", "code", F.round("target_weight", 6).alias("target_weight"))


@query(f"""with {SIGNAL_SQL}, k as (select date, code, row_number() over (partition by date order by signal desc, code) as r from s0 where signal is not null), t as (select date, code, 1.0 / count(*) over (partition by date) as w from k where r <= 5),
d as (select date, row_number() over (order by date) as i from (select distinct date from t)), x as (select i, code, w, date from t join d using (date)), m as (select i, code, w from x union all select i + 1, code, -w from x),
s as (select i, sum(abs(w)) / 2 as turnover from (select i, code, sum(w) as w from m group by 1, 2) group by 1) select date as decision_date, round(coalesce(turnover, 0), 6) as turnover from d left join s using (i)""")
def portfolio_turnover(spark, sf_dir):
    t = portfolio.top_k_weights(_scored(spark, sf_dir), 5)
    return r6(portfolio.weight_turnover(t, t))


@query(f"""with recursive {SIGNAL_SQL}, k as (select date, code, row_number() over (partition by date order by signal desc, code) as r from s0 where signal is not null),
d as (select date, row_number() over (order by date) as i, list({{'r': r, 'c': code}} order by r) filter (where r <= 8) as best from k group by date),
h as (select 1::bigint as i, (select list_transform(best[1:5], lambda x: x.c) from d where i = 1) as held
  union all select d.i, list_concat(list_transform(list_filter(d.best, lambda x: list_contains(h.held, x.c)), lambda x: x.c), list_transform(list_filter(d.best, lambda x: not list_contains(h.held, x.c)), lambda x: x.c)[1:5 - len(list_filter(d.best, lambda x: list_contains(h.held, x.c)))])
  from h join d on d.i = h.i + 1)
select date as decision_date, unnest(held) as code, round(1.0 / len(held), 6) as target_weight from h join d using (i)""")
def portfolio_buffered(spark, sf_dir):
    return r6(portfolio.buffered_top_k(_scored(spark, sf_dir), 5, 8))


@query()
def portfolio_simulate(spark, sf_dir):
    d = _scored(spark, sf_dir)
    t = portfolio.top_k_weights(d, 5)
    return r6(portfolio.simulate(d, t, t), digits=2)


@query(f"with {DAILY}, d as (select distinct date from pm) select isoyear(date)::int as y, weekofyear(date)::int as w, max(date) as date from d group by 1, 2")
def portfolio_schedule(spark, sf_dir):
    d = portfolio.rebalance_dates(panels.daily(spark, sf_dir), "weekly")
    return d.select(F.extract(F.lit("YEAROFWEEK"), "date").cast("int").alias("y"), F.weekofyear("date").alias("w"), "date")


@query("""with f as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_returnflag = 'R' then 'SELL' else 'BUY' end as side, l_quantity as quantity, l_extendedprice / l_quantity as p from lineitem),
e as (select *, p * case when side = 'BUY' then 1.0005 else 0.9995 end as ep from f), n as (select *, ep * quantity as gross from e), c as (select *, greatest(gross * 0.00025, 5.0) as commission, case when side = 'SELL' then gross * 0.0005 else 0 end as stamp, gross * 0.00001 as transfer from n)
select side, count(*) as n, round(sum(commission + stamp + transfer), 2) as fees, round(sum(case when side = 'BUY' then -gross else gross end - commission - stamp - transfer), 1) as cash from c group by 1""")
def execution_costs(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"), F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("reference_price"))
    c = portfolio.execution_costs(li)
    return c.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("total_fees"), 2).alias("fees"), F.round(F.sum("effective_cash_delta"), 1).alias("cash"))


@query("""with d as (select *, count(*) over (partition by ts_code, trade_date) as dup from daily), v as (
select unnest(list_filter([case when high < greatest(open, close, low) - 1e-9 then 'high_below' end, case when low > least(open, close, high) + 1e-9 then 'low_above' end, case when vol < 0 then 'volume_negative' end, case when vol is null then 'volume_missing' end, case when amount is null then 'amount_missing' end,
case when vol > 0 and amount = 0 then 'volume_without_amount' end, case when vol = 0 and amount > 0 then 'amount_without_volume' end, case when dup > 1 then 'duplicate_key' end, case when open is null or high is null or low is null or close is null then 'price_missing' end, case when open <= 0 or high <= 0 or low <= 0 or close <= 0 then 'price_not_positive' end], lambda r: r is not null)) as rule from d)
select rule, count(*) as n from v group by 1""")
def rules_daily_counts(spark, sf_dir):
    d = table(spark, sf_dir, "daily")
    rs = {k: v for k, v in rules.daily_rules("ts_code", "trade_date").items() if k not in ("order_of_days", "jump", "pre_close_gap", "key_missing", "code_form", "amount_negative")}
    return rules.violations(d, rs, ["row_id"]).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


RULES_SQL = """with d as (select *, count(*) over (partition by ts_code, trade_date) as dup, lag(trade_date) over w as last_day, lag(close) over w as last_close from daily window w as (partition by ts_code order by trade_date nulls first, loaded_at nulls first, row_id)), v as (
select row_id, src, trade_date, unnest(list_filter([case when high < greatest(open, close, low) - 1e-9 then 'high_below' end, case when low > least(open, close, high) + 1e-9 then 'low_above' end, case when vol < 0 then 'volume_negative' end, case when amount < 0 then 'amount_negative' end, case when vol is null or isnan(vol) then 'volume_missing' end, case when amount is null or isnan(amount) then 'amount_missing' end,
case when vol > 0 and amount = 0 then 'volume_without_amount' end, case when vol = 0 and amount > 0 then 'amount_without_volume' end, case when dup > 1 then 'duplicate_key' end, case when open is null or high is null or low is null or close is null or isnan(open) or isnan(high) or isnan(low) or isnan(close) then 'price_missing' end, case when open <= 0 or high <= 0 or low <= 0 or close <= 0 then 'price_not_positive' end,
case when ts_code is null or trade_date is null then 'key_missing' end, case when not coalesce(regexp_matches(ts_code, '^[0-9]{6}[.](SZ|SH|BJ)$'), false) then 'code_form' end, case when last_day >= trade_date then 'order_of_days' end, case when abs(close / nullif(last_close, 0) - 1) > 0.35 then 'jump' end, case when abs(pre_close - last_close) > 0.3 * pre_close then 'pre_close_gap' end], lambda r: r is not null)) as rule from d)"""
RULE_LEVEL = "case when rule = 'key_missing' then 'FATAL' when rule in ('volume_missing', 'amount_missing', 'volume_without_amount', 'amount_without_volume', 'order_of_days', 'jump', 'pre_close_gap') then 'WARNING' else 'ERROR' end"


@query(f"{RULES_SQL} select rule, count(*) as n from v group by 1")
def rules_daily_all_counts(spark, sf_dir):
    """Violations of all daily rules; rows of one day go by arrival."""
    d = table(spark, sf_dir, "daily")
    return rules.violations(d, rules.daily_rules("ts_code", "trade_date", ["loaded_at", "row_id"]), ["row_id"]).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query(f"{RULES_SQL}, l as (select {RULE_LEVEL} as level, rule, src, trade_date from v) select level, rule, src, trade_date, count(*) as n from l group by grouping sets ((level), (rule), (src), (trade_date))")
def rules_grouping_sets(spark, sf_dir):
    d = table(spark, sf_dir, "daily")
    return rules.counts(rules.violations(d, rules.daily_rules("ts_code", "trade_date", ["loaded_at", "row_id"]), ["row_id", "src", "trade_date"]), ["src", "trade_date"])


@query("with k as (select ts_code, trade_date, row_number() over (partition by ts_code, trade_date order by loaded_at desc, row_id desc) as rn, row_id, close from daily) select ts_code, trade_date, row_id from k where rn = 1")
def rules_repair(spark, sf_dir):
    return rules.repair(table(spark, sf_dir, "daily"), ["loaded_at", "row_id"], "ts_code", "trade_date").select("ts_code", "trade_date", "row_id")


@query("""with c as (select cal_date as date, row_number() over (order by cal_date) as i from trade_cal where is_open = 1), d as (select distinct ts_code, trade_date, i from daily join c on c.date = trade_date), n as (select ts_code, trade_date, i, lead(i) over w as j, lead(trade_date) over w as b from d window w as (partition by ts_code order by i))
select ts_code, trade_date as after, b as before, j - i - 1 as n_missing from n where j > i + 1""")
def rules_gaps(spark, sf_dir):
    g = rules.gaps(table(spark, sf_dir, "daily"), panel.calendar(table(spark, sf_dir, "trade_cal"), "cal_date", "is_open"), "ts_code", "trade_date")
    return g.withColumn("n_missing", F.col("n_missing").cast("long"))


@query(f"with {INTRADAY}, x as (select code, date, minute_index, close, case when count(close) over r = 3 then avg(close) over r end as m3, max(close) over (partition by code, date order by minute_index rows unbounded preceding) as cm, lag(close) over (partition by code, date order by minute_index) as pc from b window r as (partition by code, date order by minute_index rows between 2 preceding and current row)) select code, date, minute_index, round(m3, 6) as a, round(cm, 6) as b, round(pc, 6) as c from x")
def intraday_rolling(spark, sf_dir):
    g = panels.intraday(spark, sf_dir).withColumn("minute_index", F.col("minute_index").cast("long"))
    return r6(formula.compute(g, "a = im_mean(close, 3)\nb = im_cummax(close)\nc = im_delay(close, 1)", ["a", "b", "c"], minute="minute_index"))


@query(f"with {INTRADAY} select code, date, round(arg_min(close, minute_index), 6) as a, round(arg_max(close, minute_index), 6) as b, round(sum(close), 6) as c, round(max(close), 6) as d, round(max(close) filter (where minute_index = 1), 6) as e from b group by 1, 2")
def intraday_daily_fold(spark, sf_dir):
    return r6(formula.daily_fold(panels.intraday(spark, sf_dir), "a = day_first(close)\nb = day_last(close)\nc = day_sum(close)\nd = day_max(close)\ne = at_minute(close, 1)", ["a", "b", "c", "d", "e"]))


@query(f"with {INTRADAY} select code, date, floor(minute_index / 5)::int as bucket, arg_min(close, minute_index) filter (where amount > 0) as open, max(close) filter (where amount > 0) as high, min(close) filter (where amount > 0) as low, arg_max(close, minute_index) filter (where amount > 0) as close, sum(volume)::double as volume, round(sum(amount), 6) as amount from b group by 1, 2, 3")
def intraday_resample(spark, sf_dir):
    d = panel.resample(panels.intraday(spark, sf_dir))
    return d.withColumn("amount", F.round("amount", 6))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a book of a day: added orders have a side and one of four prices, and what fills or cancels goes by its own."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("signup", "purchase"), "add").when(F.col("event_type") == "error", "cancel").otherwise("fill")
    ms = ((F.unix_micros(F.col("ts").cast("timestamp")) / 1000) % 86400000).cast("long")
    side = F.when(F.col("event_id") % 2 == 0, "B").otherwise("S")
    price = 10.0 + F.floor(F.col("value")) % 4
    return e.select(F.col("user_id").cast("string").alias("code"), F.to_date("ts").alias("date"), ms.alias("ms"), F.col("event_id").alias("seq"), kind.alias("kind"), side.alias("side"), price.alias("price"), F.col("value").alias("qty"), F.col("event_id").alias("id"))


@query("""with o as (select user_id::varchar as code, ts::date as date, event_id as seq, ts, case when event_type in ('signup', 'purchase') then 0 when event_type = 'error' then 2 else 1 end as p, value, event_id % 2 as side, floor(value) % 4 as price from events)
select code, date, seq, round(sum(case when p = 0 then value else -value end) over (partition by code, date, side, price order by date_trunc('millisecond', ts), p, seq rows unbounded preceding), 6) as level_qty from o""")
def orderbook_levels(spark, sf_dir):
    return r6(orderbook.replay_levels(_orders(spark, sf_dir)).select("code", "date", "seq", "level_qty"))


@query()
def orderbook_fifo(spark, sf_dir):
    return orderbook.replay_fifo(_orders(spark, sf_dir).withColumn("price", F.lit(1.0)))


@query("""with o as (select user_id::varchar as code, ts::date as date, event_id as seq, ((epoch_us(ts) / 1000) % 86400000)::bigint as ms0, floor((epoch_us(ts) / 1000) % 86400000)::bigint as ms, case when event_type in ('signup', 'purchase') then 'add' when event_type = 'error' then 'cancel' else 'fill' end as kind, value as qty from events),
base as (select code, date, count(*) filter (where kind = 'add') as n_add, count(*) filter (where kind = 'fill') as n_fill, count(*) filter (where kind = 'cancel') as n_cancel, sum(qty) filter (where kind = 'fill') as filled, quantile_cont(qty, 0.9) filter (where kind = 'fill') as large_at from o group by 1, 2),
bs as (select code, date, max(n) as max_burst, avg(n) as mean_burst from (select code, date, ms // 1000 as s, count(*) as n from o group by 1, 2, 3) group by 1, 2),
gp as (select code, date, avg(gap) as mean_gap, max(gap) as max_gap from (select code, date, ms - lag(ms) over (partition by code, date order by ms, seq) as gap from o where kind = 'fill') group by 1, 2),
bg as (select code, date, sum(case when qty >= large_at then qty end) / sum(qty) as large_share from o join base using (code, date) where kind = 'fill' group by 1, 2)
select * replace (round(filled, 6) as filled, round(large_at, 6) as large_at, round(mean_burst, 6) as mean_burst, round(mean_gap, 6) as mean_gap, round(large_share, 6) as large_share) from base left join bs using (code, date) left join gp using (code, date) left join bg using (code, date)""")
def orderbook_day_stats(spark, sf_dir):
    return r6(orderbook.day_stats(_orders(spark, sf_dir)))


@query("""with t as (select event_id, user_id, ts, event_type, value, sign(value - lag(value) over w) as ch from events window w as (partition by user_id order by ts, event_id)) select event_id, coalesce(last_value(nullif(ch, 0) ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding), 0)::double as side from t""")
def orderbook_tick_side(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", orderbook.tick_side(F.col("value"), ["ts", "event_id"], ["user_id"]).alias("side"))


@query("""with e as (select event_id, user_id, epoch_ms(ts) as t from events where event_type = 'error') select e.user_id::varchar as code, e.event_id, round(sum(x.value) filter (where epoch_ms(x.ts) < e.t), 6) as sum_pre, count(*) filter (where epoch_ms(x.ts) < e.t) as n_pre, round(sum(x.value) filter (where epoch_ms(x.ts) >= e.t), 6) as sum_post, count(*) filter (where epoch_ms(x.ts) >= e.t) as n_post
from e left join events x on x.user_id = e.user_id and epoch_ms(x.ts) >= e.t - 3600000 and epoch_ms(x.ts) <= e.t + 3600000 group by 1, 2""")
def orderbook_around_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("code"), "event_id", "event_type", F.col("value").alias("qty"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("ms"))
    return r6(orderbook.around_events(e, e.where("event_type = 'error'"), "code", 3_600_000, 3_600_000, bin_ms=3_600_000))


@query("""with z as (select event_id, value, count(value) over w as n, avg(value) over w as m, stddev_samp(value) over w as s from events window w as (partition by user_id order by ts, event_id rows between 40 preceding and 1 preceding)) select event_id, round(case when n >= 10 and s > 0 then (value - m) / s end, 6) as z from z""")
def orderbook_shocks(spark, sf_dir):
    return r6(orderbook.shocks(table(spark, sf_dir, "events"), "value", ["user_id"], ["ts", "event_id"]).select("event_id", "z"))


@query(f"with {DAILY}, p as (select code, date, case when count(high) over w = 5 then max(high) over w / close - 1 end as future_peak_5d from pm window w as (partition by code order by date rows between 1 following and 5 following)) select code, date, round(future_peak_5d, 6) as future_peak_5d from p")
def screen_future_peak(spark, sf_dir):
    return r6(orderbook.future_peak(panels.daily(spark, sf_dir), 5).select("code", "date", "future_peak_5d"))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _collect_stream(stream: DataFrame) -> DataFrame:
    return streams.run_to_files(stream)


@query("select event_type, time_bucket(interval '1 day', ts) as start, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def stream_tumbling(spark, sf_dir):
    d = streams.tumbling(_stream(spark, sf_dir), "ts", "1 day", "1 hour", ["event_type"], "value")
    return _collect_stream(d).select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query("select event_type, s as start, count(*) as n, round(sum(value), 4) as total from (select event_type, value, unnest([time_bucket(interval '12 hours', ts), time_bucket(interval '12 hours', ts) - interval '12 hours']) as s from events) group by 1, 2")
def stream_sliding(spark, sf_dir):
    d = streams.sliding(_stream(spark, sf_dir), "ts", "1 day", "12 hours", "1 hour", ["event_type"], "value")
    return _collect_stream(d).select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query("""with g as (select user_id, ts, value, case when ts - lag(ts) over w < interval '2 hours' then 0 else 1 end as b from events window w as (partition by user_id order by ts)), s as (select *, sum(b) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select user_id, min(ts) as start, count(*) as n, round(sum(value), 4) as total from s group by user_id, k""")
def stream_sessions(spark, sf_dir):
    d = streams.sessions(_stream(spark, sf_dir), "ts", "2 hours", "1 hour", ["user_id"], "value")
    return _collect_stream(d).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query("""with e as (select user_id, ts, event_id, case when event_type in ('signup', 'purchase') then value else -value end as q from events),
s as (select *, sum(q) over (partition by user_id order by ts, event_id rows unbounded preceding) as s from e),
m as (select *, least(0, min(s) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding)) as low from s)
select user_id, round(greatest(0, arg_max(s, (ts, event_id)) - least(0, min(s))), 6) as resting, count(*) as events, count(*) filter (where s < coalesce(low, 0)) as clipped from m group by 1""")
def stream_running_book(spark, sf_dir):
    s = _stream(spark, sf_dir).select(F.col("user_id"), "ts", "event_id", F.when(F.col("event_type").isin("signup", "purchase"), "add").otherwise("fill").alias("kind"), F.col("value").alias("qty"))
    return r6(streams.last_state(streams.run_to_files(streams.running_book(s, "user_id", "ts", "kind", "qty", "event_id"), "update"), "user_id"))


@query("select o_custkey, count(*) as n, round(sum(o_totalprice), 2) as total from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING') group by 1")
def join_semi(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return o.join(c, o["o_custkey"] == c["c_custkey"], "left_semi").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def join_anti(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey")


@query("""with e as (select distinct l_suppkey, l_shipdate::date as d from lineitem), k as (select l_suppkey, d, max(o_orderkey) as last_order from (select e.l_suppkey, e.d, o_orderkey, row_number() over (partition by e.l_suppkey, e.d order by o_orderdate desc, o_orderkey desc) as rn from e join orders on o_custkey = e.l_suppkey and o_orderdate::date <= e.d) where rn = 1 group by 1, 2) select e.l_suppkey, e.d, last_order from e left join k on k.l_suppkey = e.l_suppkey and k.d = e.d""")
def join_asof(spark, sf_dir):
    from loomspan.operators import asof

    ev = table(spark, sf_dir, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("d")).distinct()
    o = table(spark, sf_dir, "orders").withColumn("t", F.to_date("o_orderdate"))
    out = asof.as_known_at(ev, "l_suppkey", F.col("d").cast("timestamp"), {"o": asof.Attributes(o, "o_custkey", "t", "t", ["o_orderdate", "o_orderkey"])})
    return out.select("l_suppkey", "d", F.col("o.o_orderkey").alias("last_order"))


@query("select r_name, n_name, sum(case when c_acctbal < 0 then 1 else 0 end)::bigint as negative, count(*) as n, round(avg(c_acctbal), 6) as mean, round(quantile_cont(c_acctbal, 0.9), 6) as q90, count(distinct c_mktsegment) as segments from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2")
def agg_grouped(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    d = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])
    return d.groupBy("r_name", "n_name").agg(F.count_if(F.col("c_acctbal") < 0).alias("negative"), F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 6).alias("mean"), F.round(F.percentile("c_acctbal", 0.9), 6).alias("q90"), F.count_distinct("c_mktsegment").alias("segments"))


@query("select o_custkey from orders intersect select c_custkey from customer where c_acctbal > 5000")
def set_intersect(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_custkey").intersect(table(spark, sf_dir, "customer").where("c_acctbal > 5000").select("c_custkey"))


@query("select c_custkey from customer except select o_custkey from orders")
def set_except(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey").subtract(table(spark, sf_dir, "orders").select("o_custkey"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 300")
def sort_top300(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(300)


@query()
def score_walk_forward(spark, sf_dir):
    from loomspan.operators import score

    d = _scored(spark, sf_dir)
    d = score.robust_z(d.withColumn("gap", F.col("close") / F.col("open") - 1), ["signal", "gap", "volume"])
    d, names = score.expand(d, ["signal", "gap", "volume"])
    return r6(score.walk_forward(d.withColumn("label", F.log1p("forward_return_1d")), names, "label", "year", 2, 31))


@query()
def screen_snapshot(spark, sf_dir):
    from loomspan.operators import score

    return r6(score.score_rank(score.screen_features(panels.daily(spark, sf_dir)), {"r20": 1.0, "up": 0.5, "vol": -0.5}))


@query(f"""with {INTRADAY}, v as (select code, date, minute_index, close, floor(round(close * 100) * 0.1) as cap from b), o as (select distinct code, date from b),
u as (select *, least(sum(cap) over (partition by code, date order by minute_index), 500) as upto from v where minute_index <= 5), g as (select *, upto - coalesce(lag(upto) over (partition by code, date order by minute_index), 0) as got from u),
f as (select code, date, sum(got)::bigint as filled, sum(got * close) / nullif(sum(got), 0) as vwap, count(*) filter (where got > 0) as minutes from g group by 1, 2)
select code, date, 'BUY' as side, 500::bigint as quantity, 0 as start, 5 as "end", null::double as "limit", filled, round(vwap, 6) as vwap, minutes, 500 - filled as left from o join f using (code, date)""")
def execution_window_fills(spark, sf_dir):
    from loomspan.operators import execution

    bars = panels.intraday(spark, sf_dir).withColumn("volume", F.round(F.col("close") * 100))
    orders = bars.select("code", "date").distinct().select("*", F.lit("BUY").alias("side"), F.lit(500).cast("long").alias("quantity"), F.lit(0).alias("start"), F.lit(5).alias("end"), F.lit(None).cast("double").alias("limit"))
    return r6(execution.window_fills(orders, bars, 0.1, 1))


@query("""with s as (select ts_code, cal_date as date from instrument_basic, trade_cal where is_open = 1), h as (select distinct ts_code, trade_date as date from daily), l as (select ts_code, max(trade_date) as last from daily group by 1)
select case when s.date < i.list_date then 'before_listing' when s.date >= i.delist_date then 'after_delisting' when l.last is null or s.date > l.last then 'terminal' else 'gap' end as cause, count(*) as n
from s left join h using (ts_code, date) join instrument_basic i using (ts_code) left join l using (ts_code) where h.ts_code is null group by 1""")
def rules_classify_missing(spark, sf_dir):
    d = table(spark, sf_dir, "daily").select(F.col("ts_code").alias("code"), F.col("trade_date").alias("date"))
    listing = table(spark, sf_dir, "instrument_basic").select(F.col("ts_code").alias("code"), "list_date", "delist_date")
    return rules.classify_missing(d, listing, panel.calendar(table(spark, sf_dir, "trade_cal"), "cal_date", "is_open")).groupBy("cause").agg(F.count(F.lit(1)).alias("n"))


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def rules_check_key(spark, sf_dir):
    return rules.check_key(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "n")


@query("select ts_code, fund_id from (select ts_code, fund_id, row_number() over (partition by ts_code order by updated_date desc, known_at desc, fund_id desc) as rn from fundamentals where known_at <= timestamp '2025-08-01 00:00:00') where rn = 1")
def source_snapshot(spark, sf_dir):
    from loomspan.sources import tables

    return tables.snapshot(table(spark, sf_dir, "fundamentals").select("ts_code", "updated_date", "known_at", "fund_id"), "2025-08-01", "known_at", ["updated_date", "known_at", "fund_id"]).select("ts_code", "fund_id")


@query(f"with {INTRADAY}, p as (select code, date, count(*) as n from b group by 1, 2) select code, count(*) as days, count(*) filter (where n >= 2) as full_days, min(n) as fewest from p group by 1")
def source_minute_coverage(spark, sf_dir):
    from loomspan.sources import tables

    return tables.minute_coverage(panels.intraday(spark, sf_dir), full=2)


@query("select ts_code, trade_date, close, circ_mv from daily left join (select ts_code, trade_date, max(circ_mv) as circ_mv from daily_basic group by 1, 2) using (ts_code, trade_date) where trade_date between date '2025-03-01' and date '2025-03-31'")
def source_daily_enriched(spark, sf_dir):
    """A month of `source_load_daily`, by the operator's own day range."""
    from loomspan.sources import tables

    return tables.load_daily(tables.Catalog(spark, sf_dir), ["close", "circ_mv"], "2025-03-01", "2025-03-31", extra=["daily_basic"])


@query("select ts_code, trade_date, close, circ_mv from daily left join (select ts_code, trade_date, max(circ_mv) as circ_mv from daily_basic group by 1, 2) using (ts_code, trade_date)")
def source_load_daily(spark, sf_dir):
    """Every row of daily with its market value, over the whole tables."""
    from loomspan.sources import tables

    return tables.load_daily(tables.Catalog(spark, sf_dir), ["close", "circ_mv"], extra=["daily_basic"])
