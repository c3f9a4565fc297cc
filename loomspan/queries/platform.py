"""Queries of sources, dataflow operators, factor runs and evaluation that the other modules leave out, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import dataflow, evaluate, execution, orderbook, panel, portfolio, rules
from loomspan.plans import formula, run
from loomspan.queries import panels
from loomspan.queries.common import table
from loomspan.queries.panels import ATTR, DAILY, INTRADAY, MONTHLY
from loomspan.queries.research import BUCKET_SQL, IC_SQL, SIGNAL_SQL, _orders, _scored, r6
from loomspan.sources import tables

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """daily under the panel's names, the latest row of each key."""
    d = rules.repair(table(spark, sf_dir, "daily"), ["loaded_at", "row_id"], "ts_code", "trade_date")
    return d.withColumnsRenamed({"ts_code": "code", "trade_date": "date", "vol": "volume"})


LATEST = "dl as (select * exclude (k, ts_code, trade_date, vol), ts_code as code, trade_date as date, vol as volume from (select *, row_number() over (partition by ts_code, trade_date order by loaded_at desc, row_id desc) as k from daily) where k = 1)"


@query("select ts_code, max(trade_date) as last_date from daily where close is not null and trade_date < date '2025-09-01' group by 1")
def source_last_close(spark, sf_dir):
    return panel.last_seen(table(spark, sf_dir, "daily"), "close", "2025-09-01", code="ts_code", date="trade_date")


@query("select ts_code, max(nullif(market, '')) as market, max(nullif(industry, '')) as industry, max(total_shares) as total_shares from fundamentals group by 1")
def source_static_attributes(spark, sf_dir):
    return tables.code_attributes(table(spark, sf_dir, "fundamentals"), ["market", "industry", "total_shares"])


@query(f"with {LATEST}, c as (select distinct ts_code as code from instrument_basic) select code, open, close, open is not null or close is not null or dl.code is not null as has_daily, false as has_limit, false as is_suspended_at_open from c left join (select code, open, close from dl where date = date '2025-06-03') dl using (code)".replace("open is not null or close is not null or dl.code is not null", "dl.code is not null"))
def source_market_open(spark, sf_dir):
    none = spark.createDataFrame([], "code string, date date")
    codes = table(spark, sf_dir, "instrument_basic").select(F.col("ts_code").alias("code"))
    return tables.market_open(codes, _daily(spark, sf_dir).select("code", "date", "open", "close"), none, none, "2025-06-03", least=0.0)


@query(f"with {INTRADAY} select code, date, minute_index, close from b where date = date '2024-01-10' and minute_index between 1 and 3")
def source_execution_window(spark, sf_dir):
    return dataflow.execution_window(panels.intraday(spark, sf_dir), "2024-01-10", 1, 3).select("code", "date", "minute_index", "close")


@query("select adj_id, ts_code, trade_date from adj_factor where trade_date between date '2025-03-01' and date '2025-06-30' and ts_code in (select ts_code from instrument_basic where industry is not null)")
def source_action_window(spark, sf_dir):
    codes = table(spark, sf_dir, "instrument_basic").where("industry is not null")
    return dataflow.action_window(table(spark, sf_dir, "adj_factor"), "2025-03-01", "2025-06-30", codes, "ts_code", "trade_date").select("adj_id", "ts_code", "trade_date")


@query("select event_id, event_type from (select event_id, event_type, row_number() over (partition by event_type order by event_id) - 1 as r, ceil(count(*) over (partition by event_type) / 50) as k from events) where r % k = 0")
def filter_stride(spark, sf_dir):
    return tables.quota(table(spark, sf_dir, "events"), "event_type", 50, F.col("event_id")).select("event_id", "event_type")


@query("select row_id, trade_date from daily where trade_date in (select trade_date from (select distinct trade_date from daily where trade_date is not null) order by md5(concat_ws('|', trade_date::varchar, '7')), trade_date limit 12)")
def filter_seeded_dates(spark, sf_dir):
    return dataflow.seeded_dates(table(spark, sf_dir, "daily"), 12, 7, "trade_date").select("row_id", "trade_date")


@query("select row_id, trade_date from daily where trade_date in (select trade_date from (select distinct trade_date from daily where trade_date is not null) order by trade_date desc limit 5)")
def filter_last_dates(spark, sf_dir):
    return dataflow.last_dates(table(spark, sf_dir, "daily"), 5, "trade_date").select("row_id", "trade_date")


@query("""select ts_code, upper(right(ts_code, 2)) as exchange, case when upper(right(ts_code, 2)) = 'BJ' then 'bse' when upper(right(ts_code, 2)) = 'SH' and left(ts_code, 3) in ('688', '689') then 'star'
when upper(right(ts_code, 2)) = 'SZ' and left(ts_code, 3) in ('300', '301') then 'chinext' when upper(right(ts_code, 2)) in ('SH', 'SZ') then 'main' else 'unknown' end as board from instrument_basic""")
def filter_board(spark, sf_dir):
    return table(spark, sf_dir, "instrument_basic").select("ts_code", panel.exchange(F.col("ts_code")).alias("exchange"), panel.board(F.col("ts_code")).alias("board"))


@query(f"""with st as (select ts_code as code, trade_date as date from daily where remark is not null and month(trade_date) <> 4), s as (select i.ts_code as code, c.cal_date as date, i.list_date, i.delist_date from instrument_basic i, trade_cal c where c.is_open = 1),
k as (select distinct date from st), f as (select distinct code, date from st),
j as (select s.code, s.date, s.date >= s.list_date and (s.delist_date is null or s.date < s.delist_date) as is_listed, case when k.date is not null then f.code is not null end as is_st, upper(right(s.code, 2)) as exchange, list_date from s left join k using (date) left join f on f.code = s.code and f.date = s.date)
select date, code, is_listed and date - list_date >= 60 and exchange in ('SH', 'SZ') and not coalesce(is_st, false) as in_universe, is_st from j""")
def filter_universe_st(spark, sf_dir):
    """Membership by listing age, exchange and a list of marked codes, which is unknown (not false) on days it does not cover."""
    basic = table(spark, sf_dir, "instrument_basic").select(F.col("ts_code").alias("code"), "list_date", "delist_date")
    st = table(spark, sf_dir, "daily").where("remark is not null and month(trade_date) <> 4").select(F.col("ts_code").alias("code"), F.col("trade_date").alias("date"))
    days = panel.skeleton(panel.calendar(table(spark, sf_dir, "trade_cal"), "cal_date", "is_open"), basic.select("code", F.lit("1900-01-01").cast("date").alias("first"), F.lit(None).cast("date").alias("last")))
    return panel.membership(days, basic, exchanges=["SH", "SZ"], min_list_days=60, st=st, exclude_st=True).select("date", "code", "in_universe", "is_st")


@query(f"with {DAILY}, i as (select date, close as index_close from pm where code = '1') select pm.code, pm.date, pm.close, index_close from pm left join i using (date)")
def join_index(spark, sf_dir):
    d = panels.daily(spark, sf_dir)
    return dataflow.index_columns(d, d, "1", ["close"]).select("code", "date", "close", "index_close")


@query("select m.ts_code as raw, m.trade_date, i.ts_code from daily_mirror m left join (select distinct m.ts_code as raw, i.ts_code from daily_mirror m join instrument_basic i on regexp_extract(m.ts_code, '[0-9]{6}') = i.symbol where m.ts_code = i.ts_code) i on i.raw = m.ts_code")
def join_canonical(spark, sf_dir):
    """Mirror rows under the canonical code, where their own spelling is the canonical one."""
    m = table(spark, sf_dir, "daily_mirror").select(F.col("ts_code").alias("raw"), "trade_date")
    known = table(spark, sf_dir, "instrument_basic").select(F.col("ts_code").alias("raw"), "ts_code")
    return dataflow.canonical_codes(m, known, "raw", "ts_code", "raw")


@query("""with o as (select user_id::varchar as code, ts::date as date, event_id, floor(value)::bigint as id, case when event_type in ('signup', 'purchase') then 'add' when event_type = 'error' then 'cancel' else 'fill' end as kind, case when event_id % 2 = 0 then 'B' else 'S' end as side, 10.0 + floor(value) % 4 as price from events),
a as (select code, date, id, max(side) as add_side, max(price) as add_price from o where kind = 'add' group by 1, 2, 3 having count(*) = 1)
select o.code, o.date, o.event_id as seq, add_side, add_price from o left join a using (code, date, id) where kind = 'cancel'""")
def join_cancels(spark, sf_dir):
    e = _orders(spark, sf_dir).withColumn("id", F.floor("qty").cast("long")).withColumn("ref", F.col("id"))
    return dataflow.link_cancels(e).select("code", "date", "seq", "add_side", "add_price")


@query("select ts_code, bool_or(coalesce(vol = 0, false)) as idle, bool_or(coalesce(close is null, false)) as no_close, bool_or(coalesce(high < low, false)) as crossed from daily group by 1")
def agg_any(spark, sf_dir):
    return dataflow.any_per_group(table(spark, sf_dir, "daily"), ["ts_code"], idle=F.col("vol") == 0, no_close=F.col("close").isNull(), crossed=F.col("high") < F.col("low"))


@query(f"with {BUCKET_SQL} select date, bucket, round(sum(f1 * volume) / nullif(sum(case when f1 is not null then volume end), 0), 6) as ret, count(*) as n from bk group by 1, 2")
def eval_weighted_buckets(spark, sf_dir):
    return r6(evaluate.bucket_returns(_scored(spark, sf_dir), "signal", "forward_return_1d", 5, weight="volume"))


@query(f"""with {SIGNAL_SQL}, v as (select date, signal, f, h from (select date, code, signal, unnest([1, 5, 10, 20]) as h, unnest([f1, f5, lead(close * adj_factor, 10) over w / (close * adj_factor) - 1, lead(close * adj_factor, 20) over w / (close * adj_factor) - 1]) as f from s0 window w as (partition by code order by date)) where signal is not null and f is not null),
rk as (select h, date, rank() over (partition by h, date order by signal) + (count(*) over (partition by h, date, signal) - 1) / 2.0 as a, rank() over (partition by h, date order by f) + (count(*) over (partition by h, date, f) - 1) / 2.0 as b from v),
ic as (select h, date, corr(a, b) as r from rk group by 1, 2 having count(*) >= 3)
select h as horizon, round(avg(r), 6) as mean_rank_ic from ic group by 1""")
def eval_ic_decay_all(spark, sf_dir):
    d = panel.forward_returns(_scored(spark, sf_dir).select("code", "date", "signal", "close", "adj_factor"), F.col("close") * F.col("adj_factor"), (1, 5, 10, 20))
    out = None
    for h in (1, 5, 10, 20):
        one = evaluate.ic_series(d, "signal", f"forward_return_{h}d").agg(F.lit(h).alias("horizon"), F.avg("rank_ic").alias("mean_rank_ic"))
        out = one if out is None else out.unionByName(one)
    return r6(out)


@query(f"""with {IC_SQL}, x as (select rank_ic - avg(rank_ic) over () as e, row_number() over (order by date) as i, avg(rank_ic) over () as m from ic where rank_ic is not null),
n as (select count(*) as n, floor(4 * pow(count(*) / 100.0, 2.0 / 9))::int as l, any_value(m) as m from x),
g as (select k, sum(a.e * b.e) / any_value(n) as g from n, unnest(range(0, n.l + 1)) t(k), x a, x b where b.i = a.i - k group by 1),
lv as (select sum(case when k = 0 then g else 2 * (1 - k / (l + 1.0)) * g end) as s from g, n)
select round(m / sqrt(s / n), 6) as t from n, lv""")
def eval_newey_west(spark, sf_dir):
    ic = evaluate.ic_series(_scored(spark, sf_dir), "signal", "forward_return_1d").where("rank_ic is not null").orderBy("date")
    # one number a date: small by construction
    return spark.createDataFrame([(round(float(evaluate.newey_west_t([r["rank_ic"] for r in ic.select("rank_ic").collect()])), 6),)], "t double")


_IM = "(partition by code, date order by minute_index rows between 2 preceding and current row)"


@query(f"""with {INTRADAY}, x as (select code, date, minute_index, count(close) over r as n, {', '.join(f'{a} over r as {c}' for c, a in {'s': 'sum(close)', 'sd': 'stddev_samp(close)', 'hi': 'max(close)', 'lo': 'min(close)', 'med': 'quantile_cont(close, 0.5)'}.items())} from b window r as {_IM})
select code, date, minute_index, {', '.join(f'round(case when n = 3 then {c} end, 6) as {c}' for c in ('s', 'sd', 'hi', 'lo', 'med'))} from x""")
def intraday_windows(spark, sf_dir):
    text = "s = im_sum(close, 3)\nsd = im_std(close, 3)\nhi = im_max(close, 3)\nlo = im_min(close, 3)\nmed = im_median(close, 3)"
    return r6(formula.compute(panels.intraday(spark, sf_dir), text, ["s", "sd", "hi", "lo", "med"], minute="minute_index"))


@query(f"""with {INTRADAY}, p as (select code, date, sum(close) as close, sum(amount) as amount, sum(volume) as volume from b group by 1, 2),
d as (select code, date, close, lag(close) over w as prev, amount, volume, case when count(amount) over r = 3 then avg(amount) over r end as adv_amt, case when count(volume) over r = 3 then avg(volume) over r end as adv_vol from p window w as (partition by code order by date), r as (partition by code order by date rows between 2 preceding and current row))
select b.code, b.date, b.minute_index, b.amount > 0 as has_trade, round(d.close, 6) as eod_close, round(prev, 6) as prev_close, round(d.amount, 6) as day_amt, round(d.volume, 6) as day_vol, round(adv_amt, 6) as adv20_amt, round(adv_vol, 6) as adv20_vol from b join d using (code, date)""")
def intraday_injected(spark, sf_dir):
    """Daily values on the grid, means over three rows."""
    b = panels.intraday(spark, sf_dir)
    day = b.groupBy("code", "date").agg(*[F.sum(c).alias(c) for c in ("close", "amount", "volume")])
    return r6(dataflow.inject_daily(dataflow.with_trade(b), day, 3).select("code", "date", "minute_index", "has_trade", "eod_close", "prev_close", "day_amt", "day_vol", "adv20_amt", "adv20_vol"))


@query(f"""with {SIGNAL_SQL}, m as (select *, close > open as member, close / lag(close, 2) over (partition by code order by date) - 1 as raw from s0), u as (select * from m where member)
select code, date, round((raw - avg(raw) over (partition by date)) / nullif(stddev_samp(raw) over (partition by date), 0), 6) as signal, round(lead5, 6) as label from (select u.*, f5 as lead5 from u) where date >= date '1997-01-01'""")
def run_factor_universe(spark, sf_dir):
    """A factor run: windows over all history, a universe by formula, then the chain over members only, with labels."""
    df = panels.monthly(spark, sf_dir).withColumn("adj_close", F.col("close") * F.col("adj_factor"))
    spec = run.Spec.of({"name": "f", "formula": "signal = close / ts_delay(close, 2) - 1", "process": ["zscore"], "universe": "m = close > open", "start": "1997-01-01"})
    return r6(run.run_factor(df, spec, price="adj_close").select("code", "date", "signal", F.col("forward_return_5d").alias("label")))


@query(f"""with {SIGNAL_SQL}, k as (select date, code, -signal as s, row_number() over (partition by date order by -signal desc, code) as r, count(*) over (partition by date) as n from s0 where signal is not null), t as (select *, greatest(s, 0) as w from k where r <= 10 and n >= 10)
select date as decision_date, code, round(w / sum(w) over (partition by date) * 0.9, 6) as target_weight, r as rank from t where w > 0""")
def portfolio_score(spark, sf_dir):
    return r6(portfolio.top_k_weights(_scored(spark, sf_dir), 10, "score", direction=-1, gross=0.9, insufficient="all_cash"))


@query(f"""with {MONTHLY}, x as (select code, date, open, close, case when code::int % 2 = 0 then 'BUY' else 'SELL' end as side, high * 0.99 as up_limit, low * 1.01 as down_limit, code::int % 7 = 0 as is_suspended_at_open, code::int % 5 <> 0 as has_daily, code::int % 11 <> 0 as has_limit from pm)
select code, date, case when is_suspended_at_open then 'SUSPENDED' when not has_daily or open <= 0 then 'NO_DATA' when not has_limit then 'NO_LIMIT_DATA' when side = 'BUY' and open >= up_limit - 1e-9 then 'UP_LIMIT' when side = 'SELL' and open <= down_limit + 1e-9 then 'DOWN_LIMIT' else 'FILLABLE' end as state from x""")
def execution_fillability(spark, sf_dir):
    c = F.col("code").cast("int")
    d = panels.monthly(spark, sf_dir).withColumns({"side": F.when(c % 2 == 0, "BUY").otherwise("SELL"), "up_limit": F.col("high") * 0.99, "down_limit": F.col("low") * 1.01, "is_suspended_at_open": c % 7 == 0, "has_daily": c % 5 != 0, "has_limit": c % 11 != 0})
    return d.select("code", "date", portfolio.fillability(d).alias("state"))


@query("select l_orderkey, l_linenumber, l_partkey, l_extendedprice, case when floor(l_quantity * 37 / 100) * 100 >= 100 then floor(l_quantity * 37 / 100) * 100 else 0 end::bigint as buy, case when l_quantity * 37 >= 800 then 800 else floor(l_quantity * 37 / 100) * 100 end::bigint as sell from lineitem")
def execution_lots(spark, sf_dir):
    q = F.col("l_quantity") * 37
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", portfolio.lot_quantity(q).alias("buy"), portfolio.sell_quantity(q, F.lit(800)).alias("sell"))


@query("select s_suppkey::varchar as code, floor(round(s_acctbal * 100) * 13 / 10)::bigint as quantity, round(round(s_acctbal * 100) * 0.25, 4) as cash from supplier where s_acctbal > 0")
def execution_corporate_actions(spark, sf_dir):
    pos = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").cast("string").alias("code"), F.round(F.col("s_acctbal") * 100).cast("long").alias("quantity"))
    ev = pos.select("code", F.lit("1.3").cast("decimal(38,18)").alias("share_ratio"), F.lit("0.25").cast("decimal(38,18)").alias("cash_per_share"))
    return execution.corporate_actions(pos, ev).select("code", "quantity", F.round("cash", 4).alias("cash"))


@query("""with t as (select event_id, case event_id % 4 when 0 then null when 1 then '09:30-10:00' when 2 then '09:00-09:35,13:00-15:00' else '22:00-09:31' end as timing from events)
select event_id, case event_id % 4 when 0 then true when 1 then 570 >= 570 and 570 < 600 when 2 then 570 >= 540 and 570 < 575 else 570 >= 1320 or 570 < 571 end as covered from t""")
def execution_suspension(spark, sf_dir):
    k = F.col("event_id") % 4
    t = F.when(k == 1, "09:30-10:00").when(k == 2, "09:00-09:35,13:00-15:00").when(k == 3, "22:00-09:31")
    return table(spark, sf_dir, "events").select("event_id", execution.covers(t, 570).alias("covered"))


@query(f"""with {DAILY}, x as (select code, date, close, adj_factor, lag(close) over w * lag(adj_factor) over w / nullif(adj_factor, 0) as pre from pm window w as (partition by code order by date)), y as (select *, floor(pre * 100 + 0.5) / 100 as pre_close from x), z as (select *, round(close - pre_close, 4) as ch from y)
select code, date, pre_close, round(ch * 1.000000001, 2) as change, round(round(ch / nullif(pre_close, 0) * 100, 4) * 1.000000001, 2) as pct_chg from z""")
def rules_derive_daily(spark, sf_dir):
    return rules.derive_daily(panels.daily(spark, sf_dir)).select("code", "date", "pre_close", *[F.round(F.col(c) * 1.000000001, 2).alias(c) for c in ("change", "pct_chg")])


@query("""with x as (select ts_code, row_id, trade_date, pre_close, row_number() over (partition by ts_code order by trade_date, row_id) as k, round(pre_close * 100)::bigint as cents, case when upper(right(ts_code, 2)) = 'BJ' then 30 when upper(right(ts_code, 2)) = 'SH' and left(ts_code, 3) in ('688', '689') or upper(right(ts_code, 2)) = 'SZ' and left(ts_code, 3) in ('300', '301') then 20 else 10 end as pct from daily where trade_date is not null)
select row_id, case when k > 5 then floor((cents * (100 + pct) + 50) / 100.0) / 100.0 end as up_limit, case when k > 5 then floor((cents * (100 - pct) + 50) / 100.0) / 100.0 end as down_limit from x""")
def rules_price_limits(spark, sf_dir):
    d = table(spark, sf_dir, "daily").where("trade_date is not null").withColumn("date", F.struct("trade_date", "row_id"))
    return rules.price_limits(d, {"main": 10, "star": 20, "chinext": 20, "bse": 30}, panel.board(F.col("ts_code")), code="ts_code").select("row_id", "up_limit", "down_limit")


@query(f"with {DAILY}, s as (select code, max(date) filter (where close is not null) as last_date from pm group by 1), c as (select distinct date from pm) select code, last_date, (select count(*) from c where c.date > s.last_date)::int as gap from s where (select count(*) from c where c.date > s.last_date) > 2")
def panel_stale(spark, sf_dir):
    d = panels.daily(spark, sf_dir)
    return panel.stale_codes(d, d.select("date").distinct(), limit=2)


@query(f"with {DAILY} select code, date, round(close * adj_factor / lag(close * adj_factor) over (partition by code order by date) - 1, 6) as ret from pm")
def panel_total_return(spark, sf_dir):
    return r6(panels.daily(spark, sf_dir).select("code", "date", panel.total_return(F.col("close"), F.col("adj_factor")).alias("ret")))


@query("select c_custkey as k from customer union select o_custkey from orders")
def set_union_distinct(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).union(table(spark, sf_dir, "orders").select("o_custkey")).distinct()


@query("""with d as (select ts_code as code, trade_date as date, count(*) as actual from daily where trade_date is not null group by 1, 2), e as (select cal_date as date, count(*) as expected from trade_cal, instrument_basic where is_open = 1 group by 1), a as (select date, count(*) as actual from d group by 1)
select coalesce(e.date, a.date) as date, coalesce(expected, 0) as expected, coalesce(actual, 0) as actual, case when expected > 0 then round(coalesce(actual, 0) / expected, 6) end as coverage from e full join a on e.date = a.date""")
def rules_completeness(spark, sf_dir):
    have = table(spark, sf_dir, "daily").where("trade_date is not null").select(F.col("ts_code").alias("code"), F.col("trade_date").alias("date")).distinct()
    basic = table(spark, sf_dir, "instrument_basic").select(F.col("ts_code").alias("code"), F.lit("1900-01-01").cast("date").alias("first"), F.lit(None).cast("date").alias("last"))
    return r6(rules.completeness(have, panel.skeleton(panel.calendar(table(spark, sf_dir, "trade_cal"), "cal_date", "is_open"), basic)))


_BOOK = """o as (select user_id::varchar as code, ts::date as date, event_id as seq, floor((epoch_us(ts) / 1000) % 86400000)::bigint as ms, case when event_type in ('signup', 'purchase') then 0 when event_type = 'error' then 2 else 1 end as p, value, case when event_id % 2 = 0 then 'B' else 'S' end as side, 10.0 + floor(value) % 4 as price from events),
lv as (select *, sum(case when p = 0 then value else -value end) over (partition by code, date, side, price order by ms, p, seq rows unbounded preceding) as q from o),
cp as (select code, date, (ms // 3600000)::int as minute, side, price, arg_max(q, (ms, p, seq)) as level_qty from lv group by 1, 2, 3, 4, 5)"""


@query(f"with {_BOOK} select code, date, minute, side, price, round(level_qty, 6) as level_qty from cp")
def orderbook_checkpoints(spark, sf_dir):
    """The book at the end of each hour."""
    return r6(orderbook.minute_checkpoints(_orders(spark, sf_dir), minute_ms=3_600_000))


@query(f"with {_BOOK}, b as (select *, case when side = 'B' then max(case when level_qty > 0 then price end) over w else min(case when level_qty > 0 then price end) over w end as best from cp window w as (partition by code, date, side)) select code, date, minute, side, price, best from b where abs(price - best) <= 1")
def orderbook_band(spark, sf_dir):
    d = orderbook.minute_checkpoints(_orders(spark, sf_dir), minute_ms=3_600_000)
    return orderbook.near_best(d, 1, 1.0, ["code", "date"]).select("code", "date", "minute", "side", "price", "best")


@query("""with a as (select event_id, ts, ts + (event_id % 1000) * interval 1 millisecond as arrival from events)
select event_id, arrival > ts + interval 500 millisecond as late, time_bucket(interval '1 minute', case when arrival > ts + interval 500 millisecond then arrival else ts end) as bucket from a""")
def stream_late(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("arrival", F.col("ts") + F.make_dt_interval(secs=(F.col("event_id") % 1000) / 1000))
    return orderbook.attribute_late(e, "ts", "arrival").select("event_id", "late", F.col("bucket").cast("timestamp_ntz").alias("bucket"))


@query(f"""with {SIGNAL_SQL}, r as (select date, code, signal as a, close / open - 1 as b from s0)
select date, code, round(a - avg(a) over (partition by date) + 0.5 * b, 6) as signal from r""")
def analysis_composite_user(spark, sf_dir):
    """A composite by a function of the caller's."""
    d = _scored(spark, sf_dir)
    other = d.withColumn("signal", F.col("close") / F.col("open") - 1)
    made = evaluate.composite_apply({"a": d, "b": other}, lambda x, p: x["a"] - x["a"].mean() + p["k"] * x["b"], {"k": 0.5})
    return r6(made.select("date", "code", "signal"))


@query(f"""with {SIGNAL_SQL}, m as (select *, close / lag(close) over (partition by code order by date) - 1 as r1, close / open - 1 as r2 from s0)
select code, date, round((r1 - avg(r1) over (partition by date)) / nullif(stddev_samp(r1) over (partition by date), 0), 6) as one, round((r2 - avg(r2) over (partition by date)) / nullif(stddev_samp(r2) over (partition by date), 0), 6) as two, round(f1, 6) as forward_return_1d from m""")
def run_factor_outputs(spark, sf_dir):
    """A factor run with two outputs of one formula and a label."""
    df = panels.monthly(spark, sf_dir).withColumn("adj_close", F.col("close") * F.col("adj_factor"))
    spec = run.Spec.of({"name": "f", "formula": "one = returns(close)\ntwo = close / open - 1", "outputs": ["one", "two"], "process": ["zscore"], "horizon": 1})
    return r6(run.run_factor(df, spec, price="adj_close").select("code", "date", "one", "two", "forward_return_1d"))
