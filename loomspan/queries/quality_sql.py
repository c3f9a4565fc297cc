"""DuckDB SQL of the data-quality queries, over the whole tables."""

_NUMBERS = "shard completeness.expected_count completeness.actual_count completeness.coverage quality.fatal_count quality.error_count quality.warning_count quality.quarantine_count quality.error_rate".split()
_TEXTS = "dataset_id partition_date data_version health_status completeness.status quality.systematic_issue validated_at".split()
_CELLS = " union all ".join(
    [f"select segment, load_id, '{c}' as field, true as num, {c}::double as x, null as t from ashare_daily" for c in _NUMBERS]
    + [f"select segment, load_id, '{c}', false, null, {c}::varchar from ashare_daily" for c in _TEXTS]
)
_MASKED = f"""
with cells as ({_CELLS}),
a as (select *, case when abs(x) >= 1e-290 and not isinf(x) and not isnan(x) then abs(x) end as a from cells),
e as (select *, floor(log10(a))::int as e0 from a),
d as (select *, floor(a / pow(10.0, e0 - 2) * (1 + 1e-9))::int as d0 from e),
f as (select *, case when d0 >= 1000 then e0 + 1 when d0 < 100 then e0 - 1 else e0 end as e1, case when d0 >= 1000 then d0 // 10 when d0 < 100 then 999 else d0 end as d1 from d),
masked as (
  select segment, load_id, field, num, case when isnan(x) or isinf(x) then null else x end as x, case
    when num and x is null or not num and t is null then '<null>'
    when num and isnan(x) then '<nan>'
    when num and isinf(x) then case when x < 0 then '-<inf>' else '+<inf>' end
    when num and x = 0 then '0'
    when num and a is null then case when x < 0 then '-<tiny>' else '+<tiny>' end
    when num then (case when x < 0 then '-' else '+' end) || substr(d1::varchar, 1, 1) || '.' || substr(d1::varchar, 2, 2) || 'e' || e1::varchar
    when t = '' then '<empty>'
    when length(t) > 64 then '<long ' || (case when regexp_matches(t, '\\p{{Lu}}') then 'A' else '' end) || (case when regexp_matches(t, '\\p{{Ll}}') then 'a' else '' end) || (case when regexp_matches(t, '[0-9]') then '9' else '' end) || (case when regexp_matches(t, '\\p{{Lo}}') then 'W' else '' end) || ' 2^' || floor(log2(length(t)))::int::varchar || '>'
    else regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[0-9]', '9', 'g'), '\\p{{Lu}}', 'A', 'g'), '\\p{{Ll}}', 'a', 'g'), '\\p{{Lo}}', 'W', 'g') end as mask
  from f),
counts as (select segment, load_id, field, num, mask, count(*) as n, min(x) as lo, max(x) as hi from masked group by all)
"""
_DEPARTURES = _MASKED + """,
up as (
  select segment, load_id, field, n, unnest([0, 1, 2, 3, 4]) as level, unnest([0.09, 0.13, 0.2, 0.235, 0.23]::double[]) as floor,
    unnest(case when mask not like '%e%' or mask like '%<%' then [mask, mask, mask, mask, mask]
      else [substr(mask, 1, 1), substr(mask, 1, 1) || substr(mask, 6), substr(mask, 1, 2) || substr(mask, 6), substr(mask, 1, 4) || substr(mask, 6), mask] end) as mask
  from counts where num
  union all
  select segment, load_id, field, n, unnest([0, 1, 2]), unnest([0.09, 0.13, 0.13]::double[]),
    unnest([case when mask in ('<null>', '<empty>') then mask else '<text>' end,
      case when mask like '<long %' then regexp_replace(mask, ' 2\\^.*', '>') else regexp_replace(regexp_replace(regexp_replace(regexp_replace(mask, 'A+', 'A', 'g'), 'a+', 'a', 'g'), '9+', '9', 'g'), 'W+', 'W', 'g') end, mask])
  from counts where not num),
l as (select segment, load_id, field, level, floor, mask, sum(n)::double as n from up group by all),
t as (
  select * replace (floor * sqrt(greatest(1.0, 30 / sum(n) over (partition by segment, load_id, field, level))) as floor), n / sum(n) over (partition by segment, load_id, field, level) as x,
    (sum(n) over (partition by segment, field, level, mask) - n) / nullif(sum(n) over (partition by segment, field, level) - sum(n) over (partition by segment, load_id, field, level), 0) as y
  from l),
g as (
  select segment, load_id, field, level, floor,
    case when count(y) > 0 then sum(x * log2(2 * x / (x + y)) / 2 + case when y > 0 then y * log2(2 * y / (x + y)) / 2 else 0 end) + (1 - sum(y)) / 2 end as div,
    case when count(y) > 0 then sum(case when y >= 0.02 then 0.0 else x end) end as rare
  from t group by all),
u as (
  select segment, field, level, quantile_disc(div, 0.25) as d1, quantile_disc(div, 0.5) as d2, quantile_disc(rare, 0.25) as r1, quantile_disc(rare, 0.5) as r2 from g group by all),
o as (
  select g.*, greatest(div - d2 - greatest(floor, (d2 - d1) / 0.6745 * 4), case when g.level <= 2 then rare - r2 - greatest(0.3, (r2 - r1) / 0.6745 * 4) end) as o
  from g join u on g.segment is not distinct from u.segment and g.field = u.field and g.level = u.level),
far as (select *, row_number() over (partition by segment, load_id, field order by coalesce(o, -9.0) desc, level desc) as k from o),
departures as (select segment, load_id, field, div as mask_div, rare as rare_share, level, coalesce(o > 0, false) as departs from far where k = 1)
"""

P1_MASKS = _MASKED + "select segment, load_id, field, mask, n from counts"

P1 = _DEPARTURES + "select distinct load_id, field from departures where departs and field in ('completeness.coverage', 'quality.error_rate', 'quality.quarantine_count', 'data_version')"

P1_STATISTICS = _DEPARTURES + """,
c as (
  select *, sum(case when lo is not null then n end) over (partition by segment, load_id, field order by lo nulls last, mask rows between unbounded preceding and current row) as below,
    sum(case when lo is not null then n end) over (partition by segment, load_id, field) as tot, case when lo is not null then (lo + hi) / 2 end as mid
  from counts),
s as (
  select segment, load_id, field, sum(n)::bigint as n_rows, sum(case when mask = '<null>' then n else 0 end) / sum(n) as null_share, sum(case when num and mask = '<nan>' then n else 0 end) / sum(n) as nan_share,
    sum(case when num and mask = '0' then n else 0 end) / sum(n) as zero_share, sum(case when num and mask like '-%' then n else 0 end) / sum(n) as neg_share, max(n) / sum(n) as top_share,
    min(lo) as mn, min(case when below >= ceil(tot * 0.25) then mid end) as q1, min(case when below >= ceil(tot * 0.5) then mid end) as med, min(case when below >= ceil(tot * 0.75) then mid end) as q3, max(hi) as mx,
    list(mask order by n desc, mask)[1] as top_mask
  from c group by all)
select s.segment, s.load_id, s.field, n_rows, round(null_share, 6) as null_share, round(nan_share, 6) as nan_share, round(zero_share, 6) as zero_share, round(neg_share, 6) as neg_share, round(top_share, 6) as top_share,
  round(mn, 6) as "min", round(q1, 6) as q1, round(med, 6) as med, round(q3, 6) as q3, round(mx, 6) as "max", round(mask_div, 6) as mask_div, round(rare_share, 6) as rare_share, level, departs, top_mask
from s join departures d on s.segment is not distinct from d.segment and s.load_id is not distinct from d.load_id and s.field = d.field
"""

P4 = """
with d as (
  select regexp_extract(ts_code, '[0-9]{6}') as digits, trade_date, open, high, low, close from (
    select *, row_number() over (partition by regexp_extract(ts_code, '[0-9]{6}'), trade_date order by loaded_at desc, open desc, high desc, low desc, close desc) as rn from daily) where rn = 1),
m as (
  select digits, trade_date, open, high, low, close from (
    select *, row_number() over (partition by digits, trade_date order by loaded_at desc, open desc, high desc, low desc, close desc) as rn from (
      select regexp_extract(ts_code, '[0-9]{6}') as digits, strptime(regexp_replace(trim(trade_date), '[^0-9]', '', 'g'), '%Y%m%d')::date as trade_date, open, high, low, close, loaded_at from daily_mirror)) where rn = 1),
names as (
  select regexp_extract(ts_code, '[0-9]{6}') as digits, max(regexp_extract(upper(ts_code), '(SZ|SH|BJ)', 1)) as ex
  from (select ts_code from daily union all select ts_code from daily_mirror) group by 1),
j as (
  select coalesce(d.digits, m.digits) as digits, coalesce(d.trade_date, m.trade_date) as day, d.digits is null as no_d, m.digits is null as no_m,
    d.open as o1, m.open as o2, d.high as h1, m.high as h2, d.low as l1, m.low as l2, d.close as c1, m.close as c2
  from d full join m on d.digits = m.digits and d.trade_date = m.trade_date),
cells as (
  select digits, day, 'missing_in_mirror' as field from j where no_m union all
  select digits, day, 'missing_in_daily' from j where no_d union all
  select digits, day, 'open' from j where not no_d and not no_m and ((o1 is null) <> (o2 is null) or abs(o1 - o2) > 0.005 + 1e-9 * 0.005 + greatest(abs(o1), abs(o2)) * 4e-16) union all
  select digits, day, 'high' from j where not no_d and not no_m and ((h1 is null) <> (h2 is null) or abs(h1 - h2) > 0.005 + 1e-9 * 0.005 + greatest(abs(h1), abs(h2)) * 4e-16) union all
  select digits, day, 'low' from j where not no_d and not no_m and ((l1 is null) <> (l2 is null) or abs(l1 - l2) > 0.005 + 1e-9 * 0.005 + greatest(abs(l1), abs(l2)) * 4e-16) union all
  select digits, day, 'close' from j where not no_d and not no_m and ((c1 is null) <> (c2 is null) or abs(c1 - c2) > 0.005 + 1e-9 * 0.005 + greatest(abs(c1), abs(c2)) * 4e-16))
select concat_ws('.', nullif(cells.digits, ''), nullif(ex, '')) as ts_code, (year(day) * 10000 + month(day) * 100 + day(day))::bigint as ymd, field from cells left join names on cells.digits is not distinct from names.digits
"""

P4_ALL = P4
for _f, _c in (("open", "o"), ("high", "h"), ("low", "l"), ("close", "c")):
    P4_ALL = P4_ALL.replace(f"'{_f}' from j", f"'{_f}', {_c}1, {_c}2 from j")
P4_ALL = P4_ALL.replace("'missing_in_mirror' as field from j", "'missing_in_mirror' as field, null::double as left_value, null::double as right_value from j").replace("'missing_in_daily' from j", "'missing_in_daily', null, null from j").replace("::bigint as ymd, field from cells", "::bigint as ymd, field, left_value, right_value from cells")

P6 = """
with e as (select row_id, ts_code, trade_date, trade_date::timestamp + interval 15 hour as t from daily),
k as (select distinct ts_code, trade_date, t from e),
a as (
  select k.ts_code, k.trade_date, x.adj_id, row_number() over (partition by k.ts_code, k.trade_date order by x.trade_date desc, x.known_at desc, x.adj_id desc) as rn
  from k join adj_factor x on x.ts_code = k.ts_code and x.trade_date <= k.trade_date and x.known_at <= k.t and x.adj_factor > 0 and isfinite(x.adj_factor)),
f as (
  select k.ts_code, k.trade_date, x.fund_id, row_number() over (partition by k.ts_code, k.trade_date order by x.updated_date desc, x.known_at desc, x.fund_id desc) as rn
  from k join fundamentals x on x.ts_code = k.ts_code and x.updated_date <= k.trade_date and x.known_at <= k.t)
select e.row_id, coalesce(a.adj_id, 0)::bigint as adj_id, coalesce(f.fund_id, 0)::bigint as fund_id
from e left join a on a.ts_code = e.ts_code and a.trade_date = e.trade_date and a.rn = 1
left join f on f.ts_code = e.ts_code and f.trade_date = e.trade_date and f.rn = 1
"""

P7_DAYS = """
with r as (select ts_code, trade_date as day, vol as v, close as c, row_number() over (partition by ts_code, trade_date order by loaded_at desc nulls last, row_id desc) as k from daily),
p as (select ts_code, day, v, c from r where k = 1),
s as (select ts_code, min(day) as lo, max(day) as hi from p group by 1),
g as (select ts_code, unnest(generate_series(lo, hi, interval 1 day))::date as day from s),
x as (select g.ts_code, g.day, coalesce(p.v, 0) as v, p.c from g left join p on p.ts_code = g.ts_code and p.day = g.day)
select ts_code, day, sum(v) over w7 as t7, sum(v) over w30 as t30, count(c) over w7 as n7, count(c) over w30 as n30, avg(c) over w7 as a7, avg(c) over w30 as a30 from x
window w7 as (partition by ts_code order by day rows between 6 preceding and current row), w30 as (partition by ts_code order by day rows between 29 preceding and current row)
"""

P7 = f"select ts_code, (year(day) * 10000 + month(day) * 100 + day(day))::bigint as ymd from ({P7_DAYS}) where t7 = 0 and t30 > 0"

P7_ALL = f"select ts_code, day as trade_date, round(t7, 4) as total_7, n7::int as n_7, round(a7, 6) as avg_7, round(t30, 4) as total_30, n30::int as n_30, round(a30, 6) as avg_30 from ({P7_DAYS})"
