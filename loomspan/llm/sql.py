"""DuckDB SQL of this package's queries, over the whole tables."""

P2 = """
with v as (
  select factor, date, code, signal, row_number() over (partition by factor, date, code order by loaded_at desc, row_id desc) as rn from signal_panel),
r as (
  select factor, date, code, row_number() over (partition by factor, date order by signal desc, code asc) as k
  from v where rn = 1 and signal is not null and not isnan(signal) and not isinf(signal))
select factor, (year(date) * 10000 + month(date) * 100 + day(date))::bigint as ymd, code from r where k <= 5
"""
