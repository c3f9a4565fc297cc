"""Reads and writes of facts: partitioned parquet, text grids, market scans, artefacts."""

from __future__ import annotations

import difflib
import hashlib
import json
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.sources import store


class Catalog:
    """Tables of a lake by name: <root>/<name> or <root>/<name>.parquet, read as parquet."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def tables(self) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName().removesuffix(".parquet") for s in fs.listStatus(path) if not s.getPath().getName().startswith(("_", ".")))

    def read(self, name: str) -> DataFrame:
        if name not in self.tables():
            near = difflib.get_close_matches(name, self.tables(), 3)
            raise KeyError(f"no table {name!r}" + (f"; did you mean {', '.join(near)}?" if near else ""))
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return self.spark.read.parquet(f"{self.root}/{name}" + ("" if fs.exists(path) else ".parquet"))

    def columns(self, name: str) -> list[str]:
        return self.read(name).columns

    def supply(self, wanted: Iterable[str], tables: Sequence[str]) -> dict[str, str]:
        """Column -> the first of `tables` that has it; unknown columns are an error with suggestions."""
        have = {t: self.columns(t) for t in tables}
        out = {}
        for c in wanted:
            for t in tables:
                if c in have[t]:
                    out[c] = t
                    break
            else:
                near = difflib.get_close_matches(c, sorted({x for v in have.values() for x in v}), 3)
                raise KeyError(f"no table has column {c!r}" + (f"; did you mean {', '.join(near)}?" if near else ""))
        return out


def between(df: DataFrame, day: str, start=None, end=None, codes: Sequence[str] | None = None, code: str = "ts_code") -> DataFrame:
    """Pushed-down day and code filters."""
    if start is not None:
        df = df.where(F.col(day) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(day) <= F.lit(end))
    if codes is not None:
        df = df.where(F.col(code).isin(list(codes)))
    return df


def restrict(df: DataFrame, codes: DataFrame, code: str = "ts_code") -> DataFrame:
    """Rows whose code is in a code table."""
    return df.join(codes.select(code).distinct(), code, "left_semi")


def load_daily(cat: Catalog, columns: Sequence[str], start=None, end=None, codes: Sequence[str] | None = None, fact: str = "daily", extra: Sequence[str] = (), adj: str | None = None) -> DataFrame:
    """The daily fact with the wanted columns; a table of `extra` is joined only if a column of it is wanted.

    Every row of the fact stays one row: of a key that an extra table repeats, each column's greatest value counts.
    adj: the table of adjustment factors, joined inner on its key. Only referenced columns are read.
    """
    own = cat.columns(fact)
    need = cat.supply([c for c in columns if c != "adj_factor"], [fact, *extra])
    key = ["ts_code", "trade_date"]
    df = between(cat.read(fact), "trade_date", start, end, codes).select(*key, *[c for c in columns if c in own and c not in key])
    if adj is not None:
        df = df.join(between(cat.read(adj), "trade_date", start, end, codes).select(*key, "adj_factor"), key)
    for t in extra:
        cs = [c for c, s in need.items() if s == t and c not in own]
        if cs:
            side = between(cat.read(t), "trade_date", start, end, codes).groupBy(*key).agg(*[F.max(c).alias(c) for c in cs])
            df = df.join(side, key, "left")
    return df


def code_attributes(df: DataFrame, columns: Sequence[str], code: str = "ts_code") -> DataFrame:
    """One row per code; empty text is null."""
    t = dict(df.dtypes)
    return df.groupBy(code).agg(*[F.max(F.when(F.col(c) != "", F.col(c)) if t[c] == "string" else F.col(c)).alias(c) for c in columns])


def ms_of_day(hhmmssmmm: Column) -> Column:
    """Milliseconds of the day of an HHMMSSmmm integer; null if it is no time."""
    x = hhmmssmmm.cast("long")
    h, m, s, ms = F.floor(x / 10_000_000), F.floor(x / 100_000) % 100, F.floor(x / 1000) % 100, x % 1000
    return F.when((x >= 0) & (h < 24) & (m < 60) & (s < 60), (h * 3600 + m * 60 + s) * 1000 + ms).cast("int")


def write_monthly(df: DataFrame, path: str, day: str) -> None:
    """Parquet by year and month; only the partitions in `df` are replaced."""
    d = df.withColumn("year", F.year(day)).withColumn("month", F.month(day))
    d.repartition("year", "month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "month").parquet(path)


def read_month(spark: SparkSession, path: str, year: int, month: int, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path).where((F.col("year") == year) & (F.col("month") == month))
    return df.select(*columns) if columns else df


def _allow(spark: SparkSession, encoding: str) -> None:
    """Charsets beyond the built-in few need the session's leave."""
    if encoding.lower() not in ("utf-8", "utf-16", "utf-16be", "utf-16le", "utf-32", "iso-8859-1", "us-ascii"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def read_ticks(spark: SparkSession, path: str, schema, encoding: str = "GBK") -> DataFrame:
    """CSV in an encoding, malformed lines as nulls; prices stay integers."""
    _allow(spark, encoding)
    return spark.read.csv(path, schema=schema, header=True, encoding=encoding, mode="PERMISSIVE")


AMOUNT = {"亿": 1e8, "万": 1e4, "": 1.0}  # fixed values: suffixes of amounts in text grids


def amount_text(c: Column) -> Column:
    """1.2亿, -3.4万, 56 as a number."""
    t = F.regexp_replace(F.trim(c), ",", "")
    num = F.regexp_extract(t, r"^([+-]?[0-9]+(?:\.[0-9]+)?)\s*(亿|万)?$", 1)
    unit = F.regexp_extract(t, r"^([+-]?[0-9]+(?:\.[0-9]+)?)\s*(亿|万)?$", 2)
    k = F.when(unit == "亿", AMOUNT["亿"]).when(unit == "万", AMOUNT["万"]).otherwise(1.0)
    return F.when(num != "", num.cast("double") * k)


def read_grid(spark: SparkSession, path: str, names: Mapping[str, str], encoding: str = "GBK", sep: str = "\t") -> DataFrame:
    """A text grid with a header: wanted headers -> names, values by amount_text where they parse, else text."""
    _allow(spark, encoding)
    raw = spark.read.csv(path, sep=sep, header=True, encoding=encoding)
    return raw.select(*[F.trim(F.col(f"`{h}`")).alias(n) for h, n in names.items() if h in raw.columns])


def write_artifact(df: DataFrame, folder: str, meta: Mapping[str, object], parts: Mapping[str, DataFrame] | None = None) -> dict:
    """Signal parquet (and further tables by name: labels, panel), then the summary last: its presence marks a complete artefact.

    Any file system Spark writes. digest: of the signal's rows, whatever their order and files.
    """
    spark = df.sparkSession
    frames = {"signal": df, **(parts or {})}
    for name, one in frames.items():
        one.write.mode("overwrite").parquet(f"{folder}/{name}")
    back = spark.read.parquet(f"{folder}/signal")
    got = back.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*back.columns).cast("decimal(38,0)")).alias("h")).first()
    summary = {"version": 3, **meta, "parts": sorted(frames), "rows": got["n"], "digest": hashlib.sha256(f"{back.schema.json()}|{got['n']}|{got['h']}".encode()).hexdigest()}
    store.write_text(spark, f"{folder}/summary.json", json.dumps(summary, sort_keys=True, default=str))
    return summary


def read_artifact(spark: SparkSession, folder: str, part: str = "signal") -> tuple[DataFrame, dict]:
    if not store.exists(spark, f"{folder}/summary.json"):
        raise FileNotFoundError(f"{folder} holds no complete artefact")
    return spark.read.parquet(f"{folder}/{part}"), json.loads(store.read_text(spark, f"{folder}/summary.json"))


def quota(df: DataFrame, by: str, n: int, order: Column) -> DataFrame:
    """Every ceil(size / n)-th row of each group: a stride sample of at most n rows."""
    from pyspark.sql import Window

    w = Window.partitionBy(by)
    d = df.withColumn("_r", F.row_number().over(w.orderBy(order)) - 1).withColumn("_k", F.ceil(F.count(F.lit(1)).over(w) / n))
    return d.where(F.col("_r") % F.col("_k") == 0).drop("_r", "_k")


def snapshot(df: DataFrame, at, available: str, order: Sequence[str], code: str = "ts_code") -> DataFrame:
    """The latest row of each code that was available at a date."""
    rest = [c for c in df.columns if c not in (code, *order)]
    best = F.max(F.struct(*order, *rest)).alias("_b")
    return df.where(F.col(available) <= F.lit(at)).groupBy(code).agg(best).select(code, "_b.*")


def minute_coverage(bars: DataFrame, code: str = "code", date: str = "date", full: int = 240) -> DataFrame:
    """Days, complete days and fewest minutes of a day, per code."""
    per = bars.groupBy(code, date).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(code).agg(F.count(F.lit(1)).alias("days"), F.count_if(F.col("n") >= full).alias("full_days"), F.min("n").alias("fewest"))


def market_open(codes: DataFrame, daily: DataFrame, limits: DataFrame, suspended: DataFrame, day, code: str = "code", date: str = "date", least: float = 0.5) -> DataFrame:
    """Evidence at an open: prices, limits and suspensions of a day for every code asked for.

    A day on which under `least` of the codes have a daily row is refused: its data are not there yet.
    """
    on = lambda d: d.where(F.col(date) == F.lit(day)).drop(date)
    out = codes.select(code).distinct()
    out = out.join(on(daily).withColumn("has_daily", F.lit(True)), code, "left").join(on(limits).withColumn("has_limit", F.lit(True)), code, "left")
    out = out.join(on(suspended).select(code).distinct().withColumn("is_suspended_at_open", F.lit(True)), code, "left").fillna(False, ["has_daily", "has_limit", "is_suspended_at_open"])
    share = out.agg(F.avg(F.col("has_daily").cast("double"))).first()[0]
    if share is not None and share < least:
        raise ValueError(f"{day}: only {share:.0%} of the codes have a daily row")
    return out
