"""Tables kept between runs: a cache of read results and a store of factor panels, on any file system Spark writes."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all: written beside its place, then renamed."""
    fs, p = _fs(spark, path)
    _, tmp = _fs(spark, f"{path}.tmp")
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(p, False)
    if not fs.rename(tmp, p):
        raise OSError(f"cannot rename to {path}")


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    f = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(f)).decode()
    finally:
        f.close()


def fingerprint(df: DataFrame, *more: object) -> str:
    """Digest of what a table is read from (files, sizes, times), its schema and `more`."""
    spark = df.sparkSession
    files = []
    for name in sorted(df.inputFiles()):
        fs, p = _fs(spark, name)
        s = fs.getFileStatus(p)
        files.append((name, s.getLen(), s.getModificationTime()))
    return hashlib.sha256(json.dumps([files, df.schema.json(), [str(m) for m in more]]).encode()).hexdigest()[:32]


def cached(df: DataFrame, folder: str, *key: object) -> DataFrame:
    """`df` from the cache in `folder`, stored there first if it is not; `key`: what tells this query from others on the same files.

    An entry counts once its write is complete. A changed source file gives another entry.
    """
    spark = df.sparkSession
    path = f"{folder}/{fingerprint(df, *key)}"
    if not exists(spark, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def prune(spark: SparkSession, folder: str, max_age_s: float | None = None, max_bytes: int | None = None) -> list[str]:
    """Removes cache entries older than `max_age_s`, then the oldest until at most `max_bytes` are left; returns their names."""
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return []
    entries = sorted(((s.getModificationTime() / 1000, s.getPath(), fs.getContentSummary(s.getPath()).getLength()) for s in fs.listStatus(p)), key=lambda e: e[0])
    total, gone = sum(e[2] for e in entries), []
    for at, where, size in entries:
        if (max_age_s is not None and time.time() - at > max_age_s) or (max_bytes is not None and total > max_bytes):
            fs.delete(where, True)
            total -= size
            gone.append(where.getName())
    return gone


class PanelStore:
    """Factor panels under <root>/<factor>: (date, code, columns...)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def factors(self) -> list[str]:
        fs, p = _fs(self.spark, self.root)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []

    def write(self, factor: str, df: DataFrame) -> None:
        """Replaces the months that `df` has."""
        d = df.withColumn("month", F.date_format("date", "yyyyMM"))
        d.repartition("month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(f"{self.root}/{factor}")

    def load(self, factor: str, start=None, end=None, columns: Sequence[str] | None = None) -> DataFrame:
        d = self.spark.read.parquet(f"{self.root}/{factor}")
        for lim, op in ((start, ">="), (end, "<=")):
            if lim is not None:
                d = d.where(F.expr(f"date {op} date '{lim}'"))
                d = d.where(F.expr(f"cast(month as string) {op} date_format(date '{lim}', 'yyyyMM')"))  # prunes partitions
        return d.select("date", "code", *columns) if columns else d.drop("month")

    def dates(self, factor: str) -> DataFrame:
        return self.load(factor).select("date").distinct().orderBy("date")

    def aligned(self, factors: Sequence[str], column: str = "signal", start=None, end=None) -> DataFrame:
        """(date, code, one column a factor) over the keys that all of them have."""
        out = None
        for f in factors:
            one = self.load(f, start, end, [column]).withColumnRenamed(column, f)
            out = one if out is None else out.join(one, ["date", "code"])
        return out
