"""The N best items of every group, with one defined order among equals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """The number, or null for NaN and infinities; -0.0 becomes 0.0, as both are equal."""
    x = c.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), F.when(x == 0, 0.0).otherwise(x))


def latest_version(df: DataFrame, key: Sequence[str], version: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Of each key the row with the greatest `version`; ties by the kept values.

    A map-side combined aggregation, so revisions of a hot key never meet in one sort.
    """
    best = F.max(F.struct(*version, *[c for c in keep if c not in version])).alias("_b")
    return df.groupBy(*key).agg(best).select(*key, *[F.col(f"_b.{c}").alias(c) for c in keep])


def top_n(df: DataFrame, group: Sequence[str], score: str, tie: Sequence[str], n: int) -> DataFrame:
    """Rows of rank 1..n in each group by score descending, then `tie` ascending, with the column rank.

    Exactly equal scores are in the order of `tie` (nulls last); rows with a null, NaN or
    infinite score are left out; null group values form a group like any other;
    groups with fewer rows come whole, an empty table gives none. Equal rows in all of these keep
    an order among each other by their remaining columns only if `tie` is unique in the group.
    row_number with a rank filter becomes a group limit that prunes map-side before the
    shuffle and again after it, so a group of any size sends at most n rows per task.
    """
    w = Window.partitionBy(*group).orderBy(F.col("_score").desc(), *[F.col(c).asc_nulls_last() for c in tie])
    d = df.withColumn("_score", finite(F.col(score))).where("_score is not null")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).drop("_score")
