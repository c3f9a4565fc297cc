"""Differences between two copies of a dataset, field by field.

Both sides are unpivoted to (key, field, value) cells, a cell of the first
copy counting +1 and one of the second -1. Equal cells cancel in one
map-side combined aggregation; what is left are the differences. No join is
made, so neither side needs to fit anywhere and a hot key spreads over its
fields and combines before the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_rows(df: DataFrame, key: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Of each key the row with the greatest `order` (nulls lowest); ties are settled by the values.

    An aggregation rather than a window: repeats combine before the shuffle.
    """
    best = F.max(F.struct(*[F.col(c) for c in order], *[F.col(c) for c in values if c not in order])).alias("_best")
    return df.groupBy(*key).agg(best).select(*key, *[F.col(f"_best.{c}").alias(c) for c in values])


def compare(
    left: DataFrame,
    right: DataFrame,
    key: Sequence[str],
    fields: Sequence[str],
    tolerance: Mapping[str, float] | float = 0.0,
    order: Sequence[str] = (),
    names: tuple[str, str] = ("left", "right"),
) -> DataFrame:
    """Cells and keys that do not cancel: (key..., field, left_value, right_value).

    Of several rows of a key only the latest by `order` counts (with no order:
    the greatest by values). Numbers within `tolerance` (or exactly that far apart, but for
    rounding in the last places) are equal, null equals null, NaN is null. A key on
    one side only gives one row with field missing_in_<other>. Rows with a null
    in the key are matched like any other value. Extra columns are ignored; a
    key or field named like one of the internal columns is safe, as those begin
    with an underscore. Two empty tables give no rows.
    """
    tol = tolerance if isinstance(tolerance, Mapping) else dict.fromkeys(fields, tolerance)
    clean = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))

    def cells(df: DataFrame, sign: int) -> DataFrame:
        df = df.select(*key, *[clean(c).alias(c) for c in fields], *[F.col(c) for c in order if c not in key and c not in fields])
        one = latest_rows(df, key, order, fields)
        every = [F.struct(F.lit(None).cast("string").alias("_field"), F.lit(None).cast("double").alias("_x"))]
        every += [F.struct(F.lit(c).alias("_field"), F.col(c).alias("_x")) for c in fields]
        return one.select(*key, F.lit(sign).alias("_sign"), F.explode(F.array(*every)).alias("_c")).select(*key, "_c._field", "_c._x", "_sign")

    both = cells(left, 1).unionByName(cells(right, -1))
    side = lambda s: F.max(F.when(F.col("_sign") == s, F.col("_x")))
    # a key's presence cell and its fields in one row: the signed counts of all fields side by side
    per = both.groupBy(*key, "_field").agg(F.sum("_sign").alias("_net"), side(1).alias("_l"), side(-1).alias("_r"), F.count(F.lit(1)).alias("_n"))

    def differs() -> Column:
        lim = F.lit(None).cast("double")
        for c in fields:
            lim = F.when(F.col("_field") == c, F.lit(float(tol.get(c, 0.0)))).otherwise(lim)
        l, r = F.col("_l"), F.col("_r")
        slack = lim + F.greatest(F.abs(l), F.abs(r)) * 4e-16 + lim * 1e-9
        return (l.isNull() != r.isNull()) | F.coalesce(F.abs(l - r) > slack, F.lit(False))

    one_sided = F.col("_field").isNull() & (F.col("_net") != 0)
    changed = F.col("_field").isNotNull() & (F.col("_n") == 2) & differs()
    field = F.when(F.col("_field").isNotNull(), F.col("_field")).when(F.col("_net") > 0, f"missing_in_{names[1]}").otherwise(f"missing_in_{names[0]}")
    return per.where(one_sided | changed).select(*key, field.alias("field"), F.col("_l").alias("left_value"), F.col("_r").alias("right_value"))
