"""Aggregate helpers whose tie and interpolation rules differ from the built-in ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_where(condition: Column) -> Column:
    """Rows that meet a condition, 0 for none."""
    return F.count_if(condition)


def sum_or_zero(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0.0))


#: Relative rank error of the sketch that finds where to look for a rank, and its accuracy.
RANK_SLACK, SKETCH = 0.002, 1000
#: Values of a key up to which the sketch's bounds are wider than the whole.
FEW = 2000


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, q: float, name: str = "value") -> DataFrame:
    """``keys, name``: the sorted value at index ``int(q * (n - 1) + 0.5)`` of each key, without interpolation; nulls do not count.

    A mergeable sketch bounds the place of that value; how many values lie below the bounds is counted, and only those
    within them are ordered. So no key's values meet in one row or task, and the answer is exact.
    """
    v = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    at = lambda share: F.percentile_approx("_v", min(1.0, max(0.0, share)), SKETCH)
    bounds = v.groupBy(*keys).agg(at(q - RANK_SLACK).alias("_lo"), at(q + RANK_SLACK).alias("_hi"), F.count("*").alias("_n"))
    same = [F.col(f"v.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    joined = v.alias("v").join(bounds.alias("b"), same).select(*[F.col(f"v.{k}").alias(k) for k in keys], "_v", "_lo", "_hi", "_n").where((F.col("_n") <= FEW) | (F.col("_v") <= F.col("_hi")))
    below = (F.col("_n") > FEW) & (F.col("_v") < F.col("_lo"))
    counts = joined.groupBy(*keys, F.when(~below, F.col("_v")).alias("_v")).agg(F.count("*").alias("_m"), F.max("_n").alias("_n"))
    upto = F.sum("_m").over(Window.partitionBy(*keys).orderBy(F.asc_nulls_first("_v")))
    index = F.floor(F.lit(q) * (F.col("_n") - 1) + 0.5)
    found = counts.withColumn("_upto", upto).where((F.col("_upto") > index) & F.col("_v").isNotNull() & (F.col("_upto") - F.col("_m") <= index))
    return found.select(*keys, F.col("_v").alias(name))


def mode_max(counts: Column) -> Column:
    """The most frequent value, on a tie the largest as text, from a max over ``struct(n, text, value)``."""
    return F.max(counts)


def rounded_median(value: Column, digits: int = 2) -> Column:
    return F.bround(F.median(value), digits)


def smoothed_confidence(hits: Column, n: Column) -> Column:
    """``(hits + 1) / (n + 2)``, so one of one is no certainty; null for no trial."""
    return F.when(n > 0, F.bround((hits + 1) / (n + 2), 2))


def ordered_list(order: Column, value: Column) -> Column:
    """Values of a group in order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"])
