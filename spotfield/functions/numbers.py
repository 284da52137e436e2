"""Null-safe numbers: NULL stands for missing everywhere, NaN never leaves an operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16


def finite(c: Column) -> Column:
    """The value, or NULL where it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def safe_corr(a: str, b: str) -> Column:
    """Pearson correlation over rows with both values; NULL under 3 rows or without spread."""
    x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when((F.count(x) >= 3) & (F.stddev_pop(x) > 1e-12) & (F.stddev_pop(y) > 1e-12), F.try_divide(F.covar_pop(x, y), spread))


def percentile(c: str, q: float) -> Column:
    return F.expr(f"percentile({c}, {q})")


def average_rank(value: str, keys: list[str]) -> Column:
    """Rank from 1, ties averaged."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, value)) - 1) / 2


def with_bh(rows: DataFrame, p: str, q: str, keys: list[str]) -> DataFrame:
    """Adds Benjamini-Hochberg q: p m / rank, running minimum from the largest, at most 1; NULLs stay and don't count.
    Equal p's take the rank of the last of them, so their order has no effect."""
    per = Window.partitionBy(*keys)
    up = per.orderBy(F.col(p).asc_nulls_last()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    down = per.orderBy(F.col(p).desc_nulls_first()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__raw", F.col(p) * F.count(p).over(per) / F.count(p).over(up))
    return rows.withColumn(q, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("__raw").over(down)))).drop("__raw")
