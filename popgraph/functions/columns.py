"""Column helpers used throughout: cleaning, stable pseudo-random order, top-n."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def null_to_blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit(""))


def clean_list(c: Column) -> Column:
    """Trim the entries of a string array and drop blank ones; a missing list is empty."""
    trimmed = F.transform(c, lambda x: F.trim(x))
    return F.coalesce(F.filter(trimmed, lambda x: x != ""), F.array().cast("array<string>"))


def shuffle_key(*parts, seed: int = 42) -> Column:
    """Order that looks random yet is the same on every run and engine."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in cols], F.lit(str(seed))))


def ratio(num: Column, den: Column, digits: int = 4) -> Column:
    return F.round(F.when(den > 0, num / den).otherwise(F.lit(0.0)), digits)


def top_n(df: DataFrame, keys, order, n: int, rank: str = "rnk") -> DataFrame:
    """First n rows per key.

    Spark prunes each task's rows to n per key before the shuffle (WindowGroupLimit), so a key that
    holds a third of all rows sends only n rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def top_n_global(df: DataFrame, order, n: int, rank: str = "rnk") -> DataFrame:
    """First n rows of the whole table with their position; only n rows reach the ranking task."""
    short = df.orderBy(*order).limit(n)
    return short.withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def row_count(name: str = "cnt") -> Column:
    return F.count(F.lit(1)).alias(name)
