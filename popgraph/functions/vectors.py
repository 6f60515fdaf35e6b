"""Vector columns: norms, cosine, and element-wise sums over groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(as_double(v))


def safe_cosine(a: Column, b: Column) -> Column:
    """Cosine clamped to [0, 1]; 0 when a vector is missing, zero or not a number."""
    d = norm(a) * norm(b)
    c = F.when(d > 0, dot(a, b) / d)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))))


def vector_sums(df: DataFrame, keys: list[str], value: str, dim: int, weight: Column | None = None) -> DataFrame:
    """Element-wise weighted sum of vectors per key.

    One sum per element lets Spark combine inside each task before the shuffle, so a hub that
    receives a vector from a third of all rows gets one partial vector per task.
    """
    w = weight if weight is not None else F.lit(1.0)
    sums = df.groupBy(*keys).agg(*[F.sum(F.get(value, F.lit(i)) * w).alias(f"__s{i}") for i in range(dim)])
    return sums.select(*keys, F.array(*[F.col(f"__s{i}") for i in range(dim)]).alias(value))


def lexical_similarity(text: Column, item: Column) -> Column:
    """1 when the item occurs in the text, else the share of its distinct characters found there."""
    def squash(c):
        return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", "")

    def chars(c):
        return F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))

    a, b = squash(text), squash(item)
    share = F.size(F.array_intersect(chars(a), chars(b))) / F.size(chars(b))
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(a.contains(b), F.lit(1.0)).otherwise(share)
