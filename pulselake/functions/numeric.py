"""Column builders for numbers, the same in batch and streaming plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, places: int = 4) -> Column:
    """Half up at `places` decimals, without negative zero. What misses a half by an error of summation counts as the half,
    so that the value doesn't depend on the order in which a sum was added up."""
    return F.floor(x * 10.0**places + 0.500001) / 10.0**places + F.lit(0.0)


def settled(x: Column) -> Column:
    """x without errors of summation (at 11 decimals), for limits: a mean of 50 is 50 in whatever order it was added up."""
    return F.round(x, 11)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def finite(x: Column) -> Column:
    """x, null where it is NaN or infinite (Spark orders NaN above all numbers)."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def sum_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def mean_of(values: Column) -> Column:
    return ratio(sum_of(values), F.size(values).cast("double"))


def dot(a: Column, b: Column) -> Column:
    return sum_of(F.zip_with(a, b, lambda x, y: x * y))


def std_of(values: Column) -> Column:
    """Population standard deviation of an array, in two passes."""
    return F.get(F.transform(F.array(mean_of(values)), lambda m: F.sqrt(mean_of(F.transform(values, lambda v: (v - m) * (v - m))))), F.lit(0))


def epoch(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp with or without zone."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def corr(a: Column, b: Column) -> Column:
    """Pearson correlation as an aggregate; null (not an error) where a side doesn't vary."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
