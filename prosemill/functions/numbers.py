"""Guarded statistics over arrays inside one row, and scalar formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom``, 0 where the bottom is 0."""
    return F.when(bottom == 0, 0.0).otherwise(top / F.when(bottom != 0, bottom))


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def mean_sd(values: Column) -> Column:
    """struct(n, mean, sd) of an array of doubles: sample deviation, 0 below two values."""
    mean = lambda v: F.when(F.size(v) == 0, 0.0).otherwise(array_sum(v) / F.size(v))
    spread = lambda v, m: F.when(F.size(v) < 2, 0.0).otherwise(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / (F.size(v) - 1)))
    return let(F.coalesce(values, F.array().cast("array<double>")), lambda v: let(mean(v), lambda m: F.struct(F.size(v).alias("n"), m.alias("mean"), spread(v, m).alias("sd"))))


def perplexity(mean_logprob: Column) -> Column:
    """exp(-mean), clamped; 0 without a mean."""
    return F.when(mean_logprob.isNull(), 0.0).otherwise(F.exp(F.least(-mean_logprob, F.lit(20.0))))


def sigmoid(x: Column) -> Column:
    return F.when(x.isNotNull(), 1.0 / (1.0 + F.exp(-F.greatest(F.least(x, F.lit(30.0)), F.lit(-30.0)))))


def rounded(x: Column, digits: int) -> Column:
    """Halves away from zero, of the binary product with a power of ten, as the SQL's ``round`` has it; ``F.round`` takes the shortest decimal."""
    return F.round(x * 10.0**digits, 0) / 10.0**digits


def round_even(x: Column, digits: int) -> Column:
    """Half-even rounding of the exact binary value's shortest decimal."""
    return F.bround(x, digits)
