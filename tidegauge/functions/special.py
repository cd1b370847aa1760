"""Tails of the normal and chi-square distributions as expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: From here on the continued fraction serves, below it the series; and terms of each.
FAR, TERMS = 2.5, 96


def erfc(x: Column) -> Column:
    """The complementary error function; null stays null and NaN stays NaN.

    Below ``FAR``: 1 - 2 x exp(-x^2) / sqrt(pi) * sum of (2 x^2)^k / (1 * 3 * ... * (2 k + 1)), all
    of one sign.  From there: exp(-x^2) / sqrt(pi) over x + (1/2) / (x + (2/2) / (x + (3/2) / ...)), from
    its end.
    """
    y = F.abs(x)
    steps = F.sequence(F.lit(1), F.lit(TERMS))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(held: Column, k: Column) -> Column:
        term = held["term"] * 2 * y * y / (2 * k + 1)
        return F.struct(term.alias("term"), (held["sum"] + term).alias("sum"))

    near = 1 - 2 / math.sqrt(math.pi) * y * F.exp(-y * y) * F.aggregate(steps, start, add, lambda held: held["sum"])
    back = F.aggregate(F.sequence(F.lit(TERMS), F.lit(1)), y, lambda held, k: y + k / 2 / held)
    far = F.exp(-y * y) / math.sqrt(math.pi) / back
    tail = F.when(F.isnan(x), x).when(y < FAR, near).when(y > 30, 0.0).otherwise(far)
    return F.when(x < 0, 2 - tail).otherwise(tail)


def chi_square_survival(statistic: Column, degrees: Column) -> Column:
    """P(X >= statistic) for a chi-square of whole degrees; null where they are not
    positive, an error for a statistic that is negative or not finite.

    With z half the statistic: Q(1/2, z) = erfc(sqrt z), Q(1, z) = exp(-z), and Q(a + 1, z) = Q(a, z) +
    z^a exp(-z) / Gamma(a + 1); the logarithm of Gamma grows with the sum.
    """
    z, odd = statistic / 2, degrees % 2 == 1
    first = F.when(odd, 0.5).otherwise(1.0)
    start = F.struct(F.when(odd, erfc(F.sqrt(z))).otherwise(F.exp(-z)).alias("tail"), F.when(odd, math.lgamma(1.5)).otherwise(0.0).alias("gamma"), first.alias("a"))

    def add(held: Column, _: Column) -> Column:
        a = held["a"]
        return F.struct((held["tail"] + F.exp(a * F.ln(z) - z - held["gamma"])).alias("tail"), (held["gamma"] + F.ln(a + 1)).alias("gamma"), (a + 1).alias("a"))

    more = F.ceil(degrees / 2) - 1
    steps = F.when(more > 0, F.sequence(F.lit(1).cast("long"), F.greatest(more, F.lit(1)))).otherwise(F.array().cast("array<bigint>"))
    tail = F.when(z == 0, 1.0).otherwise(F.least(F.lit(1.0), F.aggregate(steps, start, add, lambda held: held["tail"])))
    wrong = F.isnan(statistic) | (F.abs(statistic) == float("inf")) | (statistic < 0)
    return F.when(statistic.isNotNull() & (degrees > 0), F.when(wrong, F.raise_error(F.lit("chi-square needs a finite statistic of at least 0")).cast("double")).otherwise(tail))
