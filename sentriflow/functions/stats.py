"""Statistics of array columns, as built-in higher-order expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body and its lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _doubles(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def total(a: Column) -> Column:
    return F.aggregate(_doubles(a), F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    """Null for an empty array."""
    return F.try_divide(total(a), F.size(a))


def median(a: Column) -> Column:
    n = F.size(a)
    half = F.floor(n / 2).cast("int")
    middle = lambda s: F.when(n % 2 == 1, F.get(s, half)).otherwise((F.get(s, half - 1) + F.get(s, half)) / 2)
    return F.when(n > 0, let(F.array_sort(_doubles(a)), middle))


def variance(a: Column) -> Column:
    """Sample variance; null for fewer than two values."""
    squares = lambda m: F.aggregate(_doubles(a), F.lit(0.0), lambda s, x: s + (x - m) * (x - m))
    return F.when(F.size(a) >= 2, let(mean(a), squares) / (F.size(a) - 1))


def stddev(a: Column) -> Column:
    return F.sqrt(variance(a))


def cv(a: Column) -> Column:
    """Coefficient of variation; null for fewer than two values or a mean of 0 or less."""
    return F.when(F.size(a) >= 2, let(mean(a), lambda m: F.when(m > 0, stddev(a) / m)))


def jitter(a: Column) -> Column:
    """Mean absolute deviation; null for fewer than two values."""
    apart = lambda m: F.aggregate(_doubles(a), F.lit(0.0), lambda s, x: s + F.abs(x - m))
    return F.when(F.size(a) >= 2, let(mean(a), apart) / F.size(a))


def periodicity(a: Column) -> Column:
    """Lag-1 autocorrelation cut to 0..1; 1 for equal values, null for fewer than four or a mean of 0 or less."""
    n = F.size(a)

    def correlation(m: Column, centred: Column) -> Column:
        lag0 = F.aggregate(centred, F.lit(0.0), lambda s, x: s + x * x)
        pairs = F.zip_with(F.slice(centred, 1, n - 1), F.slice(centred, 2, n - 1), lambda x, y: x * y)
        lag1 = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)
        # equal values leave rounding residue in lag 0, of the order of the square of the mean's last place
        flat = lambda q: q <= F.lit(1e-24) * m * m * n
        return let(lag0, lambda q: F.when(flat(q), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), lag1 / q))))

    whole = let(mean(a), lambda m: F.when(m > 0, let(F.transform(_doubles(a), lambda x: x - m), lambda c: correlation(m, c))))
    return F.when(n >= 4, whole)


def entropy(a: Column) -> Column:
    """Shannon entropy in bits of the values of an array; 0 if it is empty or null."""

    def bits(v: Column) -> Column:
        n = F.size(v)
        shares = F.transform(F.array_distinct(v), lambda x: F.size(F.filter(v, lambda y: y.eqNullSafe(x))) / n)
        return F.greatest(F.lit(0.0), F.aggregate(shares, F.lit(0.0), lambda s, p: s - p * F.log2(p)))

    return let(F.coalesce(a, F.array()), bits)


def normalised_entropy(a: Column) -> Column:
    """Entropy over its greatest value for so many different values, 0 for one or none."""

    def share(v: Column) -> Column:
        k = F.size(F.array_distinct(v))
        return F.when(k > 1, F.greatest(F.lit(0.0), F.least(F.lit(1.0), entropy(v) / F.log2(k.cast("double"))))).otherwise(0.0)

    return let(a, share)


def finite(c: Column, default=None) -> Column:
    """The value, or `default` if it is null, NaN or infinite."""
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(bad, F.lit(default)).otherwise(c)
