"""Built-in-only column expressions: everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DataType, TimestampNTZType, TimestampType


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def euclidean(a: Column | str, b: Column | str) -> Column:
    """Euclidean distance of two arrays of doubles; arrays of unequal length are an error."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    distance = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))
    unequal = F.raise_error(F.lit("vectors of unequal length")).cast("double")
    return F.when(F.size(a) != F.size(b), unequal).otherwise(distance)


def entropy_term(p: Column | str) -> Column:
    """``-p * ln(p)``, continued by 0 at ``p = 0``."""
    p = _col(p)
    return F.when(p > 0, -p * F.log(p)).otherwise(F.lit(0.0))


def entropy_bits(count: Column | str) -> Column:
    """Aggregate: entropy in bits of a group given the count of each distinct value.

    ``-sum(c/N * log2(c/N))`` is written as ``log2(N) - sum(c * log2(c)) / N`` so that one pass
    with partial sums is enough. A group with one distinct value has entropy 0.
    """
    c = _col(count).cast("double")
    n = F.sum(c)
    return F.when(F.count(c) <= 1, 0.0).otherwise(F.log2(n) - F.sum(c * F.log2(c)) / n)


def entropy_nats(weight: Column | str) -> Column:
    """Aggregate: entropy in nats of the positive weights of a group, 0 if none is positive."""
    w = _col(weight).cast("double")
    positive = F.when(w > 0, w)
    n = F.sum(positive)
    return F.when(F.count(positive) <= 1, 0.0).otherwise(
        F.log(n) - F.sum(positive * F.log(positive)) / n
    )


def epoch_micros(column: Column | str, datatype: DataType) -> Column:
    """A timestamp as microseconds since 1970; any other type is cast to long.

    A zone-less timestamp is read as it stands, so the order of its values never depends on the
    session time zone (a cast would fold values around a clock change).
    """
    c = _col(column)
    if isinstance(datatype, TimestampType):
        return F.unix_micros(c)
    if isinstance(datatype, TimestampNTZType):
        days = F.date_diff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
        whole = ((days * 24 + F.hour(c)) * 60 + F.minute(c)) * 60
        return whole * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")
    return c.cast("long")


def outlier_flag(metric: Column | str, threshold: float) -> Column:
    """``yes`` if the metric is strictly above the threshold, else ``no`` (also without metric)."""
    return F.when(_col(metric) > F.lit(float(threshold)), "yes").otherwise("no")
