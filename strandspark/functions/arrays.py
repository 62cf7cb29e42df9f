"""Operators on a read's array column, kept inside the JVM by higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scale_to_pa(raw: Column, offset: Column, range_: Column, digitisation: Column) -> Column:
    unit = range_ / digitisation
    return F.transform(raw, lambda x: (x + offset) * unit)


def shift_scale(a: Column, shift: Column, scale: Column) -> Column:
    return F.transform(a, lambda x: (x - shift) / scale)


def clip(a: Column, limit: float) -> Column:
    return F.transform(a, lambda x: F.greatest(F.lit(-limit), F.least(F.lit(limit), x)))


def replace_large(a: Column, limit: float, fill: float = 0.0) -> Column:
    return F.transform(a, lambda x: F.when(F.abs(x) > limit, F.lit(fill)).otherwise(x))


def difference(a: Column, last: float = 0.0) -> Column:
    """Next element minus this one; the last element becomes ``last``."""
    ahead = F.concat(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.lit(None).cast("double")))
    moved = F.zip_with(a, ahead, lambda x, y: F.coalesce(y - x, F.lit(last)))
    return F.when(F.size(a) > 0, moved).otherwise(a.cast("array<double>"))


def arg_max(a: Column) -> Column:
    """Index of the first largest element."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def arg_min(a: Column) -> Column:
    return (F.array_position(a, F.array_min(a)) - 1).cast("int")


def changes(a: Column) -> Column:
    """How often neighbours differ."""
    return F.size(F.filter(F.zip_with(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), lambda x, y: x != y), lambda d: d))


def modulo(a: Column, m: int) -> Column:
    return F.transform(a, lambda x: x % m)


def nearly_equal(a: Column, b: Column, tolerance: float) -> Column:
    """Same length and every pair within ``tolerance``."""
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= tolerance), lambda ok: ok)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _bound(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once, though ``then`` uses it for every element of an array."""
    return F.transform(F.array(value), then)[0]


def normalise(a: Column) -> Column:
    """Each element over the array's sum."""
    return _bound(total(a), lambda s: F.transform(a, lambda x: x / s))


def log_total(a: Column) -> Column:
    """log of the sum of exponentials, shifted by the largest element."""
    return _bound(F.array_max(a), lambda m: m + F.ln(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x - m))))


def log_normalise(a: Column) -> Column:
    return _bound(log_total(a), lambda z: F.transform(a, lambda x: x - z))


def softmax(a: Column) -> Column:
    return _bound(log_total(a), lambda z: F.transform(a, lambda x: F.exp(x - z)))


def live_slice(signal: Column, start: Column, end: Column) -> Column:
    """Elements start to end - 1, counted from 0."""
    return F.slice(signal, start.cast("int") + 1, F.greatest(end - start, F.lit(0)).cast("int"))


def is_valid(a: Column, low: float, high: float) -> Column:
    """No null, NaN or infinite element, and all within [low, high]."""
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= low) & (x <= high))


def down_sample_factor(signal: Column, trace: Column) -> Column:
    return F.round(F.size(signal) / F.size(trace)).cast("int")
