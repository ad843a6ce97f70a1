"""Expressions over dense (array<double>) and sparse (map<int,double>) vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _once(value: Column, f) -> Column:
    """``f`` of ``value``, which is worked out once a row: what a lambda's body says is worked out again for each element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def l2_squared(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b))


def l1(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def chi_squared(a: Column, b: Column) -> Column:
    """Sum of (x - y)^2 / (x + y) where x + y is not 0."""
    return _sum(F.zip_with(a, b, lambda x, y: F.when(x + y != 0, (x - y) * (x - y) / (x + y)).otherwise(F.lit(0.0))))


def magnitude_squared(a: Column) -> Column:
    return _sum(F.transform(a, lambda x: x * x))


def unit(a: Column) -> Column:
    """``a`` over its length; zeros stay zeros."""

    def over(a: Column, length: Column) -> Column:
        return F.transform(a, lambda x: F.when(length > 0, x / length).otherwise(F.lit(0.0)))

    return _once(a, lambda v: _once(F.sqrt(magnitude_squared(v)), lambda length: over(v, length)))


def power_unit(a: Column, alpha: float = 0.5) -> Column:
    """Signed power, then unit length."""
    return unit(F.transform(a, lambda x: F.signum(x) * F.pow(F.abs(x), F.lit(alpha))))


def clipped_unit(a: Column, most: float = 0.2) -> Column:
    """Unit length, each value at most ``most``, unit length again."""
    return unit(F.transform(unit(a), lambda x: F.least(x, F.lit(most))))


def min_max(a: Column) -> Column:
    def spread(v: Column, ends: Column) -> Column:
        low, high = ends["low"], ends["high"]
        return F.transform(v, lambda x: F.when(high > low, (x - low) / (high - low)).otherwise(F.lit(0.0)))

    return _once(a, lambda v: _once(F.struct(F.array_min(v).alias("low"), F.array_max(v).alias("high")), lambda ends: spread(v, ends)))


def parse_sparse(s: Column) -> Column:
    """'i:v i:v ...' as a map."""
    pairs = F.transform(F.filter(F.split(s, r"\s+"), lambda t: F.instr(t, ":") > 0), lambda t: F.split(t, ":"))
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.element_at(p, 1).cast("int"), F.element_at(p, 2).cast("double"))))


def format_sparse(m: Column) -> Column:
    keys = F.array_sort(F.map_keys(m))
    return F.array_join(F.transform(keys, lambda k: F.concat(k.cast("string"), F.lit(":"), F.element_at(m, k).cast("string"))), " ")


def sparse_of(a: Column) -> Column:
    """The non-zero entries of a dense vector, by place from 0."""
    entries = F.filter(F.transform(a, lambda x, i: F.struct(i.alias("i"), x.alias("v"))), lambda e: e["v"] != 0)
    return F.map_from_entries(entries)


def dense(m: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.element_at(m, i), F.lit(0.0)))


def _merged(a: Column, b: Column, f) -> Column:
    return F.map_zip_with(a, b, lambda k, x, y: f(F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0))))


def sparse_add(a: Column, b: Column, scale: float = 1.0) -> Column:
    return _merged(a, b, lambda x, y: x + F.lit(scale) * y)


def sparse_subtract(a: Column, b: Column) -> Column:
    return _merged(a, b, lambda x, y: x - y)


def sparse_multiply(a: Column, b: Column) -> Column:
    return F.map_filter(_merged(a, b, lambda x, y: x * y), lambda k, v: v != 0)


def sparse_scale(a: Column, by: float) -> Column:
    return F.transform_values(a, lambda k, v: v * F.lit(by))


def sparse_dot(a: Column, b: Column) -> Column:
    return _sum(F.map_values(_merged(a, b, lambda x, y: x * y)))


def sparse_shift(a: Column, by: int) -> Column:
    return F.transform_keys(a, lambda k, v: k + F.lit(by))


def sparse_slice(a: Column, start: int, size: int) -> Column:
    """Entries from ``start`` on, ``size`` places, counted from 0 again."""
    return sparse_shift(F.map_filter(a, lambda k, v: (k >= start) & (k < start + size)), -start)


def scale_regions(a: Column, ends: list[int], factors: list[float]) -> Column:
    """Each entry times the factor of the region it lies in; region r ends before ``ends[r]``."""

    def factor(k: Column) -> Column:
        out = F.lit(1.0)
        for end, by in reversed(list(zip(ends, factors))):
            out = F.when(k < end, F.lit(by)).otherwise(out)
        return out

    return F.transform_values(a, lambda k, v: v * factor(k))
