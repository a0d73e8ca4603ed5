"""Vector primitives as native column expressions: nothing here leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = Column


def total(a: Vec) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def dot(a: Vec, b: Vec) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def l1(a: Vec) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + F.abs(v))


def l2(a: Vec) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v))


def scaled(a: Vec, k: Column | float) -> Vec:
    return F.transform(a, lambda v: v * k)


def plus(a: Vec, b: Vec) -> Vec:
    return F.zip_with(a, b, lambda x, y: x + y)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row: an expression inside a lambda is computed again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lse(z: Vec) -> Column:
    """log-sum-exp; the largest term is 1, so the logarithm is never of 0."""
    return bound(z, lambda z: bound(F.array_max(z), lambda m: m + F.ln(F.aggregate(z, F.lit(0.0), lambda s, v: s + F.exp(v - m)))))


def softmax(z: Vec) -> Vec:
    return bound(z, lambda z: bound(lse(z), lambda m: F.transform(z, lambda v: F.exp(v - m))))


def argmax(z: Vec) -> Column:
    """The first index of the largest element, from 0."""
    return (F.array_position(z, F.array_max(z)) - 1).cast("int")


def matvec(w: Column, x: Vec, b: Vec | None = None) -> Vec:
    out = F.transform(w, lambda row: dot(row, x))
    return out if b is None else plus(out, b)


def combine_rows(w: Column, p: Vec, d: Column) -> Vec:
    """sum_c p_c w_c for rows w_c of d elements."""
    zero = F.transform(F.sequence(F.lit(1), d), lambda _: F.lit(0.0))
    return F.aggregate(F.zip_with(w, p, lambda row, q: scaled(row, q)), zero, plus)


def largest(a: Vec, k: int) -> Vec:
    return F.slice(F.sort_array(a, asc=False), 1, k)


def nan_guard(a: Vec, value: Column) -> Column:
    """NaN if any element is NaN, else value: min-like functions of Spark skip NaN, those of the definitions don't."""
    return F.when(F.exists(a, F.isnan), F.lit(float("nan"))).otherwise(value)


def clip(v: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def field(name: str):
    """A lambda that takes a field of structs, for higher-order functions."""
    return lambda q: q[name]
