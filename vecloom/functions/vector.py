"""Vector functions as Column expressions: norms, cosine, validation, half-precision rounding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from vecloom.types import LEAST_NORM


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with value computed once, also where ``use`` reads it inside a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def total(values: Column) -> Column:
    """Sum in index order, in double precision."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def normalize(v: Column) -> Column:
    """Float32 components of v at length 1; vectors at or below the least norm as they are."""
    return let(norm(v), lambda n: F.when(n > LEAST_NORM, F.transform(v, lambda x: (x.cast("double") / n).cast("float"))).otherwise(v))


def unit_double(v: Column) -> Column:
    return let(norm(v), lambda n: F.transform(v, lambda x: x.cast("double") / n))


def cosine_to_unit(v: Column, q: Column) -> Column:
    """Cosine of v and a query already at length 1 (double), within [-1, 1], as Float32."""
    dot = let(norm(v), lambda n: total(F.zip_with(v, q, lambda x, y: y * (x.cast("double") / n))))
    return F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot)).cast("float")


def cosine(a: Column, b: Column) -> Column:
    return cosine_to_unit(a, unit_double(b))


def cosine_raw(a: Column, b: Column) -> Column:
    """One division at the end, no clamp; Float32. Null for a vector of norm 0 and for unequal lengths."""
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    return F.try_divide(dot, norm(a) * norm(b)).cast("float")


def cosine_distance(similarity: Column) -> Column:
    return (F.lit(1).cast("float") - similarity).cast("float")


def spherical(similarity: Column) -> Column:
    return (F.pow(F.acos(similarity.cast("double")), F.lit(2.0)) / 2).cast("float")


def is_finite(x: Column) -> Column:
    return F.abs(x.cast("double")) < float("inf")


def error_name(v: Column, dimension: int) -> Column:
    """The first rule that a vector breaks, null for a valid one: dimension, finiteness, norm."""
    return (
        F.when(v.isNull() | (F.size(v) != dimension), F.lit("dimensionMismatch"))
        .when(~F.forall(v, is_finite), F.lit("nonFiniteVector"))
        .when(norm(v) <= LEAST_NORM, F.lit("zeroNormVector"))
    )


def is_usable(v: Column, dimension: int) -> Column:
    """The weak rule of indexing: right length, all finite, some component not zero."""
    return F.coalesce(v.isNotNull() & (F.size(v) == dimension) & F.forall(v, is_finite) & F.exists(v, lambda x: x != 0), F.lit(False))


def half(x: Column) -> Column:
    """Nearest half-precision value of a finite number, ties to even; null from 65520 on (overflow)."""
    d = x.cast("double")
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(d))).cast("double"), F.lit(-14.0)) - 10)
    return F.when(d == 0, d).when(F.abs(d) < 65520, F.rint(d / step) * step)


def to_half(v: Column) -> Column:
    return F.transform(v, lambda x: half(x).cast("float"))
