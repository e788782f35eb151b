"""Column functions on vectors (arrays of numbers), all inside the JVM.

Maths is in double precision. A zero vector stays zero when it is normalised, and has similarity 0 to anything.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def safe_norm(v: Column) -> Column:
    """The norm, or 1 for a zero vector."""
    n = norm(v)
    return F.when(n == 0, 1.0).otherwise(n)


def normalised(v: Column, n: Column) -> Column:
    """v over its safe_norm n. n has to be bound by a lambda (see tokens.unit), as it is read once for each element."""
    return F.transform(v, lambda x: x / n)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def project(v: Column, mean: Sequence[float], components: Sequence[Sequence[float]]) -> Column:
    """(v - mean) times each component. PCAModel.transform does not subtract the mean, so this does."""
    centred = minus(v, literal(mean))
    return F.transform(F.array(*[literal(c) for c in components]), lambda c: dot(c, centred))


def quantise(residual: Column, thresholds: Column) -> Column:
    """Of each element, how many of its three thresholds (array of arrays, by level) lie strictly below it: 0 to 3."""
    over = lambda level: F.zip_with(residual, F.element_at(thresholds, level), lambda x, t: (x > t).cast("int"))
    return F.zip_with(F.zip_with(over(1), over(2), lambda a, b: a + b), over(3), lambda a, b: a + b)


def pack2(levels: Column, width: int) -> Column:
    """Levels 0 to 3, four to a byte and the first in its lowest bits, as a hex string; the width must divide by 4."""
    if width <= 0 or width % 4:
        raise ValueError(f"{width} values cannot be packed: the width must be a positive multiple of 4")
    byte = lambda i: sum((F.shiftleft(F.element_at(levels, 4 * i + k + 1), 2 * k) for k in range(1, 4)), F.element_at(levels, 4 * i + 1))
    return F.concat(*[F.lpad(F.hex(byte(i)), 2, "0") for i in range(width // 4)])


def unpack2(packed: Column, width: int) -> Column:
    """The first ``width`` levels of a hex string that pack2 made."""
    value = lambda i: F.conv(F.substring(packed, 2 * (i // 4) + 1, 2), 16, 10).cast("int")
    return F.array(*[F.shiftright(value(i), 2 * (i % 4)).bitwiseAND(3) for i in range(width)])


def dequantise(levels: Column, values: Column) -> Column:
    """Of each level its value in that dimension; values is an array of arrays, by level."""
    pick = lambda k: F.element_at(values, k)
    four = F.arrays_zip(levels.alias("q"), pick(1).alias("a"), pick(2).alias("b"), pick(3).alias("c"), pick(4).alias("d"))
    return F.transform(four, lambda x: F.when(x["q"] == 0, x["a"]).when(x["q"] == 1, x["b"]).when(x["q"] == 2, x["c"]).otherwise(x["d"]))


def half_even(x: Column) -> Column:
    return F.rint(x)
