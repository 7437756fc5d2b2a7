"""Array expressions for vectors of any length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def total(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda s, x: s + x)


def add(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda x, y: x + y)


def axpy(factor: Column | float, x: Column, y: Column) -> Column:
    """factor * x + y"""
    factor = factor if isinstance(factor, Column) else F.lit(float(factor))
    return F.zip_with(x, y, lambda a, b: factor * a + b)


def scale(vector: Column, factor: Column | float) -> Column:
    factor = factor if isinstance(factor, Column) else F.lit(float(factor))
    return F.transform(vector, lambda x: x * factor)


def filled(value: float, size: int | Column) -> Column:
    return F.array_repeat(F.lit(float(value)), size)


def index_of(vector: Column, value: Column) -> Column:
    """Zero-based position of the first equal element, -1 if there is none."""
    return F.array_position(vector, value) - 1


def joined(vector: Column, separator: str = ", ") -> Column:
    return F.array_join(vector.cast("array<string>"), separator)


def literal(values: list[float]) -> Column:
    """A constant vector. Given as text it stays one expression however long it is, and folds to a literal."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")
