"""Column expressions on ``array<double>`` vectors; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def as_vector(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return column.cast("array<double>")


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def sum_of_squares(vec: Column) -> Column:
    return F.aggregate(vec, F.lit(0.0), lambda total, x: total + x * x)


def norm(vec: Column) -> Column:
    return F.sqrt(sum_of_squares(vec))


def scale(vec: Column, factor: Column | float) -> Column:
    factor = factor if isinstance(factor, Column) else F.lit(float(factor))
    return F.transform(vec, lambda x: x * factor)


def unit(vec: Column) -> Column:
    """The vector at length one; a zero vector stays zero."""
    length = norm(vec)
    return F.when(length > 0, F.transform(vec, lambda x: x / length)).otherwise(vec)


def elementwise(f: Callable[[Column], Column], vec: Column) -> Column:
    return F.transform(vec, f)


def add(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda x, y: x + y)


def subtract(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda x, y: x - y)
