"""Vector math on triples of double columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

Vec = tuple[Column, Column, Column]


def vec(x: str, y: str, z: str) -> Vec:
    return F.col(x), F.col(y), F.col(z)


def add(a: Vec, b: Vec) -> Vec:
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


def sub(a: Vec, b: Vec) -> Vec:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def scale(a: Vec, k: Column | float) -> Vec:
    return a[0] * k, a[1] * k, a[2] * k


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return (
        a[1] * b[2] - a[2] * b[1],
        a[2] * b[0] - a[0] * b[2],
        a[0] * b[1] - a[1] * b[0],
    )


def length(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def rounded(c: Column | str, places: int = 6) -> Column:
    """Round and turn -0.0 into 0.0."""
    return F.round(F.col(c) if isinstance(c, str) else c, places) + F.lit(0.0)
