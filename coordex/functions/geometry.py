"""Vectors and affine transforms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def distance(a: Column, b: Column, fields: str = "xyz") -> Column:
    """Of two structs with the named fields."""
    return norm(*[a.getField(f) - b.getField(f) for f in fields])


def apply_affine(affine: Column, v: Column) -> Column:
    """voxel to world: rows of a 4 x 4 matrix times (i, j, k, 1). A component whose factor is
    0 has no part in a sum, be it unknown or not."""
    term = lambda r, k: F.when(r[k] != 0, r[k] * v[k]).otherwise(0.0)
    row = lambda r: term(r, 0) + term(r, 1) + term(r, 2) + r[3]
    return F.transform(F.slice(affine, 1, 3), row)


def inverse_affine(affine: Column, w: Column) -> Column:
    """world to voxel, unrounded: the 3 x 3 part's adjugate over its determinant."""
    m = [[affine[r][c] for c in range(3)] for r in range(3)]
    d = [w[r] - affine[r][3] for r in range(3)]
    minor = lambda r, c: m[(r + 1) % 3][(c + 1) % 3] * m[(r + 2) % 3][(c + 2) % 3] - m[(r + 1) % 3][(c + 2) % 3] * m[(r + 2) % 3][(c + 1) % 3]
    cof = [[minor(r, c) for c in range(3)] for r in range(3)]
    det = F.nullif(m[0][0] * cof[0][0] + m[0][1] * cof[0][1] + m[0][2] * cof[0][2], F.lit(0.0))
    return F.array(*[(cof[0][c] * d[0] + cof[1][c] * d[1] + cof[2][c] * d[2]) / det for c in range(3)])


def world_to_voxel(affine: Column, w: Column) -> Column:
    """Rounded half to even, as whole numbers."""
    return F.transform(inverse_affine(affine, w), lambda x: F.rint(x).cast("int"))


def inside(voxel: Column, shape: Column) -> Column:
    return F.forall(F.zip_with(voxel, shape, lambda c, n: (c >= 0) & (c < n)), lambda x: x)


def blend(v: Column, colour: Column, alpha: Column | float) -> Column:
    a = F.lit(alpha) if isinstance(alpha, float) else alpha
    return v * (1 - a) + colour * a


def argmax(values: Column) -> Column:
    """Index (from 0) of the first largest element."""
    return F.array_position(values, F.array_max(values)).cast("int") - 1
