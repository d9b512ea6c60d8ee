"""Vectors of three columns in z, y, x order, and small fixed matrices, as column expressions."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def scale(a: Vec, k: Column | float) -> Vec:
    return a[0] * k, a[1] * k, a[2] * k


def minus(a: Vec, b: Vec) -> Vec:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def cross_zyx(a: Vec, b: Vec) -> Vec:
    """Component-wise cross product taken in stored order; it is minus the geometric one, which axial use doesn't see."""
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def unit(a: Vec, eps: float = 1e-6) -> Vec:
    """Unit vector, exactly zero where the length is at most ``eps``."""
    n = norm(a)
    return tuple(F.when(n > eps, c / n).otherwise(0.0) for c in a)


def angle_deg(a: Vec, b: Vec, axial: bool = False) -> Column:
    """Angle between two unit vectors in degrees; of their lines if ``axial``."""
    c = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))
    return F.degrees(F.acos(F.abs(c) if axial else c))


def fibre_basis(n: Vec, axis: Vec, least: float = 1e-3) -> tuple[Vec, Vec, Column]:
    """In-plane basis of a sheet: the axis less its part along the normal, and the cross product of normal and axis; and whether both exist."""
    along = dot(axis, n)
    v, h = minus(axis, scale(n, along)), cross_zyx(n, axis)
    return unit(v), unit(h), (norm(v) > least) & (norm(h) > least)


def class_direction(p_v: Column, p_h: Column, v: Vec, h: Vec) -> tuple[Vec, Column]:
    """Direction and strength from two class probabilities."""
    return unit(tuple(p_v * a + p_h * b for a, b in zip(v, h, strict=True))), F.greatest(p_v, p_h)


def orthonormal(r: Vec, a: Vec) -> Vec:
    """``r`` less its part along the unit vector ``a``, as a unit vector."""
    return unit(minus(r, scale(a, dot(r, a))))


def radial(y: Column, x: Column, cy: Column, cx: Column) -> tuple[Column, Column]:
    """In-plane unit vector away from a centre, zero at the centre."""
    d = F.hypot(y - cy, x - cx)
    return F.when(d > 0, (y - cy) / d).otherwise(0.0), F.when(d > 0, (x - cx) / d).otherwise(0.0)


def level_coordinate(index: Column, level: int) -> Column:
    """Level-0 place of the centre of a voxel of a pyramid level."""
    return index * float(2**level) + (2**level - 1) / 2


def affine(matrix: list[list[float]], point: Vec) -> Vec:
    """A 3 x 4 (or 4 x 4) matrix applied to points in its own order."""
    return tuple(row[0] * point[0] + row[1] * point[1] + row[2] * point[2] + row[3] for row in matrix[:3])


def composed(*matrices: list[list[float]]) -> list[list[float]]:
    """The product of 3 x 3 matrices, the last applied first."""
    out = matrices[-1]
    for m in reversed(matrices[:-1]):
        out = [[sum(m[i][k] * out[k][j] for k in range(3)) for j in range(3)] for i in range(3)]
    return out


def rotation(axis: tuple[float, float, float], degrees: float) -> list[list[float]]:
    """The rotation by an angle about an axis, by its unit quaternion."""
    size, half = math.hypot(*axis), math.radians(degrees) / 2
    return quaternion_rotation(math.cos(half), *(math.sin(half) * a / size for a in axis))


def quaternion_rotation(w: float, a: float, b: float, c: float) -> list[list[float]]:
    """The rotation of a quaternion of any length: four independent normal numbers give every rotation alike."""
    n = w * w + a * a + b * b + c * c
    v, cross = (a, b, c), [[0.0, -c, b], [c, 0.0, -a], [-b, a, 0.0]]
    return [[(2 * v[i] * v[j] + 2 * w * cross[i][j] + ((w * w - a * a - b * b - c * c) if i == j else 0.0)) / n for j in range(3)] for i in range(3)]


def signed_permutation(matrix: list[list[float]], tolerance: float = 1e-5) -> tuple[tuple[int, int, int], tuple[int, int, int]] | None:
    """(axes, signs) of a 3 x 3 matrix that only permutes and flips axes, else None."""
    for _, axes, signs in orientations():
        if all(abs(matrix[i][j] - (signs[i] if j == axes[i] else 0)) <= tolerance for i in range(3) for j in range(3)):
            return axes, signs
    return None


def swap_axes(matrix: list[list[float]]) -> list[list[float]]:
    """The same affine map in the reversed order of axes."""
    rows = [[*reversed(r[:3]), r[3]] for r in matrix[:3]]
    return [*reversed(rows), *matrix[3:]]


def max_eigenvalue_sym3(zz: Column, yy: Column, xx: Column, zy: Column, zx: Column, yx: Column) -> Column:
    """Largest eigenvalue of a symmetric 3 x 3 matrix, in closed form."""
    q = (zz + yy + xx) / 3
    off = zy * zy + zx * zx + yx * yx
    p = F.sqrt(((zz - q) ** 2 + (yy - q) ** 2 + (xx - q) ** 2 + 2 * off) / 6)
    a, b, c = (zz - q) / p, (yy - q) / p, (xx - q) / p
    d, e, f = zy / p, zx / p, yx / p
    half_det = (a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)) / 2
    phi = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), half_det))) / 3
    return F.when(p < 1e-12, q).otherwise(q + 2 * p * F.cos(phi))


def eigenvalues_sym3(zz: Column, yy: Column, xx: Column, zy: Column, zx: Column, yx: Column) -> tuple[Column, Column, Column]:
    """Eigenvalues of a symmetric 3 x 3 matrix, ascending, in closed form."""
    q = (zz + yy + xx) / 3
    off = zy * zy + zx * zx + yx * yx
    p = F.sqrt(((zz - q) ** 2 + (yy - q) ** 2 + (xx - q) ** 2 + 2 * off) / 6)
    a, b, c = (zz - q) / p, (yy - q) / p, (xx - q) / p
    d, e, f = zy / p, zx / p, yx / p
    half_det = (a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)) / 2
    phi = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), half_det))) / 3
    level = lambda turn: F.when(p < 1e-12, q).otherwise(q + 2 * p * F.cos(phi + turn))
    low, high = level(2 * math.pi / 3), level(0.0)
    return low, 3 * q - low - high, high


def eigenvector_sym3(value: Column, zz: Column, yy: Column, xx: Column, zy: Column, zx: Column, yx: Column) -> Vec:
    """Unit eigenvector of a symmetric 3 x 3 matrix for a single eigenvalue, up to its sign: of :func:`along_eigenvector_sym3`. Zero where that vanishes, that
    is, where the eigenvalue isn't single."""
    return unit(along_eigenvector_sym3(value, zz, yy, xx, zy, zx, yx), 1e-9)


def along_eigenvector_sym3(value: Column, zz: Column, yy: Column, xx: Column, zy: Column, zx: Column, yx: Column) -> Vec:
    """The longest cross product of two rows of a symmetric 3 x 3 matrix less an eigenvalue, along its eigenvector if it is single. Hundreds of operations for
    each part: as columns of their own they are planned once."""
    rows = ((zz - value, zy, zx), (zy, yy - value, yx), (zx, yx, xx - value))
    crosses = [(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]) for a, b in itertools.combinations(rows, 2)]
    sizes = [dot(c, c) for c in crosses]
    first = (sizes[0] >= sizes[1]) & (sizes[0] >= sizes[2])
    return tuple(F.when(first, a).when(sizes[1] >= sizes[2], b).otherwise(c) for a, b, c in zip(*crosses, strict=True))


def circular_mean_turns(angle: Column, weight: Column) -> Column:
    """Aggregate: weighted circular mean, in turns from -0.5 to 0.5."""
    return F.atan2(F.sum(weight * F.sin(angle)), F.sum(weight * F.cos(angle))) / (2 * math.pi)


def orientations() -> list[tuple[int, tuple[int, int, int], tuple[int, int, int]]]:
    """The 48 signed permutations of three axes as (number, axes, signs), the identity first."""
    return [(i, axes, signs) for i, (axes, signs) in enumerate(itertools.product(itertools.permutations(range(3)), itertools.product((1, -1), repeat=3)))]


def determinant(axes: tuple[int, int, int], signs: tuple[int, int, int]) -> int:
    swaps = sum(axes[i] > axes[j] for i in range(3) for j in range(i + 1, 3))
    return (-1) ** swaps * math.prod(signs)


#: Named subgroups of the 48 orientations.
GROUPS = {
    "oct48": lambda axes, signs: True,
    "rot24": lambda axes, signs: determinant(axes, signs) == 1,
    "flip8": lambda axes, signs: axes == (0, 1, 2),
    "inplane16": lambda axes, signs: axes[0] == 0,
    "rot90z4": lambda axes, signs: axes[0] == 0 and signs[0] == 1 and determinant(axes, signs) == 1,
}


def group(name: str) -> list[tuple[int, tuple[int, int, int], tuple[int, int, int]]]:
    return [o for o in orientations() if GROUPS[name](o[1], o[2])]
