"""Spatial augmentation of boxes of voxels: a linear map and a smooth displacement from hashed control points, gathered trilinearly."""

from __future__ import annotations

import itertools
import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickwise.functions import vectors
from brickwise.operators.grid import AXES

Matrix = list[list[float]]
IDENTITY: Matrix = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]


class Warp(NamedTuple):
    """``matrix`` carries centred places of a box forward; ``magnitude`` is the deviation, in voxels, of ``grid``^3 control points' displacements."""

    matrix: Matrix = IDENTITY
    magnitude: float = 0.0
    grid: int = 4
    seed: str = "0"

    def inverse(self) -> Matrix:
        return np.linalg.inv(np.array(self.matrix)).tolist()

    def scale(self) -> float:
        """The cube root of the matrix's volume: how lengths grow on the whole."""
        return float(abs(np.linalg.det(np.array(self.matrix))) ** (1 / 3))


def hashed_normal(key: Column) -> Column:
    """A standard normal number drawn from a text: the same for the same text wherever and whenever it is drawn."""
    digest = F.md5(key.cast("string"))
    uniform = lambda start: (F.conv(F.substring(digest, start, 8), 16, 10).cast("double") + 0.5) / 2.0**32
    return F.sqrt(-2 * F.ln(uniform(1))) * F.cos(2 * math.pi * uniform(9))


def control_points(rows: DataFrame, warp: Warp) -> DataFrame:
    """``rows`` with ``_field``: the displacements of all control points of their ``box``, grid^3 structs in z, y, x order.

    Drawn once per box, and handed to its rows by a join on the box; a box without an id has a field of its own, as any id has.
    """
    n = warp.grid
    at = F.col("i")
    drawn = lambda a: hashed_normal(F.concat_ws(":", F.lit(warp.seed), F.coalesce(F.col("box").cast("string"), F.lit("-")), F.lit(a),
        at)) * warp.magnitude
    points = F.transform(F.sequence(F.lit(0), F.lit(n**3 - 1)), lambda i: i)
    boxes = rows.select("box").distinct().withColumn("i", F.explode(points))
    fields = boxes.select("box", "i", *[drawn(a).alias(a) for a in AXES]).groupBy("box").agg(F.sort_array(F.collect_list(F.struct("i", *AXES))).alias("_field"))
    fields = fields.withColumnRenamed("box", "_box")
    return rows.join(fields, F.col("box").eqNullSafe(F.col("_box"))).drop("_box")


def _in_field(size: tuple[int, int, int], n: int) -> list[tuple[Column, Column]]:
    """For each axis the control cell of a place and the place within it."""
    out = []
    for a, length in zip(AXES, size, strict=True):
        at = F.col(a) * ((n - 1) / max(length - 1, 1))
        cell = F.least(F.floor(at), F.lit(n - 2)).cast("int")
        out.append((cell, at - cell))
    return out


def _displaced(size: tuple[int, int, int], n: int, along: int | None) -> vectors.Vec:
    """The displacement at z, y, x of the box, or its derivative along an axis."""
    cells = _in_field(size, n)
    total: list[Column] = [F.lit(0.0)] * 3
    for bits in itertools.product((0, 1), repeat=3):
        index, weight = F.lit(0), F.lit(1.0)
        for k, (bit, (cell, part)) in enumerate(zip(bits, cells, strict=True)):
            index = index * n + cell + bit
            if k == along:
                weight = weight * ((1 if bit else -1) * (n - 1) / max(size[k] - 1, 1))
            else:
                weight = weight * (part if bit else 1 - part)
        point = F.get(F.col("_field"), index)
        total = [t + weight * point[a] for t, a in zip(total, AXES, strict=True)]
    return tuple(total)


def _times(matrix: list[list[Column | float]], v: vectors.Vec) -> vectors.Vec:
    return tuple(row[0] * v[0] + row[1] * v[1] + row[2] * v[2] for row in matrix)


def _adjugate(m: list[list[Column]]) -> tuple[list[list[Column]], Column]:
    """The inverse times the determinant, and the determinant."""
    minor = lambda r, c: m[(r + 1) % 3][(c + 1) % 3] * m[(r + 2) % 3][(c + 2) % 3] - m[(r + 1) % 3][(c + 2) % 3] * m[(r + 2) % 3][(c + 1) % 3]
    det = m[0][0] * minor(0, 0) + m[0][1] * minor(0, 1) + m[0][2] * minor(0, 2)
    return [[minor(c, r) for c in range(3)] for r in range(3)], det


def origins(rows: DataFrame, size: tuple[int, int, int], warp: Warp) -> DataFrame:
    """``rows`` (box, z, y, x with places from 0 within a box of ``size``) with the place ``p_*`` that each is drawn from, ``outside`` where that is beyond
    the box, and the pull-back's matrix ``j_rc``: how the origin moves with the place.
    """
    half = [(n - 1) / 2 for n in size]
    back = warp.inverse()
    centred = tuple(F.col(a) - h for a, h in zip(AXES, half, strict=True))
    linear = _times(back, centred)
    slopes: list[list[Column]] = [[F.lit(float(v)) for v in row] for row in back]
    if warp.magnitude > 0:
        rows = control_points(rows, warp)
        moved = _displaced(size, warp.grid, None)
        linear = tuple(p + e for p, e in zip(linear, moved, strict=True))
        for c in range(3):
            for r, e in enumerate(_displaced(size, warp.grid, c)):
                slopes[r][c] = slopes[r][c] + e
    named = {f"p_{a}": p + h for a, p, h in zip(AXES, linear, half, strict=True)} | {f"j_{r}{c}": slopes[r][c] for r in range(3) for c in range(3)}
    outside = F.lit(False)
    for a, h in zip(AXES, half, strict=True):
        outside = outside | (F.abs(F.col(f"p_{a}") - h) > h + 1e-4)
    return rows.withColumns(named).withColumn("outside", outside).drop("_field")


def warped(rows: DataFrame, size: tuple[int, int, int], warp: Warp, plain: list[str] = (), scalars: list[str] = (), lengths: list[str] = (),
    tangents: list[str] = (), covectors: list[str] = (), valid: str = "valid", clip: float = 20.0, saturated: float = 1e-3) -> DataFrame:
    """Boxes of rows (box, z, y, x from 0, valid, ...) drawn anew through a warp; one row for each that there was.

    ``plain`` values (intensities) lie between the eight voxels around their origin, the border's beyond it. All others lie between those of the eight that
    are supervised (valid 1), and are 0 where there are none: ``scalars`` stay, ``lengths`` grow with the whole map and are held within ``clip``,
    ``tangents`` (prefixes of vectors ``prefix_z, _y, _x``) are turned by the local Jacobian of the map, ``covectors`` by its inverse transposed; both come
    out as unit vectors. ``valid`` is that of the nearest voxel, 0 outside the box; 2 where a map that shrinks lengths has shrunk one that was at the clip,
    since what it is then isn't known. The identity gives the rows again, vectors made unit vectors. A place without a row has no value and is as if not
    supervised.
    """
    vector = [f"{p}_{a}" for p in (*tangents, *covectors) for a in AXES]
    drawn = [*scalars, *lengths, *vector]
    placed = origins(rows.select("box", *AXES), size, warp)
    keys = ["box", *AXES]
    corners = []
    for bits in itertools.product((0, 1), repeat=3):
        parts, place, held = [], [], []
        for a, bit, n in zip(AXES, bits, size, strict=True):
            low = F.floor(F.col(f"p_{a}"))
            parts.append(F.col(f"p_{a}") - low if bit else 1 - (F.col(f"p_{a}") - low))
            at = (low + bit).cast("int")
            place.append(at)
            held.append(F.greatest(F.lit(0), F.least(F.lit(n - 1), at)))
        inside = held[0] == place[0]
        for h, p in zip(held[1:], place[1:], strict=True):
            inside = inside & (h == p)
        corners.append(F.struct(*[h.alias(f"_{a}") for h, a in zip(held, AXES, strict=True)], (parts[0] * parts[1] * parts[2]).alias("_w"),
            inside.alias("_inside")))
    spread = placed.select(*keys, F.explode(F.array(*corners)).alias("_c")).select(*keys, "_c.*").where("_w > 0")
    source = rows.select(F.col("box").alias("_box"), *[F.col(a).alias(f"_{a}") for a in AXES], (F.col(valid) == 1).alias("_m"),
        *[F.col(c).alias(f"_v_{c}") for c in (*plain,
        *drawn)])
    same = F.col("box").eqNullSafe(F.col("_box"))
    for a in AXES:
        same = same & (spread[f"_{a}"] == source[f"_{a}"])
    met = spread.join(source, same)
    counts = F.when(F.col("_m") & F.col("_inside"), F.col("_w")).otherwise(0.0)
    share = lambda weight, c: F.sum(weight * F.coalesce(F.col(f"_v_{c}"), F.lit(0.0))).alias(f"_s_{c}")
    sums = met.groupBy(*keys).agg(F.sum("_w").alias("_all"), F.sum(counts).alias("_part"), *[share(F.col("_w"), c) for c in plain], *[share(counts,
        c) for c in drawn])
    nearest = {f"_{a}": F.rint(F.col(f"p_{a}")).cast("int") for a in AXES}
    states = rows.select(F.col("box").alias("_box"), *[F.col(a).alias(f"_{a}") for a in AXES], F.col(valid).alias("_state"))
    stated = placed.withColumns({f"_n{a}": nearest[f"_{a}"] for a in AXES})
    condition = F.col("box").eqNullSafe(F.col("_box"))
    for a in AXES:
        condition = condition & (stated[f"_n{a}"] == states[f"_{a}"])
    stated = stated.join(states, condition, "left").select(*keys, "outside", *[f"j_{r}{c}" for r in range(3) for c in range(3)], "_state")
    sums = sums.select(F.col("box").alias("_box"), *[F.col(a).alias(f"_{a}") for a in AXES], "_all", "_part", *[f"_s_{c}" for c in (*plain, *drawn)])
    condition = F.col("box").eqNullSafe(F.col("_box"))
    for a in AXES:
        condition = condition & (stated[a] == sums[f"_{a}"])
    both = stated.join(sums, condition, "left")
    mean = lambda c: F.when(F.col("_part") > 1e-6, F.col(f"_s_{c}") / F.col("_part")).otherwise(0.0)
    jacobian = [[F.col(f"j_{r}{c}") for c in range(3)] for r in range(3)]
    forward, det = _adjugate(jacobian)
    sign = F.when(det < 0, -1.0).otherwise(1.0)
    out = {c: F.when(F.col("_all") > 0, F.col(f"_s_{c}") / F.col("_all")) for c in plain} | {c: mean(c) for c in scalars}
    grown = {c: mean(c) * warp.scale() for c in lengths}
    out |= {c: F.greatest(F.lit(-clip), F.least(F.lit(clip), g)) for c, g in grown.items()}
    for prefix in tangents:  # forward is the inverse of the pull-back: its adjugate but for a factor, whose sign counts
        turned = vectors.unit(tuple(sign * c for c in _times(forward, tuple(mean(f"{prefix}_{a}") for a in AXES))))
        out |= {f"{prefix}_{a}": c for a, c in zip(AXES, turned, strict=True)}
    for prefix in covectors:
        turned = vectors.unit(_times([list(r) for r in zip(*jacobian, strict=True)], tuple(mean(f"{prefix}_{a}") for a in AXES)))
        out |= {f"{prefix}_{a}": c for a, c in zip(AXES, turned, strict=True)}
    state = F.when(F.col("outside"), 0).otherwise(F.coalesce("_state", F.lit(0)))
    if warp.scale() < 1 - 1e-6 and lengths:
        lost = F.lit(False)
        for g in grown.values():
            lost = lost | (F.abs(g) >= clip * warp.scale() * (1 - saturated))
        state = F.when((state == 1) & lost, 2).otherwise(state)
    return both.select(*keys, *[c.alias(n) for n, c in out.items()], state.alias(valid))
