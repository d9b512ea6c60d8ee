"""Boxes, bricks, halos, windows and neighbourhoods of voxel rows with integer columns z, y, x."""

from __future__ import annotations

import itertools
import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = ("z", "y", "x")
FACES = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


def cube(radius: int) -> list[tuple[int, int, int]]:
    """Offsets of the cube of this Chebyshev radius, without its centre."""
    span = range(-radius, radius + 1)
    return [o for o in itertools.product(span, span, span) if any(o)]


def ball(radius: float) -> list[tuple[int, int, int]]:
    """Offsets of the ball of this radius, without its centre."""
    return [o for o in cube(int(radius)) if sum(c * c for c in o) <= radius * radius]


def inside(low: tuple[int, int, int], size: tuple[int, int, int]) -> Column:
    """Whether a row lies in the half-open box; range predicates that reach the scan."""
    return _all(*[(F.col(a) >= lo) & (F.col(a) < lo + n) for a, lo, n in zip(AXES, low, size, strict=True)])


def _all(*conditions: Column) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def box_grid(spark: SparkSession, low: tuple[int, int, int], size: tuple[int, int, int]) -> DataFrame:
    """All (z, y, x) of a box, made from its row numbers."""
    n = math.prod(size)
    i = F.col("id")
    return spark.range(n).select(
        (F.floor(i / (size[1] * size[2])) + low[0]).cast("int").alias("z"), (F.floor(i / size[2]) % size[1] + low[1]).cast("int").alias("y"),
            (i % size[2] + low[2]).cast("int").alias("x")
    )


def read_box(voxels: DataFrame, low: tuple[int, int, int], size: tuple[int, int, int], value: str, fill: int = 0, edge: bool = False, extent: tuple[int, int,
    int] | None = None) -> DataFrame:
    """(z, y, x, value) for every place of a box; outside the data ``fill``, or the nearest place of ``extent`` if ``edge``."""
    grid = box_grid(voxels.sparkSession, low, size)
    if edge:
        near = [F.greatest(F.lit(0), F.least(F.lit(n - 1), F.col(a))) for a, n in zip(AXES, extent, strict=True)]
        keyed = grid.select(*AXES, *[c.cast("int").alias(f"_{a}") for a, c in zip(AXES, near, strict=True)])
        source = voxels.select(*[F.col(a).alias(f"_{a}") for a in AXES], value)
        return keyed.join(source, [f"_{a}" for a in AXES], "left").select(*AXES, F.coalesce(value, F.lit(fill)).alias(value))
    source = voxels.where(inside(low, size)).select(*AXES, value)
    return grid.join(source, list(AXES), "left").select(*AXES, F.coalesce(value, F.lit(fill)).alias(value))


def brick_of(edge: int) -> list[Column]:
    """Brick coordinates bz, by, bx of a row."""
    return [F.floor(F.col(a) / edge).cast("int").alias(f"b{a}") for a in AXES]


def with_halo(voxels: DataFrame, edge: int, halo: int, low: tuple[int, int, int], high: tuple[int, int, int]) -> DataFrame:
    """Each row once for every brick whose box, widened by ``halo``, holds it; ``core`` marks its own brick.

    Bricks are limited to low..high (half-open, in bricks). Rows are repeated ((edge + 2 halo) / edge)^3 times at most.
    """
    out = voxels
    for a, lo, hi in zip(AXES, low, high, strict=True):
        first = F.greatest(F.lit(lo), F.floor((F.col(a) - halo) / edge).cast("int"))
        last = F.least(F.lit(hi - 1), F.floor((F.col(a) + halo) / edge).cast("int"))
        out = out.withColumn(f"b{a}", F.explode(F.sequence(first, last)))
    return out.withColumn("core", _all(*[F.floor(F.col(a) / edge) == F.col(f"b{a}") for a in AXES]))


def around(rows: DataFrame, offsets: list[tuple[int, int, int]], keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row once at every offset place."""
    places = F.explode(F.array(*[F.struct(*[(F.col(a) + d).alias(a) for a, d in zip(AXES, o, strict=True)]) for o in offsets]))
    return rows.select(*keep, places.alias("_at")).select(*keep, "_at.*")


def refined(places: DataFrame, factor: int) -> DataFrame:
    """The factor^3 finer places that each place covers."""
    out = places
    for a in AXES:
        out = out.withColumn(a, F.explode(F.sequence(F.col(a) * factor, F.col(a) * factor + factor - 1)))
    return out


def even_window_starts(length: int, patch: int, step: int) -> list[int]:
    """Starts of windows of one size that cover a length at equal distances of ``step`` at most, the last at the end; rounded half to even."""
    if length < patch:
        raise ValueError(f"a length of {length} has no window of {patch}")
    gaps = math.ceil((length - patch) / step)
    return sorted({round(i * (length - patch) / gaps) for i in range(gaps + 1)}) if gaps else [0]


def fixed_stride_starts(length: int, window: int, stride: int) -> list[int]:
    """Starts every ``stride`` places as far as another window follows, and the last place where one fits."""
    if stride < 1:
        raise ValueError("windows must move on")
    last = max(0, length - window)
    return [*range(0, last, stride), last]


class Core(NamedTuple):
    """A window's start and the part of the extent, half-open, that only it is used for."""

    start: int
    low: int
    high: int


def partition_by_cores(extent: int, window: int, margin: int) -> list[Core]:
    """Windows whose cores partition the extent, each at least ``margin`` from its window's ends but at the ends of the extent."""
    if window >= extent:
        return [Core(0, 0, extent)]
    starts = fixed_stride_starts(extent, window, window - 2 * margin)
    cuts = [0, *(s + window - margin for s in starts[:-1]), extent]
    return [Core(s, *ends) for s, ends in zip(starts, itertools.pairwise(cuts), strict=True)]


def even_edges(size: int, tile: int) -> list[int]:
    """Edges of nearly equal tiles of ``tile`` at most; one tile for an empty size."""
    n = max(1, math.ceil(size / tile))
    return [round(i * size / n) for i in range(n + 1)]


def even_tile(place: Column, size: int, tile: int) -> tuple[Column, Column, Column]:
    """Number, low and high edge of the tile of :func:`even_edges` that holds a place, by division: the plan is as long for any number of tiles."""
    n = max(1, math.ceil(size / tile))
    edge = lambda i: F.rint(i * size / n).cast("int")
    near = F.floor(place * n / max(size, 1)).cast("int")
    number = F.when(place < edge(near), near - 1).when(place >= edge(near + 1), near + 1).otherwise(near)
    held = F.greatest(F.lit(0), F.least(F.lit(n - 1), number))
    return held, edge(held), edge(held + 1)


def field_tiling(patch: int, radius: int, pad: int = 2) -> tuple[int, int]:
    """Halo and step of windows of which a model sees ``radius`` voxels around each result: cores tile the volume, and only the halo is read twice.

    Raises ValueError if no core is left.
    """
    halo = radius + pad
    if patch <= 2 * halo:
        raise ValueError(f"a patch of {patch} leaves no core between halos of {halo}")
    return halo, patch - 2 * halo


def tile_boxes(size: tuple[int, int, int], tile: int, halo: int, patch: int) -> tuple[int, int, int]:
    """The largest box of any tile: core and halo, a patch at least on each axis."""
    longest = lambda n: max(b - a for a, b in itertools.pairwise(even_edges(n, tile)))
    return tuple(max(patch, longest(n) + 2 * halo) for n in size)


def fitted_tile(size: tuple[int, int, int], tile: int, halo: int, patch: int, channels: int, limit: int, step: int = 32, least: int = 32,
    width: int = 2) -> int:
    """The largest tile, ``step`` by ``step`` down from ``tile``, whose largest box's sums of ``channels`` and of their weights, ``width`` bytes each, fit in
    ``limit``.

    Raises MemoryError if even ``least`` doesn't fit.
    """
    need = lambda t: (channels + 1) * width * math.prod(tile_boxes(size, t, halo, patch))
    while need(tile) > limit:
        if tile - step < least:
            raise MemoryError(f"a tile of {tile} takes {need(tile)} bytes of {limit}")
        tile -= step
    return tile


def ramp_weight(index: Column, length: int, overlap: int) -> Column:
    """Linear weight of a place in a window, full beyond the overlap."""
    if overlap <= 0 or length <= 1:
        return F.lit(1.0)
    return F.least((F.least(index + 1, length - index)) / float(overlap + 1), F.lit(1.0))


def gaussian_weight(index: Column, patch: int, share: float = 0.125, least: float = 1e-3) -> Column:
    """Gaussian weight of a place in a window, with a sigma that is a share of the window."""
    d = (index - (patch - 1) / 2) / (patch * share)
    return F.greatest(F.exp(-0.5 * d * d), F.lit(least))
