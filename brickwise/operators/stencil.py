"""Neighbourhood operators on voxel rows: equi-joins at shifted places, and windows along an axis."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from brickwise.operators.grid import AXES, FACES, around
from brickwise.runtime import shuffled


def line(axis: str) -> WindowSpec:
    """Rows along one axis in order."""
    return Window.partitionBy(*[a for a in AXES if a != axis]).orderBy(axis)


def at_offset(value: Column | str, axis: str, step: int) -> Column:
    """Value ``step`` places further along the axis, null where there is no row at that place (gaps included)."""
    w = line(axis)
    far = F.lead if step > 0 else F.lag
    place = far(F.col(axis), abs(step)).over(w)
    return F.when(place == F.col(axis) + step, far(value, abs(step)).over(w))


def touching(rows: DataFrame, others: DataFrame, offsets: list[tuple[int, int, int]] = FACES) -> DataFrame:
    """Rows that have one of ``others`` at one of the offsets."""
    return rows.join(shuffled(around(others, [tuple(-c for c in o) for o in offsets]).distinct()), list(AXES), "left_semi")


def neighbour_count(rows: DataFrame, members: DataFrame, offsets: list[tuple[int, int, int]] = FACES, name: str = "n") -> DataFrame:
    """``rows`` with the number of members at the offsets, 0 included."""
    counts = around(members, [tuple(-c for c in o) for o in offsets]).groupBy(*AXES).agg(F.count(F.lit(1)).alias(name))
    return rows.join(shuffled(counts), list(AXES), "left").withColumn(name, F.coalesce(name, F.lit(0)))


def zero_crossing(rows: DataFrame, inside: Column, outside: Column) -> DataFrame:
    """Rows that are inside and have an outside row at a face."""
    return touching(rows.where(inside), rows.where(outside).select(*AXES))


def _spread(rows: DataFrame, value: str, radius: int, combine: Callable[[str], Column], cost: Callable[[Column], Column] | None = None) -> DataFrame:
    """(z, y, x, value): ``value`` handed to all places of the cube around its row and combined there.

    One axis after the other: each pass repeats a row 2 radius + 1 times and combines before the shuffle. Places without rows take part
    as way stations, so that gaps and ragged borders give the same result as the whole cube would. ``cost`` of the step adds to the value.
    """
    out = rows.select(*AXES, value)
    for axis in AXES:
        moved = out.select(*AXES, value, F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("_step"))
        held = F.col(value) + cost(F.col("_step")) if cost else F.col(value)
        out = moved.select(*[(F.col(a) + F.col("_step")).alias(a) if a == axis else a for a in AXES],
            held.alias(value)).groupBy(*AXES).agg(combine(value).alias(value))
    return out


def spread_extreme(rows: DataFrame, value: str, radius: int, largest: bool) -> DataFrame:
    """(z, y, x, value): the extreme of ``value`` over the cube around every place that a row reaches, whether it has a row or not."""
    return _spread(rows, value, radius, F.max if largest else F.min)


def neighbour_extreme(rows: DataFrame, value: str, radius: int, largest: bool, name: str) -> DataFrame:
    """``rows`` with the extreme of ``value`` over the cube around each, itself included."""
    found = _spread(rows, value, radius, F.max if largest else F.min).withColumnRenamed(value, name)
    return rows.join(shuffled(found), list(AXES))


def box_mean(rows: DataFrame, value: str, radius: int, name: str) -> DataFrame:
    """``rows`` with the mean over the cube of this radius, places without rows counting as zero."""
    found = _spread(rows, value, radius, F.sum).select(*AXES, (F.col(value) / (2 * radius + 1) ** 3).alias(name))
    return rows.join(shuffled(found), list(AXES))


def gaussian(rows: DataFrame, value: str, sigma: float, name: str, truncate: float = 3.0) -> DataFrame:
    """``rows`` smoothed one axis after the other by a truncated gaussian over existing places, renormalised at borders."""
    radius = max(1, int(truncate * sigma + 0.5))
    out, last = rows, value
    for axis in AXES:
        pairs = F.collect_list(F.struct(F.col(axis).alias("at"), F.col(last).alias("v"))).over(line(axis).rangeBetween(-radius, radius))
        out = out.withColumn("_near", pairs)
        out = out.withColumn(name, _weighed("_near", axis, sigma, True) / _weighed("_near", axis, sigma, False)).drop("_near")
        last = name
    return out


def _weighed(array: str, axis: str, sigma: float, values: bool) -> Column:
    """Sum of the gaussian weights of the places in an array, times their values or not."""
    weight = lambda p: F.exp(-0.5 * F.pow((p["at"] - F.col(axis)) / sigma, F.lit(2.0)))
    return F.aggregate(array, F.lit(0.0), lambda acc, p: acc + (weight(p) * p["v"] if values else weight(p)))


def central_difference(value: str, axis: str) -> Column:
    """Half the difference of the next and the previous place, null at borders and gaps."""
    return (at_offset(value, axis, 1) - at_offset(value, axis, -1)) / 2


def ridge(gradient: str, axis: str) -> Column:
    """Whether a gradient along an axis changes its sign to the next place."""
    return F.coalesce(F.col(gradient) * at_offset(gradient, axis, 1) < 0, F.lit(False))


def dilate(rows: DataFrame, radius: int = 1, within: DataFrame | None = None) -> DataFrame:
    """Places of ``rows`` and all in the cube around each, kept to the places of ``within``; one axis after the other, 2 radius + 1 copies each."""
    grown = rows.select(*AXES)
    for axis in AXES:
        steps = F.explode(F.sequence(F.lit(-radius), F.lit(radius)))
        grown = grown.withColumn("_step", steps).select(*[(F.col(a) + F.col("_step")).alias(a) if a == axis else a for a in AXES]).distinct()
    return grown.join(shuffled(within.select(*AXES)), list(AXES), "left_semi") if within is not None else grown


def erode(rows: DataFrame, radius: int, within: DataFrame) -> DataFrame:
    """Places of ``rows`` with no place of ``within`` that isn't one of ``rows`` in the cube around."""
    outside = within.select(*AXES).join(shuffled(rows.select(*AXES)), list(AXES), "left_anti")
    return rows.select(*AXES).join(shuffled(dilate(outside, radius)), list(AXES), "left_anti")


def close(rows: DataFrame, radius: int, within: DataFrame) -> DataFrame:
    return erode(dilate(rows, radius, within), radius, within)


def distance_within(rows: DataFrame, targets: DataFrame, limit: int, name: str = "d2") -> DataFrame:
    """``rows`` with the squared distance to the nearest target, null beyond ``limit``; exact within it.

    Separable, so that the cost of a target is linear in the limit along each axis, not that of a ball.
    """
    near = _spread(targets.select(*AXES, F.lit(0).alias(name)), name, limit, F.min, lambda step: step * step).where(F.col(name) <= limit * limit)
    return rows.join(shuffled(near), list(AXES), "left")
