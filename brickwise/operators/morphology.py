"""Distances without a limit, closings by a ball and crests of masks, on voxel rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickwise.operators import stencil
from brickwise.operators.grid import AXES, box_grid
from brickwise.runtime import shuffled

#: Lines that are held together, on each side.
LINES = 8


def lowest_parabolas(place: np.ndarray, height: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the parabolas of height plus squared distance are lowest somewhere, in order of their ascending places, and where each hands over to the
    next.
    """
    kept: list[int] = []
    cuts: list[float] = []
    for i, (p, h) in enumerate(zip(place.tolist(), height.tolist(), strict=True)):
        while kept:
            q, g = place[kept[-1]], height[kept[-1]]
            cut = (h - g + p * p - q * q) / (2 * (p - q))
            if len(kept) == 1 or cut > cuts[-1]:
                cuts.append(cut)
                break
            kept.pop()
            cuts.pop()
        kept.append(i)
    return np.array(kept, dtype=np.int64), np.array(cuts)


def _along(rows: DataFrame, axis: str) -> DataFrame:
    """``d2`` of each row from the best row of its line along an axis, and that row's ``_of``, if there is such a column; a line without any stays null.

    Of equally near rows the one at the lower place is the best. LINES x LINES lines side by side are held by one task.
    """
    rest = [a for a in AXES if a != axis]

    def best(block: pa.Table) -> pa.Table:
        place, *across = (block.column(a).to_numpy() for a in (axis, *rest))
        height = np.asarray(block.column("d2").to_pandas(), dtype=np.float64)
        order = np.lexsort((place, *across))
        ends = np.nonzero(np.any([np.diff(c[order]) != 0 for c in across], axis=0))[0] + 1
        found, chosen = np.full(len(order), np.nan), np.full(len(order), -1)
        for line in np.split(order, ends):
            known = line[~np.isnan(height[line])]
            if len(known):
                tops, cuts = lowest_parabolas(place[known].astype(np.float64), height[known])
                chosen[line] = known[tops[np.searchsorted(cuts, place[line])]]
        hit = chosen >= 0
        found[hit] = height[chosen[hit]] + (place[hit] - place[chosen[hit]]).astype(np.float64) ** 2
        if "_of" in block.column_names:
            block = block.set_column(block.schema.get_field_index("_of"), "_of", block.column("_of").take(pa.array(chosen, mask=~hit)))
        return block.set_column(block.schema.get_field_index("d2"), "d2", pa.array(np.where(hit, found, 0).astype(np.int64), mask=~hit))

    return rows.groupBy(*[F.floor(F.col(a) / LINES).alias(f"_{a}") for a in rest]).applyInArrow(best, rows.schema)


def _enveloped(rows: DataFrame, marked: DataFrame) -> DataFrame:
    """All places of the box around both, with ``d2``, and ``_of`` if ``marked`` has it, of the nearest marked place; null if ``rows`` and ``marked`` are
    empty.
    """
    ends = rows.select(*AXES).union(marked.select(*AXES)).agg(*[f(a).alias(n + a) for a in AXES for f, n in ((F.min, "lo_"), (F.max, "hi_"))]).first()
    if ends["lo_z"] is None:
        return marked
    low = tuple(ends[f"lo_{a}"] for a in AXES)
    stations = box_grid(rows.sparkSession, low, tuple(ends[f"hi_{a}"] - lo + 1 for a, lo in zip(AXES, low, strict=True)))
    out = stations.join(shuffled(marked), list(AXES), "left")
    for axis in reversed(AXES):
        out = _along(out, axis)
    return out


def squared_distance(rows: DataFrame, targets: DataFrame, name: str = "d2") -> DataFrame:
    """``rows`` with the squared distance to the nearest of ``targets``, however far; null without any.

    All places of the box around both are way stations, so that gaps and ragged borders make no difference. Exact, one axis after the other: along a line
    the distance is the lower envelope of parabolas, linear in the line's length. Each pass is one shuffle by lines, whatever the number of targets.
    """
    marked = targets.select(*AXES, F.lit(0).cast("long").alias("d2")).distinct()
    return rows.join(shuffled(_enveloped(rows, marked).withColumnRenamed("d2", name)), list(AXES))


def nearest_of_all(rows: DataFrame, targets: DataFrame, values: list[str], name: str = "d2", prefix: str = "near_") -> DataFrame:
    """``rows`` with the squared distance to the nearest of ``targets`` and that one's ``values``, however far; nulls without any.

    Of equally near targets the one of the lowest z, then y, then x; targets at one place must be one. Cost as of :func:`squared_distance`.
    """
    marked = targets.select(*AXES, F.lit(0).cast("long").alias("d2"), F.struct(*values).alias("_of"))
    found = _enveloped(rows, marked).select(*AXES, F.col("d2").alias(name), *[F.col(f"_of.{v}").alias(prefix + v) for v in values])
    return rows.join(shuffled(found), list(AXES))


def close_ball(rows: DataFrame, mask: DataFrame, radius: float) -> DataFrame:
    """Places of ``rows`` in the closing of ``mask`` by a ball: what is within the radius of the mask, less what is within the radius of the rest."""
    near = squared_distance(rows.select(*AXES), mask, "_to_mask")
    grown = near.select(*AXES, F.coalesce(F.col("_to_mask") <= radius * radius, F.lit(False)).alias("_in"))
    back = squared_distance(grown, grown.where("not _in"), "_to_rest")
    return back.where(F.coalesce(F.col("_to_rest") > radius * radius, F.lit(True))).select(*AXES)


def crest(rows: DataFrame, mask: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Middle places of ``mask``: those whose distance to the rest of ``rows`` is within a tolerance of the largest around them."""
    rest = rows.select(*AXES).join(shuffled(mask.select(*AXES)), list(AXES), "left_anti")
    deep = squared_distance(rows.select(*AXES), rest).join(shuffled(mask.select(*AXES)), list(AXES), "left_semi").where(
        "d2 is not null").select(*AXES, F.sqrt("d2").alias("_depth"))
    return stencil.neighbour_extreme(deep, "_depth", 1, True, "_top").where(F.col("_depth") >= F.col("_top") - tolerance).select(*AXES)
