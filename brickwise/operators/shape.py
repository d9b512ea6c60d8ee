"""Local shape of sheets: offsets to the centre plane, and windowed thickness and incoherence of normals from sums over blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickwise.functions import codec, vectors
from brickwise.operators import joins
from brickwise.operators.grid import AXES
from brickwise.operators.stencil import line

#: The window's sigma in voxels, of which each 1.5 make the blocks a voxel coarser, up to four; and where the window is cut, in sigmas.
SIGMA, COARSE_SIGMA, COARSEST, TRUNCATE = 8.0, 1.5, 4, 3.0
#: A normal must be longer than a half to count.
LEAST_NORMAL = 0.5
#: Products of parts of the normal that make up its scatter; the trace is the body's share.
_SCATTER = {"zz": (0, 0), "yy": (1, 1), "xx": (2, 2), "zy": (0, 1), "zx": (0, 2), "yx": (1, 2)}


def coarse_factor(sigma: float = SIGMA) -> int:
    """Edge of the blocks that a window of this sigma is summed over."""
    return max(1, min(COARSEST, int(sigma // COARSE_SIGMA)))


def windowed_sums(rows: DataFrame, values: list[str], sigma: float, truncate: float = TRUNCATE) -> DataFrame:
    """``rows`` with each value's gaussian-weighted sum over existing places around, one axis after the other; for ratios, in which the weights' scale cancels.

    A place meets at most 2 truncate sigma + 1 others on a line at once, whatever the line's length.
    """
    radius = max(1, int(truncate * sigma + 0.5))
    out = rows
    for axis in AXES:
        near = F.collect_list(F.struct(F.col(axis).alias("at"), *values)).over(line(axis).rangeBetween(-radius, radius))
        weight = lambda p, a=axis: F.exp(-0.5 * F.pow((p["at"] - F.col(a)) / sigma, F.lit(2.0)))
        total = lambda v, w=weight: F.aggregate("_near", F.lit(0.0), lambda acc, p: acc + w(p) * p[v])
        out = out.withColumn("_near", near).withColumns({v: total(v) for v in values}).drop("_near")
    return out


def shape_targets(rows: DataFrame, inner: Column, outer: Column, valid: Column, normal: vectors.Vec, sigma: float = SIGMA, clip: float = codec.SDF_CLIP,
    factor: int | None = None) -> DataFrame:
    """(z, y, x, off_z, off_y, off_x, thick, incoherence, valid) of every row, from the signed distances to both faces and the outward normal.

    Only voxels between the faces that are supervised (valid is 1) and have a normal count; the others have zeros and valid 0. The offset leads from the
    voxel to the centre plane, along the normal, half the difference of the distances long. Thickness, the sum of both distances within twice the clip, and
    normals are summed up over blocks of ``factor`` voxels (:func:`coarse_factor`), and these over a gaussian window, each divided by the body's share of
    the window. Incoherence is one less the largest eigenvalue's share of the scatter of the blocks' mean normals: 0 where sheets are flat, a half where two
    cross, 2/3 at most. Nulls in a distance, a normal or validity make a voxel one that doesn't count. Blocks at borders are as large as the rows in them.
    """
    block = coarse_factor(sigma) if factor is None else max(1, factor)
    counts = F.coalesce(codec.in_body(inner, outer) & (valid == 1) & (vectors.norm(normal) > LEAST_NORMAL), F.lit(False))
    near_in, near_out = F.abs(inner), F.abs(outer)
    thick = F.greatest(F.lit(0.0), F.least(F.lit(2.0 * clip), near_in + near_out))
    held = lambda c: F.when(F.col("_body"), c).otherwise(0.0)
    voxel = rows.withColumn("_body", counts)
    voxel = voxel.select(*AXES, "_body", *[held(n * (near_out - near_in) * 0.5).alias(f"off_{a}") for a, n in zip(AXES, normal, strict=True)],
        held(thick).alias("_thick"), *[held(n).alias(f"_n{a}") for a, n in zip(AXES, normal, strict=True)])
    keys = [F.floor(F.col(a) / block).cast("int").alias(a) for a in AXES]
    sums = voxel.groupBy(*keys).agg(F.avg(held(F.lit(1.0))).alias("share"), F.avg("_thick").alias("thick"), *[F.sum(f"_n{a}").alias(f"n{a}") for a in AXES])
    mean = vectors.unit(tuple(F.col(f"n{a}") for a in AXES))
    blocks = sums.select(*AXES, "share", "thick", *[(mean[i] * mean[j] * F.col("share")).alias(k) for k, (i, j) in _SCATTER.items()])
    window = windowed_sums(blocks, ["share", "thick", *_SCATTER], sigma / block)
    trace = F.col("zz") + F.col("yy") + F.col("xx")
    largest = vectors.max_eigenvalue_sym3(*[F.col(k) / trace for k in _SCATTER])
    known = window.select(*AXES, F.when(F.col("share") > 0, F.col("thick") / F.col("share")).alias("_windowed"),
        F.when(trace > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - largest))).alias("_incoherence"))
    both = joins.coarse_join(voxel, known, block)
    shown = lambda c: F.when(F.col("_body"), F.coalesce(c, F.lit(0.0))).otherwise(0.0)
    return both.select(*AXES, *[f"off_{a}" for a in AXES], shown(F.col("_windowed")).alias("thick"), shown(F.col("_incoherence")).alias("incoherence"),
        F.col("_body").cast("int").alias("valid"))
