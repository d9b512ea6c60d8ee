"""Scores of a predicted body against drawn bands, whichever side a band is of: sums and distances over the whole volume, so that no voxel counts twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickwise.operators import aggregates, components, morphology, stencil
from brickwise.operators.grid import AXES
from brickwise.runtime import materialize, shuffled

SIDES = ("pred_to_band", "band_to_pred", "symmetric")


def distance_summary(distances: DataFrame, sides: tuple[str, ...] = SIDES) -> DataFrame:
    """(side, n, mean, median, p90, frac_gt3, frac_gt5) of rows (side, d) of the first two sides, and of both together as the third; all nulls but n for a
    side without rows.
    """
    one, two, both = sides
    every = materialize(distances.unionByName(distances.withColumn("side", F.lit(both))), "distances")
    share = lambda t: F.avg(F.when(F.col("d") > t, 1.0).otherwise(0.0)).alias(f"frac_gt{t}")
    sums = every.groupBy("side").agg(F.count("d").alias("n"), F.avg("d").alias("mean"), share(3), share(5))
    ends = aggregates.percentiles(every, "d", ["side"], {"median": 0.5, "p90": 0.9})
    names = distances.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, sides))).alias("side"))
    found = names.join(sums, "side", "left").join(ends, "side", "left")
    return found.select("side", F.coalesce("n", F.lit(0)).alias("n"), "mean", "median", "p90", "frac_gt3", "frac_gt5")


def body_pass(rows: DataFrame, near: int = 12, tolerance: int = 2, least: int = 32) -> tuple[DataFrame, DataFrame]:
    """Two frames: one row (n_near, n_pred, n_band, dice), and :func:`distance_summary` of both ways, of rows (z, y, x, pred, band).

    The reference is the crest of all bands together, without components of less than ``least`` voxels; the prediction counts within ``near`` voxels of a
    band. ``dice`` is the share of both whose cube of ``tolerance`` holds one of the other, null if there is neither. As no side is named, nothing changes
    when the predicted faces are swapped. Null counts as not predicted and as no band. Everything is a sum over voxels or a distance, so that the result is
    the same however the rows are dealt out.
    """
    base = materialize(rows.select(*AXES, *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("pred", "band")]), "body-rows")
    drawn = base.where("band").select(*AXES)
    close = materialize(stencil.distance_within(base, drawn, near, "_d2").where("_d2 is not null").select(*AXES, "pred"), "near-band")
    pred = close.where("pred").select(*AXES)
    large = materialize(components.without_small(drawn, least).select(*AXES), "large-bands")
    band = materialize(morphology.crest(base.select(*AXES), large), "band-crest")
    hit = pred.join(shuffled(stencil.dilate(band, tolerance)), list(AXES), "left_semi").unionAll(band.join(shuffled(stencil.dilate(pred, tolerance)), list(AXES),
        "left_semi"))
    count = lambda frame, name: frame.agg(F.count(F.lit(1)).alias(name))
    counts = count(close, "n_near").crossJoin(count(pred, "n_pred")).crossJoin(count(band, "n_band")).crossJoin(count(hit, "_hit"))  # one row each
    total = F.col("n_pred") + F.col("n_band")
    one = counts.select("n_near", "n_pred", "n_band", F.when(total > 0, F.col("_hit") / total).alias("dice"))
    ways = [morphology.squared_distance(a, b).where("d2 is not null").select(F.lit(side).alias("side"), F.sqrt("d2").alias("d")) for side, a, b in ((SIDES[0],
        pred, band),
        (SIDES[1], band, pred))]
    return one, distance_summary(ways[0].unionByName(ways[1]))
