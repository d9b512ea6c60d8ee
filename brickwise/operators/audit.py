"""Comparison of two masks of one volume: measures as rows, and rules on them that pass or fail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickwise.operators import aggregates, components, morphology, stencil
from brickwise.operators.grid import AXES
from brickwise.runtime import materialize, shuffled



def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def overlap(rows: DataFrame) -> DataFrame:
    """One row of shares and overlaps of the masks ``a`` and ``b``; null where a denominator is zero."""
    n = rows.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(c, 1)).alias(k) for k, c in (("na", F.col("a")), ("nb", F.col("b")), ("nab", F.col("a") &
        F.col("b")))])
    a, b, ab = F.col("na"), F.col("nb"), F.col("nab")
    return n.select(_ratio(a, F.col("n")).alias("share_a"), _ratio(b, F.col("n")).alias("share_b"), _ratio(2 * ab, a + b).alias("dice"),
        _ratio(ab, a + b - ab).alias("iou"), _ratio(ab, a).alias("a_inside_b"), _ratio(ab, b).alias("b_inside_a"))


def mask_measures(rows: DataFrame, mask: DataFrame, other: DataFrame, name: str, near: float, least: int) -> DataFrame:
    """One row of one mask's measures: its surface voxels, its components of ``least`` voxels or more and the largest, the median thickness at its crest, and
    the share of its crest within ``near`` voxels of the other mask."""
    rest = rows.select(*AXES).join(shuffled(mask), list(AXES), "left_anti")
    surface = stencil.touching(mask, rest).agg(F.count(F.lit(1)).alias(f"surface_{name}"))
    sizes = components.without_small(mask, least).groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    parts = sizes.agg(F.count(F.lit(1)).alias(f"components_{name}"), F.coalesce(F.max("size"), F.lit(0)).alias(f"largest_{name}"))
    deep = morphology.squared_distance(mask, rest).where("d2 is not null").select(*AXES, F.sqrt("d2").alias("depth"))
    crest = stencil.neighbour_extreme(deep, "depth", 1, True, "top").where("depth >= top - 0.5")
    crest = materialize(crest.select(*AXES, (2 * F.col("depth")).alias("thick"), F.lit(1).alias("one")), "crest")
    thick = aggregates.percentiles(crest, "thick", ["one"], {f"thickness_{name}": 0.5}).drop("one")
    apart = morphology.squared_distance(crest.select(*AXES), other)
    close = apart.agg(_ratio(F.count(F.when(F.col("d2") <= near * near, 1)), F.count(F.lit(1))).alias(f"crest_{name}_near"))
    return surface.crossJoin(parts).crossJoin(close).join(thick, how="left")  # one row each


def measures(rows: DataFrame, near: float = 3.0, least: int = 100) -> DataFrame:
    """(measure, value) of the masks ``a`` and ``b`` of rows (z, y, x, a, b), which both stores have; null where there is nothing to measure.

    Counts, overlaps and surfaces are sums that any number of tasks merge; components settle in rounds, distances line by line. Null counts as outside.
    """
    base = materialize(rows.select(*AXES, *[F.coalesce(c, F.lit(False)).alias(c) for c in "ab"]), "audit")
    masks = {c: base.where(c).select(*AXES) for c in "ab"}
    found = overlap(base)
    for c, o in ("ab", "ba"):
        found = found.crossJoin(mask_measures(base, masks[c], masks[o], c, near, least))  # one row each
    names = found.columns
    return found.select(F.explode(F.array(*[F.struct(F.lit(n).alias("measure"),
        F.col(n).cast("double").alias("value")) for n in names])).alias("m")).select("m.*")


def verdict(found: DataFrame, rules: dict[str, tuple[float, float]]) -> DataFrame:
    """(rule, value, low, high, passed): whether each measure that has a rule lies within its bounds; one that is null or missing fails."""
    bounds = F.create_map(*[x for k, (low, high) in rules.items() for x in (F.lit(k), F.struct(F.lit(float(low)).alias("low"),
        F.lit(float(high)).alias("high")))])
    listed = found.sparkSession.range(1).select(F.explode(bounds).alias("rule", "b")).select("rule", "b.low", "b.high")
    both = listed.join(found, listed["rule"] == found["measure"], "left")
    return both.select("rule", "value", "low", "high", F.coalesce(F.col("value").between(F.col("low"), F.col("high")), F.lit(False)).alias("passed"))
