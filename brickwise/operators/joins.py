"""Joins of aligned, shifted, resampled and nearest places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brickwise.functions.vectors import affine
from brickwise.operators.grid import AXES, _all
from brickwise.runtime import materialize, range_table, shuffled


def priority_merge(first: DataFrame, second: DataFrame, values: list[str], keys: list[str], valid: str = "valid") -> DataFrame:
    """Values of ``first`` where it is valid (1), else of ``second``; ``source`` says 1, 2 or 0 for neither.

    Validity is three-valued: 1 if either is 1, 0 if both are 0 (no data; values become 0), else 2. A missing row is 0.
    """
    a = first.select(*keys, F.col(valid).alias("_va"), *[F.col(v).alias(f"_a_{v}") for v in values])
    b = second.select(*keys, F.col(valid).alias("_vb"), *[F.col(v).alias(f"_b_{v}") for v in values])
    both = a.join(shuffled(b), keys, "full").withColumn("_va", F.coalesce("_va", F.lit(0))).withColumn("_vb", F.coalesce("_vb", F.lit(0)))
    one, two = F.col("_va") == 1, (F.col("_va") != 1) & (F.col("_vb") == 1)
    merged = F.when(one | two, 1).when((F.col("_va") == 0) & (F.col("_vb") == 0), 0).otherwise(2)
    pick = lambda v: F.when(merged == 0, 0).otherwise(F.coalesce(F.when(one, F.col(f"_a_{v}")).otherwise(F.col(f"_b_{v}")), F.lit(0))).alias(v)
    return both.select(*keys, *[pick(v) for v in values], merged.alias(valid), F.when(one, 1).when(two, 2).otherwise(0).alias("source"))


def coarse_join(fine: DataFrame, coarse: DataFrame, factor: int, offset: tuple[int, int, int] = (0, 0, 0), how: str = "left") -> DataFrame:
    """``fine`` with the columns of the coarse voxel that covers it: coarse i covers fine [i f, (i + 1) f), shifted by ``offset``."""
    keys = [f"_c{a}" for a in AXES]
    keyed = fine.withColumns({k: F.floor((F.col(a) + o) / factor).cast("int") for k, a, o in zip(keys, AXES, offset, strict=True)})
    renamed = coarse.select(*[F.col(a).alias(k) for a, k in zip(AXES, keys, strict=True)], *[c for c in coarse.columns if c not in AXES])
    return keyed.join(shuffled(renamed), keys, how).drop(*keys)


def affine_nearest(targets: DataFrame, source: DataFrame, matrix: list[list[float]], value: str, fill: int = 0) -> DataFrame:
    """``targets`` with the source value at the rounded image of each place (half to even); ``fill`` outside the source."""
    keys = [f"_s{a}" for a in AXES]
    image = affine(matrix, tuple(F.col(a).cast("double") for a in AXES))
    keyed = targets.withColumns({k: F.rint(c).cast("int") for k, c in zip(keys, image, strict=True)})
    renamed = source.select(*[F.col(a).alias(k) for a, k in zip(AXES, keys, strict=True)], value)
    return keyed.join(shuffled(renamed), keys, "left").withColumn(value, F.coalesce(value, F.lit(fill))).drop(*keys)


def trilinear(points: DataFrame, source: DataFrame, value: str, id_col: str = "id", at: tuple[str, str, str] = ("pz", "py", "px")) -> DataFrame:
    """(id, value): ``value`` between the eight voxels around each point; voxels that are missing count as 0."""
    corners = []
    for bits in range(8):
        near = [bits >> k & 1 for k in (2, 1, 0)]
        place = [(F.floor(F.col(c)).cast("int") + n).alias(a) for c, n, a in zip(at, near, AXES, strict=True)]
        part = [F.col(c) - F.floor(F.col(c)) if n else 1 - (F.col(c) - F.floor(F.col(c))) for c, n in zip(at, near, strict=True)]
        corners.append(F.struct(*place, (part[0] * part[1] * part[2]).alias("_w")))
    spread = points.select(id_col, F.explode(F.array(*corners)).alias("_c")).select(id_col, "_c.*").where("_w > 0")
    found = spread.join(shuffled(source.select(*AXES, value)), list(AXES), "left")
    return found.groupBy(id_col).agg(F.sum(F.col("_w") * F.coalesce(value, F.lit(0))).alias(value))


def doubled(coarse: DataFrame, values: list[str], edge: int = 16) -> DataFrame:
    """(z, y, x, values): the values between the eight voxels around the centre of every twice finer voxel that ``coarse`` covers; missing voxels count as 0.

    Voxels are dealt into blocks of ``edge`` with those beside them, ((edge + 2) / edge)^3 copies, the only shuffle. Within its block each is handed to the four finer
    places around it along one axis after the other and added up there.
    """
    blocks = [f"_b{a}" for a in AXES]
    out = coarse.select(*AXES, F.lit(1).alias("_own"), *[F.col(v).cast("double").alias(v) for v in values])
    for a, b in zip(AXES, blocks, strict=True):
        out = out.withColumn(b, F.explode(F.sequence(F.floor((F.col(a) - 1) / edge), F.floor((F.col(a) + 1) / edge))))
    out = out.repartition(*blocks)
    steps = F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.lit(w).alias("w"), F.lit(own).alias("own")) for s, w, own in ((-1, 0.25, 0), (0, 0.75, 1),
        (1, 0.75, 1), (2, 0.25, 0))]))
    for a, b in zip(AXES, blocks, strict=True):
        moved = out.withColumn("_k", steps).withColumn(a, (2 * F.col(a) + F.col("_k.s")).cast("int")).where(F.floor(F.col(a) / (2 * edge)) == F.col(b))
        sums = [F.sum(F.col(v) * F.col("_k.w")).alias(v) for v in values]
        out = moved.groupBy(*blocks, *AXES).agg(F.max(F.col("_own") * F.col("_k.own")).alias("_own"), *sums)
    return out.where("_own = 1").select(*AXES, *values)


def as_of_interpolated(probes: DataFrame, points: DataFrame, at: str, values: list[str], group: str | None = None) -> DataFrame:
    """``probes`` with each value interpolated linearly between the control points before and after, held at the ends.

    One sorted pass over probes and points together (the last point so far, the next one to come), not a range join. Of
    points at the same place, any may serve. Without a ``group`` column the rows are dealt into ordered ranges, each of which is
    passed on its own and told the last point of the ranges before it and the first of those after.
    """
    part = [group] if group else []
    tagged = points.select(*part, at, F.struct(F.col(at).cast("double").alias("at"), *[F.col(v).cast("double").alias(v) for v in values]).alias("_point"))
    rows = probes.withColumn("_probe", F.struct(*probes.columns)).select(*part, at, "_probe").unionByName(tagged.withColumn("_probe", F.lit(None)),
        allowMissingColumns=True)
    if not group:
        rows = range_table(rows, [at], "as-of")
        ends = rows.groupBy("_bw_part").agg(F.max("_point").alias("_last"), F.min("_point").alias("_first"))
        over = Window.orderBy("_bw_part")  # a row per range
        ends = ends.select(
            "_bw_part", F.last("_last", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"),
            F.first("_first", ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("_later"),
        )
        rows = rows.join(F.broadcast(ends), "_bw_part")
    else:
        rows = rows.withColumns({"_earlier": F.lit(None).cast(tagged.schema["_point"].dataType), "_later": F.lit(None).cast(tagged.schema["_point"].dataType)})
    order = Window.partitionBy(group or "_bw_part").orderBy(at, F.col("_probe").isNotNull())
    before = F.coalesce(F.last("_point", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.col("_earlier"))
    after = F.coalesce(F.first("_point", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)), F.col("_later"))
    out = rows.withColumn("_lo", F.coalesce(before, after)).withColumn("_hi", F.coalesce(after, before)).where("_probe is not null")
    gap = F.col("_hi.at") - F.col("_lo.at")
    share = F.when(gap > 0, (F.col(at) - F.col("_lo.at")) / gap).otherwise(0.0)
    mixed = [(F.col(f"_lo.{v}") + share * (F.col(f"_hi.{v}") - F.col(f"_lo.{v}"))).alias(v) for v in values]
    return out.select("_probe.*", *mixed)


def nearest(rows: DataFrame, targets: DataFrame, radius: int, keep: list[str], value: list[str]) -> DataFrame:
    """``rows`` with ``d2`` and the values of the nearest target within ``radius``, nulls beyond; of equals the lowest z, y, x.

    Targets are handed along one axis after the other, 2 radius + 1 copies each, and the nearest so far is kept at every place on the way: of the targets
    of one line the nearest is the nearest for all places across it. So the cost of a target is linear in the radius, and the rows meet theirs in an equi-join.
    """
    best = F.struct(F.lit(0).alias("d2"), *[F.col(a).alias(f"t{a}") for a in AXES], *[F.col(v).alias(v) for v in value])
    near = targets.select(*AXES, best.alias("_best"))
    for axis in reversed(AXES):
        step = F.col("_step")
        moved = near.withColumn("_step", F.explode(F.sequence(F.lit(-radius), F.lit(radius))))
        further = F.struct((F.col("_best.d2") + step * step).alias("d2"), *[F.col(f"_best.{c}").alias(c) for c in [*(f"t{a}" for a in AXES), *value]])
        places = [(F.col(a) + step).cast("int").alias(a) if a == axis else a for a in AXES]
        near = moved.select(*places, further.alias("_best")).where(F.col("_best.d2") <= radius * radius).groupBy(*AXES).agg(F.min("_best").alias("_best"))
    found = rows.select(*AXES, *keep).join(shuffled(near), list(AXES), "left")
    return found.select(*AXES, *keep, F.col("_best.d2").alias("d2"), *[F.col(f"_best.{v}").alias(f"near_{v}") for v in value])


def march(rows: DataFrame, body: DataFrame, direction: tuple[Column, Column, Column], steps: int, id_cols: list[str]) -> DataFrame:
    """Distinct ids of rows for which a rounded place on the ray of 1 to ``steps`` steps lies in the body."""
    k = F.col("_k")
    stepped = rows.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    places = stepped.select(*[F.col(c).alias(f"_id_{c}") for c in id_cols], *[F.rint(F.col(a) + k * d).cast("int").alias(a) for a, d in zip(AXES, direction,
        strict=True)])
    return places.join(shuffled(body.select(*AXES)), list(AXES), "left_semi").select(*[F.col(f"_id_{c}").alias(c) for c in id_cols]).distinct()


def box_overlap(boxes: DataFrame, others: DataFrame, size: int, cell: int, anti: bool = False, axes: tuple[str, ...] = AXES) -> DataFrame:
    """``boxes`` (cubes of one size at z, y, x) that overlap one of ``others``, or that overlap none if ``anti``.

    Both sides are keyed by the grid cells that they touch, so that the range condition runs within an equi-join.
    """
    def cells(rows: DataFrame, prefix: str) -> DataFrame:
        out = rows.select(*[F.col(a).alias(f"{prefix}{a}") for a in axes]).distinct()
        for a in axes:
            out = out.withColumn(f"_g{a}", F.explode(F.sequence(F.floor(F.col(f"{prefix}{a}") / cell), F.floor((F.col(f"{prefix}{a}") + size - 1) / cell))))
        return out

    left, right = cells(boxes, "_l"), cells(others, "_r")
    near = None
    for a in axes:
        gap = F.abs(F.col(f"_l{a}") - F.col(f"_r{a}")) < size
        near = gap if near is None else near & gap
    hit = left.join(right, [f"_g{a}" for a in axes]).where(near).select(*[F.col(f"_l{a}").alias(a) for a in axes]).distinct()
    return boxes.join(hit, list(axes), "left_anti" if anti else "left_semi")


def merge_intervals(rows: DataFrame, low: str, high: str, group: list[str] | None = None) -> DataFrame:
    """Maximal unions of closed intervals that touch or overlap.

    The rows are dealt into ordered ranges of group and low end; what reaches into a range from those before it, and how many unions
    have begun there, comes from a row per range and group.
    """
    keys = list(group or [])
    dealt = range_table(rows.select(*keys, low, high), [*keys, low], "intervals")
    earlier = Window.partitionBy(*keys).orderBy("_bw_part").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("_bw_part", *keys).orderBy(low, high)
    far = dealt.groupBy("_bw_part", *keys).agg(F.max(high).alias("_far")).withColumn("_far", F.max("_far").over(earlier))
    reach = F.greatest(F.max(high).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.col("_far"))
    met = dealt.join(far.withColumnsRenamed({"_bw_part": "_p", **{k: f"_k_{k}" for k in keys}}), _all(F.col("_bw_part") == F.col("_p"),
        *[F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]))
    marked = materialize(met.withColumn("_new", F.when(F.col(low) <= reach, 0).otherwise(1)).select("_bw_part", *keys, low, high, "_new"), "interval-starts")
    begun = marked.groupBy("_bw_part", *keys).agg(F.sum("_new").alias("_begun")).withColumn("_begun", F.coalesce(F.sum("_begun").over(earlier), F.lit(0)))
    begun = begun.withColumnsRenamed({"_bw_part": "_p", **{k: f"_k_{k}" for k in keys}})
    numbered = marked.join(begun, _all(F.col("_bw_part") == F.col("_p"), *[F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]))
    numbered = numbered.withColumn("_island", F.sum("_new").over(within) + F.col("_begun"))
    return numbered.groupBy(*keys, "_island").agg(F.min(low).alias(low), F.max(high).alias(high)).drop("_island")
