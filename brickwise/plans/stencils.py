"""Queries on neighbourhoods of voxels, along-axis windows and rays."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brickwise.operators import grid, rays, stencil
from brickwise.plans.catalog import register
from brickwise.sources.tables import table
from brickwise.sources.voxels import VOXELS_SQL, coded_voxels

_STEPS_SQL = "steps(dz, dy, dx) AS (VALUES (1,0,0), (-1,0,0), (0,1,0), (0,-1,0), (0,0,1), (0,0,-1))"


@register("surface_zero_crossing", f"""WITH {VOXELS_SQL}, {_STEPS_SQL}, hit AS (
  SELECT DISTINCT a.z, a.y, a.x, a.label, a.u FROM coded a, steps s, coded b
  WHERE a.u <= 128 AND a.valid <> 0 AND b.u > 128 AND b.valid <> 0 AND b.z = a.z + s.dz AND b.y = a.y + s.dy AND b.x = a.x + s.dx)
SELECT label, count(*) AS n_surface, CAST(sum(u) AS BIGINT) AS sum_code FROM hit GROUP BY label""")
def surface_zero_crossing(spark: SparkSession, folder: str) -> DataFrame:
    rows = coded_voxels(spark, folder).where("valid <> 0")
    hit = stencil.zero_crossing(rows, F.col("u") <= 128, F.col("u") > 128)
    return hit.groupBy("label").agg(F.count(F.lit(1)).alias("n_surface"), F.sum("u").alias("sum_code"))


@register("neighbour_count6", f"""WITH {VOXELS_SQL}, {_STEPS_SQL}, m AS (SELECT * FROM coded WHERE u > 150),
c AS (SELECT a.z, a.y, a.x, count(b.z) AS n FROM m a CROSS JOIN steps s LEFT JOIN m b ON b.z = a.z + s.dz AND b.y = a.y + s.dy AND b.x = a.x + s.dx
  GROUP BY 1, 2, 3)
SELECT n AS neighbours, count(*) AS voxels FROM c GROUP BY n""")
def neighbour_count6(spark: SparkSession, folder: str) -> DataFrame:
    m = coded_voxels(spark, folder).where("u > 150").select(*grid.AXES)
    return stencil.neighbour_count(m, m).groupBy(F.col("n").alias("neighbours")).agg(F.count(F.lit(1)).alias("voxels"))


@register("thin_shell", f"""WITH {VOXELS_SQL}, {_STEPS_SQL}, m AS (SELECT * FROM coded WHERE u <= 150), o AS (SELECT * FROM coded WHERE u > 150)
SELECT z, count(*) AS n FROM (SELECT DISTINCT m.z, m.y, m.x FROM m, steps s, o WHERE o.z = m.z + s.dz AND o.y = m.y + s.dy AND o.x = m.x + s.dx) GROUP BY z""")
def thin_shell(spark: SparkSession, folder: str) -> DataFrame:
    rows = coded_voxels(spark, folder)
    return stencil.zero_crossing(rows, F.col("u") <= 150, F.col("u") > 150).groupBy("z").agg(F.count(F.lit(1)).alias("n"))


@register("central_gradient", f"""WITH {VOXELS_SQL}, g AS (
  SELECT a.z, (c.u - b.u) / 2.0 AS gx FROM coded a JOIN coded b ON b.z = a.z AND b.y = a.y AND b.x = a.x - 1 JOIN coded c ON c.z = a.z AND c.y = a.y
  AND c.x = a.x + 1)
SELECT z, count(*) AS n, CAST(sum(CAST(gx * 2 AS INT)) AS BIGINT) AS sum_twice, CAST(max(gx) AS DOUBLE) AS steepest FROM g GROUP BY z""")
def central_gradient(spark: SparkSession, folder: str) -> DataFrame:
    rows = coded_voxels(spark, folder).withColumn("gx", stencil.central_difference("u", "x")).where("gx is not null")
    return rows.groupBy("z").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("gx") * 2).cast("int")).alias("sum_twice"), F.max("gx").alias("steepest"))


@register("gradient_ridge", f"""WITH {VOXELS_SQL}, g AS (
  SELECT a.z, a.y, a.x, (c.u - b.u) / 2.0 AS gx FROM coded a JOIN coded b ON b.z = a.z AND b.y = a.y AND b.x = a.x - 1 JOIN coded c ON c.z = a.z AND c.y = a.y
  AND c.x = a.x + 1)
SELECT g.z, count(*) AS n_ridge FROM g JOIN g h ON h.z = g.z AND h.y = g.y AND h.x = g.x + 1 WHERE g.gx * h.gx < 0 GROUP BY g.z""")
def gradient_ridge(spark: SparkSession, folder: str) -> DataFrame:
    rows = coded_voxels(spark, folder).withColumn("gx", stencil.central_difference("u", "x"))
    return rows.withColumn("turns", stencil.ridge("gx", "x")).where("turns").groupBy("z").agg(F.count(F.lit(1)).alias("n_ridge"))


@register("box_filter_3", f"""WITH {VOXELS_SQL}, m AS (SELECT a.z, a.y, a.x, sum(b.u) AS s FROM coded a JOIN coded b ON b.z BETWEEN a.z - 1 AND a.z + 1
  AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY 1, 2, 3)
SELECT z, CAST(sum(s) AS BIGINT) AS sum_box, CAST(max(s) AS BIGINT) AS max_box FROM m GROUP BY z""")
def box_filter_3(spark: SparkSession, folder: str) -> DataFrame:
    """Sums of the 27 codes around each voxel, by layer."""
    rows = stencil.box_mean(coded_voxels(spark, folder).select(*grid.AXES, "u"), "u", 1, "m").withColumn("s", F.rint(F.col("m") * 27).cast("long"))
    return rows.groupBy("z").agg(F.sum("s").alias("sum_box"), F.max("s").alias("max_box"))


@register("medial_ridge_max26", f"""WITH {VOXELS_SQL}, m AS (SELECT a.z, a.y, a.x, a.u, max(b.u) AS top FROM coded a JOIN coded b ON b.z BETWEEN a.z - 1
  AND a.z + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY 1, 2, 3, 4)
SELECT z, count(*) AS n, CAST(sum(u) AS BIGINT) AS sum_code FROM m WHERE u > 128 AND u >= top - 1 GROUP BY z""")
def medial_ridge_max26(spark: SparkSession, folder: str) -> DataFrame:
    rows = stencil.neighbour_extreme(coded_voxels(spark, folder).select(*grid.AXES, "u"), "u", 1, True, "top")
    return rows.where("u > 128 and u >= top - 1").groupBy("z").agg(F.count(F.lit(1)).alias("n"), F.sum("u").alias("sum_code"))


@register("body_skin_and_valley", f"""WITH {VOXELS_SQL}, {_STEPS_SQL}, d AS (SELECT z, y, x, abs(u - 128) AS d, u > 128 AS body FROM coded),
skin AS (SELECT DISTINCT a.z, a.y, a.x FROM d a, steps s, d b WHERE a.body AND NOT b.body AND b.z = a.z + s.dz AND b.y = a.y + s.dy AND b.x = a.x + s.dx),
low AS (SELECT a.z, a.y, a.x, a.d, min(b.d) AS least_d FROM d a JOIN d b ON b.z BETWEEN a.z - 1 AND a.z + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1
  AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY 1, 2, 3, 4),
valley AS (SELECT z, y, x FROM low WHERE d - least_d <= 1 AND d <= 4)
SELECT z, count(*) AS n FROM (SELECT * FROM skin UNION SELECT * FROM valley) GROUP BY z""")
def body_skin_and_valley(spark: SparkSession, folder: str) -> DataFrame:
    rows = coded_voxels(spark, folder).select(*grid.AXES, F.abs(F.col("u") - 128).alias("d"), (F.col("u") > 128).alias("body"))
    skin = stencil.zero_crossing(rows, F.col("body"), ~F.col("body")).select(*grid.AXES)
    valley = stencil.neighbour_extreme(rows, "d", 1, False, "low").where("d - low <= 1 and d <= 4").select(*grid.AXES)
    return skin.union(valley).distinct().groupBy("z").agg(F.count(F.lit(1)).alias("n"))


@register("dilate_close_gaps", f"""WITH {VOXELS_SQL}, m AS (SELECT z, y, x FROM coded WHERE u > 190),
grown AS (SELECT DISTINCT v.z, v.y, v.x FROM coded v JOIN m ON m.z BETWEEN v.z - 1 AND v.z + 1 AND m.y BETWEEN v.y - 1 AND v.y + 1 AND m.x BETWEEN v.x - 1
  AND v.x + 1),
outside AS (SELECT z, y, x FROM coded EXCEPT SELECT * FROM grown),
closed AS (SELECT * FROM grown g WHERE NOT EXISTS (SELECT 1 FROM outside o WHERE o.z BETWEEN g.z - 1 AND g.z + 1 AND o.y BETWEEN g.y - 1 AND g.y + 1
  AND o.x BETWEEN g.x - 1 AND g.x + 1))
SELECT (SELECT count(*) FROM m) AS n_mask, (SELECT count(*) FROM grown) AS n_grown, (SELECT count(*) FROM closed) AS n_closed, (SELECT count(*) FROM (SELECT *
  FROM closed EXCEPT SELECT * FROM m)) AS n_gap""")
def dilate_close_gaps(spark: SparkSession, folder: str) -> DataFrame:
    every = coded_voxels(spark, folder).select(*grid.AXES, "u")
    m = every.where("u > 190").select(*grid.AXES)
    grown = stencil.dilate(m, 1, every)
    closed = stencil.erode(grown, 1, every)
    gap = closed.join(m, list(grid.AXES), "left_anti")
    parts = [("n_mask", m), ("n_grown", grown), ("n_closed", closed), ("n_gap", gap)]
    tagged = parts[0][1].select(F.lit(parts[0][0]).alias("part"))
    for name, rows in parts[1:]:
        tagged = tagged.unionByName(rows.select(F.lit(name).alias("part")))
    return tagged.agg(*[F.count(F.when(F.col("part") == name, 1)).alias(name) for name, _ in parts])


@register("distance_to_surface", f"""WITH {VOXELS_SQL}, t AS (SELECT z, y, x FROM coded WHERE u > 215),
d AS (SELECT a.z, a.y, a.x, min((a.z - t.z)**2 + (a.y - t.y)**2 + (a.x - t.x)**2) AS d2 FROM coded a JOIN t ON t.z BETWEEN a.z - 3 AND a.z + 3
  AND t.y BETWEEN a.y - 3 AND a.y + 3 AND t.x BETWEEN a.x - 3 AND a.x + 3 GROUP BY 1, 2, 3)
SELECT CAST(d2 AS BIGINT) AS d2, count(*) AS n FROM d WHERE d2 <= 9 GROUP BY 1""")
def distance_to_surface(spark: SparkSession, folder: str) -> DataFrame:
    rows = coded_voxels(spark, folder).select(*grid.AXES, "u")
    found = stencil.distance_within(rows, rows.where("u > 215"), 3)
    return found.where("d2 is not null").groupBy(F.col("d2").cast("long").alias("d2")).agg(F.count(F.lit(1)).alias("n"))


def _smoothed_sql(source: str, axis: str, value: str) -> str:
    """One pass of a gaussian of sigma 1 along an axis, over places within three of each, their weights made to add up to one."""
    rest = [a for a in grid.AXES if a != axis]
    same = " AND ".join(f"b.{a} = a.{a}" for a in rest)
    return (
        f"SELECT a.z, a.y, a.x, sum(exp(-0.5::DOUBLE * (b.{axis} - a.{axis})**2) * b.{value}) / sum(exp(-0.5::DOUBLE * (b.{axis} - a.{axis})**2)) AS s "
        f"FROM {source} a JOIN {source} b ON {same} AND b.{axis} BETWEEN a.{axis} - 3 AND a.{axis} + 3 GROUP BY 1, 2, 3"
    )


@register("smoothed_threshold_mask", f"""WITH {VOXELS_SQL}, {_STEPS_SQL}, sz AS ({_smoothed_sql("coded", "z", "u")}), sy AS ({_smoothed_sql("sz", "y", "s")}),
  sx AS ({_smoothed_sql("sy", "x", "s")}),
m AS (SELECT z, y, x FROM sx WHERE s > 140), t AS (SELECT DISTINCT c.z, c.y, c.x FROM coded c, steps d, m WHERE m.z = c.z + d.dz AND m.y = c.y + d.dy
  AND m.x = c.x + d.dx)
SELECT z, count(*) AS n FROM (SELECT * FROM m UNION SELECT * FROM t) GROUP BY z""")
def smoothed_threshold_mask(spark: SparkSession, folder: str) -> DataFrame:
    """Voxels whose gaussian-smoothed code passes a threshold, dilated by a face, by layer."""
    rows = coded_voxels(spark, folder).select(*grid.AXES, F.col("u").cast("double").alias("u"))
    mask = stencil.gaussian(rows, "u", 1.0, "smooth").where("smooth > 140").select(*grid.AXES)
    grown = mask.union(stencil.touching(rows.select(*grid.AXES), mask)).distinct()
    return grown.groupBy("z").agg(F.count(F.lit(1)).alias("n"))


_RAY_SQL = "ray AS (SELECT user_id AS ray_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, value AS v, event_type <> 'error' AS valid FROM events)"


def event_rays(spark: SparkSession, folder: str) -> DataFrame:
    """(ray_id, k, v, valid): the events of each user as ordered samples."""
    events = table(spark, folder, "events").select(F.col("user_id").alias("ray_id"), F.struct("ts", "event_id").alias("k"), F.col("value").alias("v"),
        (F.col("event_type") != "error").alias("valid"))
    return rays.summed(events, {"_n": F.lit(1)}).select("ray_id", (F.col("_n") - 1).alias("k"), "v", "valid")


@register("phase_unwrap", f"""WITH {_RAY_SQL}, a AS (SELECT ray_id, k, v % (2 * pi()) - pi() AS angle FROM ray WHERE valid AND v IS NOT NULL),
d AS (SELECT *, angle - lag(angle) OVER (PARTITION BY ray_id ORDER BY k) AS step FROM a),
w AS (SELECT *, CASE WHEN step > pi() THEN -1 WHEN step < -pi() THEN 1 ELSE 0 END AS wrap FROM d),
s AS (SELECT ray_id, k, sum(wrap) OVER (PARTITION BY ray_id ORDER BY k) AS wraps FROM w)
SELECT ray_id, CAST(max(wraps) AS BIGINT) AS most_wraps, CAST(min(wraps) AS BIGINT) AS least_wraps, count(*) AS n FROM s GROUP BY ray_id""")
def phase_unwrap(spark: SparkSession, folder: str) -> DataFrame:
    import math

    samples = event_rays(spark, folder).where("valid and v is not null").withColumn("angle", F.col("v") % (2 * math.pi) - math.pi)
    return rays.unwrap(samples, "angle").groupBy("ray_id").agg(F.max("wraps").alias("most_wraps"), F.min("wraps").alias("least_wraps"),
        F.count(F.lit(1)).alias("n"))


@register("run_lengths", f"""WITH {_RAY_SQL}, f AS (SELECT *, coalesce(v > 50, false) AS high FROM ray),
g AS (SELECT *, k - row_number() OVER (PARTITION BY ray_id, high ORDER BY k) AS run FROM f),
r AS (SELECT ray_id, run, min(k) AS start, count(*) AS length, max(k) AS finish FROM g WHERE high GROUP BY ray_id, run),
n AS (SELECT ray_id, max(k) AS last_k FROM ray GROUP BY ray_id)
SELECT length, count(*) AS runs FROM r JOIN n USING (ray_id) WHERE start > 0 AND finish < last_k GROUP BY length""")
def run_lengths(spark: SparkSession, folder: str) -> DataFrame:
    runs = rays.runs(event_rays(spark, folder), F.coalesce(F.col("v") > 50, F.lit(False)))
    return runs.where("inner_run").groupBy("length").agg(F.count(F.lit(1)).alias("runs"))


@register("local_maxima", f"""WITH {_RAY_SQL}, w AS (SELECT *, lag(v) OVER o AS before, lead(v) OVER o AS after FROM ray WINDOW o AS (PARTITION BY ray_id
  ORDER BY k))
SELECT ray_id, count(*) AS peaks, max(v) AS highest FROM w WHERE v >= before AND v > after AND v >= 60 GROUP BY ray_id""")
def local_maxima(spark: SparkSession, folder: str) -> DataFrame:
    return rays.local_maxima(event_rays(spark, folder), 60.0).groupBy("ray_id").agg(F.count(F.lit(1)).alias("peaks"), F.max("v").alias("highest"))


@register("spaced_peaks", f"""WITH RECURSIVE {_RAY_SQL}, w AS (SELECT *, lag(v) OVER o AS before, lead(v) OVER o AS after
  FROM ray WINDOW o AS (PARTITION BY ray_id ORDER BY k)),
p AS (SELECT ray_id, k, v, row_number() OVER (PARTITION BY ray_id ORDER BY v DESC, k) AS r FROM w WHERE v >= before AND v > after AND v >= 40),
g AS (SELECT DISTINCT ray_id, 0::BIGINT AS r, []::BIGINT[] AS taken FROM p
  UNION ALL SELECT g.ray_id, p.r, CASE WHEN len(list_filter(g.taken, lambda t: abs(t - p.k) < 3)) = 0 THEN list_append(g.taken, p.k) ELSE g.taken END FROM g
    JOIN p ON p.ray_id = g.ray_id AND p.r = g.r + 1)
SELECT p.ray_id, p.k, p.v FROM p JOIN (SELECT ray_id, arg_max(taken, r) AS taken FROM g GROUP BY ray_id) t ON t.ray_id = p.ray_id AND list_contains(t.taken,
  p.k)""")
def spaced_peaks(spark: SparkSession, folder: str) -> DataFrame:
    """Peaks of each ray, highest first, none within three samples of a higher one that was taken."""
    return rays.spaced_peaks(rays.local_maxima(event_rays(spark, folder), 40.0), 3)


_PERIOD_SQL = """, m AS (SELECT ray_id, {more}k, coalesce(v, 0) - avg(coalesce(v, 0)) OVER w AS c, count(*) OVER w AS n,
  row_number() OVER (PARTITION BY ray_id{parts} ORDER BY k) - 1 AS i
  FROM {rows} WINDOW w AS (PARTITION BY ray_id{parts})),
q AS (SELECT ray_id, {more}n, j, sum(c * cos(2 * pi() * j * i / n)) AS re, sum(c * sin(2 * pi() * j * i / n)) AS im FROM m, LATERAL (SELECT unnest(range(0,
  n // 2 + 1)) AS j)
  GROUP BY ray_id, {more}n, j),
pd AS (SELECT ray_id, {more}arg_max(round(1 / (j * (1.0::DOUBLE / n)), 6), sqrt(re * re + im * im)) FILTER (WHERE j * (1.0::DOUBLE / n) >= 1.0::DOUBLE / {most}
  AND j * (1.0::DOUBLE / n) <= 1.0::DOUBLE / {least}) AS period FROM q GROUP BY ray_id{parts})"""


@register("dominant_period", f"WITH {_RAY_SQL}{_PERIOD_SQL.format(more='', parts='', rows='ray', most=16, least=3)} SELECT ray_id, period FROM pd")
def dominant_period(spark: SparkSession, folder: str) -> DataFrame:
    """Period of the largest Fourier amplitude of each ray, between 3 and 16 samples."""
    return rays.dominant_period(event_rays(spark, folder), 3.0, 16.0)


@register("windings_between_peaks", f"""WITH {_RAY_SQL}, w AS (SELECT *, lag(v) OVER o AS before, lead(v) OVER o AS after, sum(coalesce(v,
  0)) OVER (PARTITION BY ray_id ORDER BY k) AS total FROM ray WINDOW o AS (PARTITION BY ray_id ORDER BY k)),
p AS (SELECT ray_id, k, total, lead(k) OVER o AS next_k, lead(total) OVER o AS next_total FROM w WHERE v >= before AND v > after
  AND v >= 60 WINDOW o AS (PARTITION BY ray_id ORDER BY k))
SELECT ray_id, count(*) AS gaps, CAST(sum(next_k - k) AS BIGINT) AS samples, round(sum(next_total - total), 4) AS amount FROM p WHERE next_k IS NOT NULL
  GROUP BY ray_id""")
def windings_between_peaks(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("ray_id").orderBy("k")
    summed = rays.summed(event_rays(spark, folder), {"total": F.coalesce("v", F.lit(0.0))})
    peaks = rays.local_maxima(summed, 60.0).withColumn("next_k", F.lead("k").over(w)).withColumn("next_total", F.lead("total").over(w))
    found = peaks.where("next_k is not null")
    return found.groupBy("ray_id").agg(F.count(F.lit(1)).alias("gaps"), F.sum(F.col("next_k") - F.col("k")).alias("samples"),
        F.round(F.sum(F.col("next_total") - F.col("total")), 4).alias("amount"))
