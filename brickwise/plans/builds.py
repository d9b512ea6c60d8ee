"""Queries that build derived channels: distances, resampling, exports, rays, augmentation, reports and chunk tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brickwise.functions import codec, vectors
from brickwise.operators import aggregates, grid, joins, losses, rays, sampling, stencil
from brickwise.plans.catalog import register
from brickwise.plans.stencils import _PERIOD_SQL, _RAY_SQL, event_rays
from brickwise.runtime import materialize
from brickwise.sources import chunks
from brickwise.sources.tables import table
from brickwise.sources.voxels import VOXELS_SQL, coded_voxels, voxels

AXES = list(grid.AXES)


@register("chunk_pack_box_read", f"""WITH {VOXELS_SQL} SELECT z, count(*) AS n, CAST(sum(u) AS BIGINT) AS total FROM coded WHERE z BETWEEN 3 AND 12
  AND y BETWEEN 5 AND 24 AND x BETWEEN 10 AND 27 GROUP BY z""")
def chunk_pack_box_read(spark: SparkSession, folder: str) -> DataFrame:
    """Voxels packed into chunk rows of eight voxels' edge, and a box read back from the chunks that it touches."""
    rows = coded_voxels(spark, folder).select(F.lit("s").alias("store"), F.lit("u").alias("channel"), *AXES, "u")
    box = chunks.read_box(chunks.pack(rows, 8), (3, 5, 10), (10, 20, 18), 8)
    return box.groupBy("z").agg(F.count(F.lit(1)).alias("n"), F.sum("u").alias("total"))


@register("channel_pivot", f"""WITH {VOXELS_SQL} SELECT vec_id, CAST(max(u) AS INT) AS sdf, max(valid) AS state, round(max(v), 6) AS value FROM coded
  GROUP BY vec_id""")
def channel_pivot(spark: SparkSession, folder: str) -> DataFrame:
    """Channels stored one row each, read side by side."""
    rows = coded_voxels(spark, folder)
    parts = [rows.select("vec_id", F.lit(n).alias("channel"), F.col(c).cast("double").alias("value")) for n, c in (("sdf", "u"), ("state", "valid"), ("value",
        "v"))]
    long = parts[0].unionByName(parts[1]).unionByName(parts[2])
    wide = long.groupBy("vec_id").pivot("channel", ["sdf", "state", "value"]).agg(F.max("value"))
    return wide.select("vec_id", F.col("sdf").cast("int").alias("sdf"), F.col("state").cast("int").alias("state"), F.round("value", 6).alias("value"))


@register("signed_distance_codes", f"""WITH {VOXELS_SQL}, m AS (SELECT z, y, x, u > 170 AS inside FROM coded),
o AS (SELECT a.z, a.y, a.x, a.inside, min((a.z-b.z)**2 + (a.y-b.y)**2 + (a.x-b.x)**2) AS d2 FROM m a LEFT JOIN m b ON b.inside <> a.inside
  AND b.z BETWEEN a.z-3 AND a.z+3 AND b.y BETWEEN a.y-3 AND a.y+3 AND b.x BETWEEN a.x-3 AND a.x+3 GROUP BY 1, 2, 3, 4),
s AS (SELECT CASE WHEN inside THEN -1 ELSE 1 END * CASE WHEN d2 IS NULL OR d2 > 9 THEN 3.0 ELSE sqrt(d2) END AS d FROM o)
SELECT CAST(least(255.0, greatest(1.0, round_even(128 + greatest(-3.0::DOUBLE, least(3.0::DOUBLE, d)) * (127.0::DOUBLE / 3.0::DOUBLE), 0))) AS INT) AS code,
  count(*) AS n FROM s GROUP BY 1""")
def signed_distance_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Signed distance of a mask, positive outside, saturating at three voxels, as bytes."""
    rows = coded_voxels(spark, folder).select(*AXES, (F.col("u") > 170).alias("inside"))
    out = stencil.distance_within(rows, rows.where("inside"), 3, "d_out")
    both = stencil.distance_within(out, rows.where("not inside"), 3, "d_in")
    far = lambda c: F.coalesce(F.sqrt(c), F.lit(3.0))
    signed = F.when(F.col("inside"), -far(F.col("d_in"))).otherwise(far(F.col("d_out")))
    return both.groupBy(codec.encode_sdf(signed, 3.0).alias("code")).agg(F.count(F.lit(1)).alias("n"))


@register("medial_thickness", f"""WITH {VOXELS_SQL}, m AS (SELECT z, y, x FROM coded WHERE u > 110), o AS (SELECT z, y, x FROM coded WHERE u <= 110),
d AS (SELECT m.z, m.y, m.x, min((m.z-o.z)**2 + (m.y-o.y)**2 + (m.x-o.x)**2) AS d2 FROM m JOIN o ON o.z BETWEEN m.z-3 AND m.z+3 AND o.y BETWEEN m.y-3 AND m.y+3
  AND o.x BETWEEN m.x-3 AND m.x+3 GROUP BY 1, 2, 3)
SELECT z, round(avg(2 * sqrt(d2) - 1), 6) AS mean, round(max(2 * sqrt(d2) - 1), 6) AS top FROM d WHERE d2 <= 9 GROUP BY z""")
def medial_thickness(spark: SparkSession, folder: str) -> DataFrame:
    """Twice the distance to the background less one, by layer."""
    rows = coded_voxels(spark, folder).select(*AXES, "u")
    d = stencil.distance_within(rows.where("u > 110"), rows.where("u <= 110"), 3).where("d2 is not null")
    thick = 2 * F.sqrt("d2") - 1
    return d.groupBy("z").agg(F.round(F.avg(thick), 6).alias("mean"), F.round(F.max(thick), 6).alias("top"))


@register("nearest_fill", f"""WITH {VOXELS_SQL}, s AS (SELECT z, y, x, u FROM coded WHERE u > 225), c AS (SELECT a.z, a.y, a.x,
  (a.z-s.z)**2 + (a.y-s.y)**2 + (a.x-s.x)**2 AS d2, s.z AS sz, s.y AS sy, s.x AS sx, s.u FROM coded a JOIN s ON s.z BETWEEN a.z-2 AND a.z+2
  AND s.y BETWEEN a.y-2 AND a.y+2 AND s.x BETWEEN a.x-2 AND a.x+2),
r AS (SELECT *, row_number() OVER (PARTITION BY z, y, x ORDER BY d2, sz, sy, sx) AS r FROM c WHERE d2 <= 4)
SELECT z, count(*) AS n, CAST(sum(u) AS BIGINT) AS total FROM r WHERE r = 1 GROUP BY z""")
def nearest_fill(spark: SparkSession, folder: str) -> DataFrame:
    """The code of the nearest marked voxel within two voxels; of equals the first in z, y, x."""
    rows = coded_voxels(spark, folder).select(*AXES, "u")
    filled = joins.nearest(rows, rows.where("u > 225"), 2, [], ["u"]).where("d2 is not null")
    return filled.groupBy("z").agg(F.count(F.lit(1)).alias("n"), F.sum("near_u").alias("total"))


@register("upsample_masked_trilinear", f"""WITH {VOXELS_SQL}, h AS (SELECT unnest(range(2)) AS d), g AS (SELECT c.z * 2 + a.d AS z, c.y * 2 + b.d AS y,
  c.x * 2 + e.d AS x FROM coded c, h a, h b, h e), q AS (SELECT *, (z + 0.5::DOUBLE) / 2 - 0.5::DOUBLE AS pz, (y + 0.5::DOUBLE) / 2 - 0.5::DOUBLE AS py,
  (x + 0.5::DOUBLE) / 2 - 0.5::DOUBLE AS px FROM g), o(n) AS (VALUES (0), (1)),
w AS (SELECT q.z AS gz, q.y AS gy, q.x AS gx, CAST(floor(pz) AS INT) + a.n AS z, CAST(floor(py) AS INT) + b.n AS y, CAST(floor(px) AS INT) + d.n AS x,
  (CASE a.n WHEN 1 THEN pz - floor(pz) ELSE 1 - (pz - floor(pz)) END) * (CASE b.n WHEN 1 THEN py - floor(py) ELSE 1 - (py - floor(py)) END) * (CASE d.n
  WHEN 1 THEN px - floor(px) ELSE 1 - (px - floor(px)) END) AS w FROM q, o a, o b, o d),
s AS (SELECT gz, gy, gx, sum(CASE WHEN valid = 1 THEN w * v ELSE 0 END) AS top, sum(CASE WHEN valid = 1 THEN w ELSE 0 END) AS part FROM w JOIN coded USING (z,
  y, x) GROUP BY 1, 2, 3)
SELECT CAST(gz AS INT) AS z, count(*) AS n, round(sum(top / part), 5) AS total FROM s WHERE part > 0.4 GROUP BY gz""")
def upsample_masked_trilinear(spark: SparkSession, folder: str) -> DataFrame:
    """Values at the centres of twice finer voxels, between valid voxels only, where these make up over 0.4 of the weight."""
    coarse = coded_voxels(spark, folder)
    one = F.when(F.col("valid") == 1, 1.0).otherwise(0.0)
    both = joins.doubled(coarse.select(*AXES, (one * F.col("v")).alias("t"), one.alias("p")), ["t", "p"]).where("p > 0.4")
    return both.groupBy("z").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("t") / F.col("p")), 5).alias("total"))


@register("export_pooled_bytes", f"""WITH {VOXELS_SQL}, p AS (SELECT z // 2 AS z, y // 2 AS y, x // 2 AS x, sum(CASE WHEN valid > 0 THEN v
  ELSE 0 END) / greatest(sum(CASE WHEN valid > 0 THEN 1 ELSE 0 END), 1.0::DOUBLE) AS v, sum(CASE WHEN valid > 0 THEN 1 ELSE 0 END) / 8.0 AS cover FROM coded
    GROUP BY 1, 2, 3)
SELECT CASE WHEN cover < 0.5 THEN 0 ELSE CAST(least(255.0, greatest(0.0, round_even(127.5 + 127.5 * v, 0))) AS INT) END AS code, count(*) AS n FROM p
  GROUP BY 1""")
def export_pooled_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """A pooled level as stored bytes, 0 where less than half is covered."""
    pooled = aggregates.pool(coded_voxels(spark, folder), 2, "v", F.col("valid") > 0)
    return pooled.groupBy(F.when(F.col("cover") < 0.5, 0).otherwise(codec.encode_signed(F.col("v"))).alias("code")).agg(F.count(F.lit(1)).alias("n"))


@register("radial_rays", f"""WITH {VOXELS_SQL}, l AS (SELECT DISTINCT z FROM vox WHERE z % 4 = 0), r AS (SELECT a.z, CAST(b.i AS INT) AS angle,
  CAST(k.i AS INT) AS k, 15.5::DOUBLE + k.i * sin(radians(b.i * 30)) AS py, 15.5::DOUBLE + k.i * cos(radians(b.i * 30)) AS px FROM l a, range(12) b(i),
  range(14) k(i)), o(n) AS (VALUES (0), (1)),
w AS (SELECT r.z, angle, k, CAST(floor(py) AS INT) + b.n AS y, CAST(floor(px) AS INT) + c.n AS x, (CASE b.n WHEN 1 THEN py - floor(py)
  ELSE 1 - (py - floor(py)) END) * (CASE c.n WHEN 1 THEN px - floor(px) ELSE 1 - (px - floor(px)) END) AS w FROM r, o b, o c)
SELECT z, angle, round(sum(w * coalesce(v, 0)), 4) AS total FROM w LEFT JOIN vox USING (z, y, x) GROUP BY z, angle""")
def radial_rays(spark: SparkSession, folder: str) -> DataFrame:
    """Samples along rays from the middle of every fourth layer, twelve angles, fourteen steps."""
    rows = voxels(spark, folder)
    layers = rows.select("z").where("z % 4 = 0").distinct()
    steps = layers.select("z", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("angle")).select("*", F.explode(F.sequence(F.lit(0), F.lit(13))).alias("k"))
    turn = F.radians(F.col("angle") * 30)
    points = steps.select(F.struct("z", "angle", "k").alias("id"), F.col("z").cast("double").alias("pz"), (15.5 + F.col("k") * F.sin(turn)).alias("py"),
        (15.5 + F.col("k") * F.cos(turn)).alias("px"))
    found = joins.trilinear(points, rows, "v")
    return found.groupBy(F.col("id.z").alias("z"), F.col("id.angle").alias("angle")).agg(F.round(F.sum("v"), 4).alias("total"))


@register("angle_to_mean_member", f"""WITH {VOXELS_SQL}, m AS (SELECT y, x, z // 8 AS member, avg(CASE z % 3 WHEN 0 THEN v END) AS a, avg(CASE z % 3
  WHEN 1 THEN v END) AS b, avg(CASE z % 3 WHEN 2 THEN v END) AS c FROM vox GROUP BY 1, 2, 3),
u AS (SELECT y, x, member, a / sqrt(a*a+b*b+c*c) AS a, b / sqrt(a*a+b*b+c*c) AS b, c / sqrt(a*a+b*b+c*c) AS c FROM m), g AS (SELECT y, x, avg(a) AS ma,
  avg(b) AS mb, avg(c) AS mc FROM u GROUP BY y, x),
d AS (SELECT u.member, degrees(acos(greatest(-1.0, least(1.0, (a*ma + b*mb + c*mc) / greatest(sqrt(ma*ma + mb*mb + mc*mc), 1e-9::DOUBLE))))) AS angle FROM u
  JOIN g USING (y, x))
SELECT member, round(avg(angle), 5) AS mean_angle, count(*) AS n FROM d GROUP BY member""")
def angle_to_mean_member(spark: SparkSession, folder: str) -> DataFrame:
    """Angle between each member's unit vector and the members' mean."""
    rows = voxels(spark, folder).withColumn("member", F.floor(F.col("z") / 8).cast("int"))
    part = lambda k: F.avg(F.when(F.col("z") % 3 == k, F.col("v")))
    m = rows.groupBy("y", "x", "member").agg(*[part(k).alias(n) for k, n in enumerate("abc")])
    u = m.select("y", "x", "member", *[c.alias(n) for n, c in zip("abc", vectors.unit((F.col("a"), F.col("b"), F.col("c")), 1e-12), strict=True)])
    w = Window.partitionBy("y", "x")
    mean = vectors.unit(tuple(F.avg(n).over(w) for n in "abc"), 1e-9)
    with_mean = u.select("member", "a", "b", "c", *[c.alias(f"m{n}") for n, c in zip("abc", mean, strict=True)])
    angle = vectors.angle_deg((F.col("a"), F.col("b"), F.col("c")), (F.col("ma"), F.col("mb"), F.col("mc")))
    return with_mean.groupBy("member").agg(F.round(F.avg(angle), 5).alias("mean_angle"), F.count(F.lit(1)).alias("n"))


@register("intensity_augment", f"""WITH {VOXELS_SQL}, f AS (SELECT vec_id, CAST(CAST('0x' || substr(md5(CAST(vec_id AS VARCHAR) || '|gamma'), 1,
  13) AS UBIGINT) AS DOUBLE) / 4503599627370496.0 AS g, CAST(CAST('0x' || substr(md5(CAST(vec_id AS VARCHAR) || '|contrast'), 1,
  13) AS UBIGINT) AS DOUBLE) / 4503599627370496.0 AS c FROM embeddings)
SELECT label, round(sum(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (pow(u / 255.0::DOUBLE,
  0.7::DOUBLE + 0.6::DOUBLE * g) - 0.5::DOUBLE) * (0.8::DOUBLE + 0.4::DOUBLE * c) + 0.5::DOUBLE))), 4) AS total FROM coded JOIN f USING (vec_id)
  GROUP BY label""")
def intensity_augment(spark: SparkSession, folder: str) -> DataFrame:
    """Gamma and contrast of each brick by the hash of its id: the same on every run and in any partitioning."""
    gamma = 0.7 + 0.6 * sampling.hash_unit("vec_id", salt="gamma")
    contrast = 0.8 + 0.4 * sampling.hash_unit("vec_id", salt="contrast")
    out = codec.clip((F.pow(F.col("u") / 255.0, gamma) - 0.5) * contrast + 0.5, 0.0, 1.0)
    return coded_voxels(spark, folder).groupBy("label").agg(F.round(F.sum(out), 4).alias("total"))


@register("spatial_flip_rotate", f"""WITH {VOXELS_SQL}, c AS (SELECT vec_id, z % 4 AS z, y % 4 AS y, x % 4 AS x, v FROM vox), t AS (SELECT vec_id, z,
  CASE vec_id % 4 WHEN 0 THEN y WHEN 1 THEN x WHEN 2 THEN 3 - y ELSE 3 - x END AS y, CASE vec_id % 4 WHEN 0 THEN x WHEN 1 THEN 3 - y WHEN 2 THEN 3 - x
  ELSE y END AS x, v FROM c)
SELECT z, y, x, round(avg(v), 6) AS mean FROM t GROUP BY z, y, x""")
def spatial_flip_rotate(spark: SparkSession, folder: str) -> DataFrame:
    """Each brick turned in plane by quarter turns of its id, and the mean brick."""
    turn, y, x = F.col("vec_id") % 4, F.col("y") % 4, F.col("x") % 4
    ty = F.when(turn == 0, y).when(turn == 1, x).when(turn == 2, 3 - y).otherwise(3 - x)
    tx = F.when(turn == 0, x).when(turn == 1, 3 - y).when(turn == 2, 3 - x).otherwise(y)
    rows = voxels(spark, folder).select((F.col("z") % 4).alias("z"), ty.alias("y"), tx.alias("x"), "v")
    return rows.groupBy("z", "y", "x").agg(F.round(F.avg("v"), 6).alias("mean"))


@register("hist_moments", f"""WITH {VOXELS_SQL} SELECT label, round(avg(u), 6) AS mean, round(stddev_pop(u), 6) AS std FROM coded GROUP BY label""")
def hist_moments(spark: SparkSession, folder: str) -> DataFrame:
    hist = coded_voxels(spark, folder).groupBy("label", "u").agg(F.count(F.lit(1)).alias("n"))
    sums = hist.groupBy("label").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("u")).alias("s"), F.sum(F.col("n") * F.col("u") * F.col("u")).alias("q"))
    mean = F.col("s") / F.col("n")
    return sums.select("label", F.round(mean, 6).alias("mean"), F.round(F.sqrt(F.col("q") / F.col("n") - mean * mean), 6).alias("std"))


@register("curvature_split", f"""WITH {VOXELS_SQL}, {'steps(dz, dy, dx) AS (VALUES (1,0,0), (-1,0,0), (0,1,0), (0,-1,0), (0,0,1), (0,0,-1))'},
  l AS (SELECT a.z, a.y, a.x, a.u, sum(b.u - a.u) AS lap, count(*) AS n FROM coded a, steps s, coded b WHERE b.z = a.z + s.dz AND b.y = a.y + s.dy
  AND b.x = a.x + s.dx GROUP BY 1, 2, 3, 4 HAVING count(*) = 6), q AS (SELECT median(abs(lap)) AS mid FROM l)
SELECT abs(lap) > mid AS curved, count(*) AS n, CAST(sum(u) AS BIGINT) AS total FROM l, q GROUP BY 1""")
def curvature_split(spark: SparkSession, folder: str) -> DataFrame:
    """Inner voxels with a Laplacian above its median size, and the others."""
    rows = coded_voxels(spark, folder).select(*AXES, "u")
    sums = grid.around(rows, grid.FACES, ("u",)).groupBy(*AXES).agg(F.sum("u").alias("s"), F.count(F.lit(1)).alias("n"))
    l = rows.join(sums.where("n = 6"), AXES).withColumn("lap", F.abs(F.col("s") - 6 * F.col("u")))
    l = materialize(l, "laplacian")
    mid = aggregates.percentiles(l.withColumn("all", F.lit(1)), "lap", ["all"], {"mid": 0.5}).drop("all")
    return l.crossJoin(F.broadcast(mid)).groupBy((F.col("lap") > F.col("mid")).alias("curved")).agg(F.count(F.lit(1)).alias("n"),
        F.sum("u").alias("total"))  # mid: one row


@register("eikonal_residual", f"""WITH {VOXELS_SQL}, g AS (SELECT z, (CASE WHEN lead(z) OVER wz = z + 1
  AND lag(z) OVER wz = z - 1 THEN (lead(v) OVER wz - lag(v) OVER wz) / 2 END) * 8 AS gz, (CASE WHEN lead(y) OVER wy = y + 1
    AND lag(y) OVER wy = y - 1 THEN (lead(v) OVER wy - lag(v) OVER wy) / 2 END) * 8 AS gy,
  (CASE WHEN lead(x) OVER wx = x + 1 AND lag(x) OVER wx = x - 1 THEN (lead(v) OVER wx - lag(v) OVER wx) / 2 END) * 8 AS gx
  FROM vox WINDOW wz AS (PARTITION BY y, x ORDER BY z), wy AS (PARTITION BY z, x ORDER BY y), wx AS (PARTITION BY z, y ORDER BY x))
SELECT z, count(*) AS n, round(avg((sqrt(gz*gz + gy*gy + gx*gx) - 1)**2), 6) AS residual FROM g WHERE gz IS NOT NULL AND gy IS NOT NULL AND gx IS NOT NULL
  GROUP BY z""")
def eikonal_residual(spark: SparkSession, folder: str) -> DataFrame:
    """Mean squared difference of the gradient's length from one, at voxels with all six neighbours."""
    rows = voxels(spark, folder).withColumns({f"g{a}": stencil.central_difference("v",
        a) * 8 for a in AXES}).where("gz is not null and gy is not null and gx is not null")
    off = vectors.norm((F.col("gz"), F.col("gy"), F.col("gx"))) - 1
    return rows.groupBy("z").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(off * off), 6).alias("residual"))


@register("swap_invariant_loss", f"""WITH {VOXELS_SQL}, s AS (SELECT vec_id, label,
  avg(abs(v * 40 + 3 - (v * 40 - 2)) + abs(v * 40 - 3 - (v * 40 + 2 + x % 2))) AS straight,
  avg(abs(v * 40 + 3 - (v * 40 + 2 + x % 2)) + abs(v * 40 - 3 - (v * 40 - 2))) AS swapped FROM vox GROUP BY 1, 2)
SELECT label, round(avg(least(straight, swapped)), 6) AS loss, count(*) FILTER (WHERE swapped < straight) AS n_swapped FROM s GROUP BY label""")
def swap_invariant_loss(spark: SparkSession, folder: str) -> DataFrame:
    """Per brick the cheaper assignment of two predicted faces to two target faces."""
    p, q = F.col("v") * 40 + 3, F.col("v") * 40 - 3
    s, t = F.col("v") * 40 - 2, F.col("v") * 40 + 2 + F.col("x") % 2
    per = voxels(spark, folder).groupBy("vec_id", "label").agg(F.avg(F.abs(p - s) + F.abs(q - t)).alias("straight"),
        F.avg(F.abs(p - t) + F.abs(q - s)).alias("swapped"))
    return per.groupBy("label").agg(F.round(F.avg(losses.swap_invariant(F.col("straight"), F.col("swapped"))), 6).alias("loss"),
        F.count(F.when(F.col("swapped") < F.col("straight"), 1)).alias("n_swapped"))


@register("report_deltas", f"""WITH {VOXELS_SQL}, m AS (SELECT label, avg(v) AS mean, max(v) AS top FROM vox GROUP BY label), b AS (SELECT mean, top FROM m
  WHERE label = 0)
SELECT label, round(m.mean - b.mean, 6) AS d_mean, round(m.top - b.top, 6) AS d_top, CASE WHEN m.mean > b.mean THEN 'better' WHEN m.mean < b.mean THEN 'worse'
  ELSE 'same' END AS verdict FROM m, b""")
def report_deltas(spark: SparkSession, folder: str) -> DataFrame:
    """Each variant's measures less those of the base."""
    m = voxels(spark, folder).groupBy("label").agg(F.avg("v").alias("mean"), F.max("v").alias("top"))
    base = m.where("label = 0").select(F.col("mean").alias("b_mean"), F.col("top").alias("b_top"))
    d = F.col("mean") - F.col("b_mean")
    verdict = F.when(d > 0, "better").when(d < 0, "worse").otherwise("same")
    return m.crossJoin(F.broadcast(base)).select("label", F.round(d, 6).alias("d_mean"), F.round(F.col("top") - F.col("b_top"), 6).alias("d_top"),
        verdict.alias("verdict"))  # base: one row


@register("side_of_nearest_face", f"""WITH {VOXELS_SQL}, p AS (SELECT z, y, x FROM coded WHERE u > 235), i AS (SELECT z, y, x FROM coded WHERE u BETWEEN 60
  AND 70), o AS (SELECT z, y, x FROM coded WHERE u BETWEEN 180 AND 190),
di AS (SELECT p.z, p.y, p.x, min((p.z-i.z)**2 + (p.y-i.y)**2 + (p.x-i.x)**2) AS d FROM p LEFT JOIN i ON i.z BETWEEN p.z-3 AND p.z+3 AND i.y BETWEEN p.y-3
  AND p.y+3 AND i.x BETWEEN p.x-3 AND p.x+3 AND (p.z-i.z)**2 + (p.y-i.y)**2 + (p.x-i.x)**2 <= 9 GROUP BY 1, 2, 3),
d_o AS (SELECT p.z, p.y, p.x, min((p.z-o.z)**2 + (p.y-o.y)**2 + (p.x-o.x)**2) AS d FROM p LEFT JOIN o ON o.z BETWEEN p.z-3 AND p.z+3 AND o.y BETWEEN p.y-3
  AND p.y+3 AND o.x BETWEEN p.x-3 AND p.x+3 AND (p.z-o.z)**2 + (p.y-o.y)**2 + (p.x-o.x)**2 <= 9 GROUP BY 1, 2, 3)
SELECT CASE WHEN coalesce(di.d, 99) < coalesce(d_o.d, 99) THEN 'inner' WHEN coalesce(di.d, 99) > coalesce(d_o.d, 99) THEN 'outer' ELSE 'tie' END AS side,
  count(*) AS n FROM di JOIN d_o USING (z, y, x) GROUP BY 1""")
def side_of_nearest_face(spark: SparkSession, folder: str) -> DataFrame:
    """Which of two faces is nearer to each marked voxel, within three voxels."""
    rows = coded_voxels(spark, folder).select(*AXES, "u")
    p = rows.where("u > 235").select(*AXES)
    inner = joins.nearest(p, rows.where("u between 60 and 70"), 3, [], []).withColumnRenamed("d2", "di")
    both = joins.nearest(inner, rows.where("u between 180 and 190"), 3, ["di"], [])
    a, b = F.coalesce("di", F.lit(99)), F.coalesce("d2", F.lit(99))
    return both.groupBy(F.when(a < b, "inner").when(a > b, "outer").otherwise("tie").alias("side")).agg(F.count(F.lit(1)).alias("n"))


@register("grid_cell_crop_scores", f"""WITH {VOXELS_SQL}, c AS (SELECT z // 4 AS cz, y // 8 AS cy, x // 8 AS cx, count(*) FILTER (WHERE valid = 1) AS n,
  sum(u) FILTER (WHERE valid = 1) AS s, sum(u * u) FILTER (WHERE valid = 1) AS q FROM coded GROUP BY 1, 2, 3)
SELECT cz, cy, cx, round(sqrt(greatest(q / n - (s / n)**2, 0)) / (s / n), 6) AS cv FROM c WHERE n >= 128""")
def grid_cell_crop_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Coefficient of variation of supervised codes per cell with enough of them."""
    one, u = F.col("valid") == 1, F.col("u").cast("long")
    c = coded_voxels(spark, folder).groupBy(F.floor(F.col("z") / 4).cast("int").alias("cz"), F.floor(F.col("y") / 8).cast("int").alias("cy"),
        F.floor(F.col("x") / 8).cast("int").alias("cx")).agg(F.count(F.when(one, 1)).alias("n"), F.sum(F.when(one, u)).alias("s"), F.sum(F.when(one,
            u * u)).alias("q"))
    mean = F.col("s") / F.col("n")
    return c.where("n >= 128").select("cz", "cy", "cx", F.round(F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))) / mean, 6).alias("cv"))


@register("ray_autocorrelation", f"""WITH {_RAY_SQL}, m AS (SELECT ray_id, k, coalesce(v, 0) - avg(coalesce(v, 0)) OVER (PARTITION BY ray_id) AS c FROM ray),
p AS (SELECT ray_id, sum(c * c) AS power FROM m GROUP BY ray_id), g AS (SELECT a.ray_id, b.k - a.k AS lag, sum(a.c * b.c) AS s FROM m a
  JOIN m b ON a.ray_id = b.ray_id AND b.k > a.k
  GROUP BY 1, 2)
SELECT ray_id, CAST(min(lag) FILTER (WHERE power > 0 AND s / power < exp(-1)) AS DOUBLE) AS lag FROM p LEFT JOIN g USING (ray_id) GROUP BY ray_id""")
def ray_autocorrelation(spark: SparkSession, folder: str) -> DataFrame:
    """First lag at which each ray's autocorrelation falls below 1/e."""
    return rays.autocorrelation_length(event_rays(spark, folder))


@register("windings_per_period", f"""WITH {_RAY_SQL}, sp AS (SELECT ray_id, k, v, valid, s * 8 AS start FROM ray, LATERAL (SELECT unnest(range(greatest(0,
  CAST(ceil((k - 15) / 8.0) AS BIGINT)),
  k // 8 + 1)) AS s)),
fu AS (SELECT ray_id, start, avg(v) AS mean FROM sp GROUP BY 1, 2 HAVING count(*) = 16 AND avg(CASE WHEN valid THEN 1.0::DOUBLE ELSE 0 END) >= 0.8),
ke AS (SELECT sp.* FROM sp JOIN fu USING (ray_id, start)){_PERIOD_SQL.format(more="start, ", parts=", start", rows="ke", most=8, least=3)}
SELECT ray_id, start, round(mean * period, 6) AS amount FROM fu JOIN pd USING (ray_id, start)""")
def windings_per_period(spark: SparkSession, folder: str) -> DataFrame:
    """Per ray and window of sixteen samples, four fifths of them valid: mean value times the dominant period."""
    return rays.per_period(event_rays(spark, folder), 16, 8, 3.0, 8.0, 0.8)


@register("ray_gate", """WITH ray AS (SELECT user_id AS ray_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, value AS v FROM events),
  s AS (SELECT ray_id, v, lag(v) OVER (PARTITION BY ray_id ORDER BY k) AS b FROM ray), r AS (SELECT ray_id, bool_and(isfinite(v)) AS finite, avg(CASE
  WHEN v >= b THEN 1.0 ELSE 0.0 END) FILTER (WHERE b IS NOT NULL) AS rising, median(v) AS mid FROM s GROUP BY ray_id)
SELECT count(*) AS n, count(*) FILTER (WHERE finite AND rising >= 0.45) AS n_rising, count(*) FILTER (WHERE abs(mid - 20) <= 15) AS n_near FROM r""")
def ray_gate(spark: SparkSession, folder: str) -> DataFrame:
    """How many rays pass: finite, rising often enough, with a median near a value."""
    before = F.lag("v").over(Window.partitionBy("ray_id").orderBy("k"))
    s = event_rays(spark, folder).withColumn("b", before)
    r = s.groupBy("ray_id").agg(F.bool_and(~F.isnan("v") & (F.abs("v") < float("inf"))).alias("finite"), F.avg(F.when(F.col("b").isNotNull(),
        (F.col("v") >= F.col("b")).cast("double"))).alias("rising"), F.median("v").alias("mid"))
    return r.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("finite") & (F.col("rising") >= 0.45), 1)).alias("n_rising"),
        F.count(F.when(F.abs(F.col("mid") - 20) <= 15, 1)).alias("n_near"))


@register("brick_checksums", f"""WITH {VOXELS_SQL} SELECT vec_id, md5(string_agg(CAST(u AS VARCHAR), ',' ORDER BY z, y, x)) AS digest FROM coded
  GROUP BY vec_id""")
def brick_checksums(spark: SparkSession, folder: str) -> DataFrame:
    """A digest of each brick's codes in order, as for provenance of an exported crop."""
    item = F.array_sort(F.collect_list(F.struct(*AXES, F.col("u").cast("string").alias("u"))))  # 64 voxels
    return coded_voxels(spark, folder).groupBy("vec_id").agg(F.md5(F.array_join(F.transform(item, lambda p: p["u"]), ",").cast("binary")).alias("digest"))


@register("store_union_schema", f"""WITH {VOXELS_SQL}, a AS (SELECT 0 AS store, count(*) AS n, CAST(sum(u) AS BIGINT) AS total, 0 AS n_extra FROM coded
  WHERE label < 5), b AS (SELECT 1 AS store, count(*) AS n, CAST(sum(u) AS BIGINT) AS total, count(valid) AS n_extra FROM coded WHERE label >= 5) SELECT *
    FROM a UNION ALL SELECT * FROM b""")
def store_union_schema(spark: SparkSession, folder: str) -> DataFrame:
    """Two stores of which only one has an optional channel, as one table with the store's number."""
    rows = coded_voxels(spark, folder)
    both = rows.where("label < 5").select(F.lit(0).alias("store"), *AXES, "u").unionByName(rows.where("label >= 5").select(F.lit(1).alias("store"), *AXES,
        "u", F.col("valid").alias("extra")), allowMissingColumns=True)
    return both.groupBy("store").agg(F.count(F.lit(1)).alias("n"), F.sum("u").alias("total"), F.count("extra").alias("n_extra"))


@register("lineitem_block_scan", """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_tax), 6) AS avg_tax FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02'
  GROUP BY 1, 2""")
def lineitem_block_scan(spark: SparkSession, folder: str) -> DataFrame:
    """One-pass conditional sums over a pruned scan."""
    rows = table(spark, folder, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_tax"), 6).alias("avg_tax"))
