"""Queries on boxes, merges, resampling, pooling and overlap of voxel tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brickwise.functions.vectors import circular_mean_turns
from brickwise.operators import aggregates, grid, joins, stencil
from brickwise.operators.components import connected_components
from brickwise.plans.catalog import register
from brickwise.runtime import broadcast_if_small
from brickwise.sources.tables import table
from brickwise.sources.voxels import VOXELS_SQL, coded_voxels, voxels

AXES = list(grid.AXES)


@register("read_box_zero_padded", f"""WITH {VOXELS_SQL}, g AS (SELECT CAST(a.i - 2 AS INT) AS z, CAST(b.i + 20 AS INT) AS y, CAST(c.i + 25 AS INT) AS x
  FROM range(10) a(i), range(16) b(i), range(12) c(i))
SELECT z, y, x, coalesce(u, 0) AS u FROM g LEFT JOIN coded USING (z, y, x)""")
def read_box_zero_padded(spark: SparkSession, folder: str) -> DataFrame:
    return grid.read_box(coded_voxels(spark, folder), (-2, 20, 25), (10, 16, 12), "u")


@register("read_box_edge_padded", f"""WITH {VOXELS_SQL}, g AS (SELECT CAST(a.i - 2 AS INT) AS z, CAST(b.i + 20 AS INT) AS y, CAST(c.i + 25 AS INT) AS x
  FROM range(10) a(i), range(16) b(i), range(12) c(i))
SELECT g.z, g.y, g.x, coalesce(u, 0) AS u FROM g LEFT JOIN coded v ON v.z = greatest(0, least((SELECT max(z) FROM coded), g.z)) AND v.y = greatest(0,
  least(31, g.y)) AND v.x = greatest(0, least(31, g.x))""")
def read_box_edge_padded(spark: SparkSession, folder: str) -> DataFrame:
    layers = (voxels(spark, folder).agg(F.max("z").alias("z")).first()["z"] or 0) + 1
    return grid.read_box(coded_voxels(spark, folder), (-2, 20, 25), (10, 16, 12), "u", edge=True, extent=(layers, 32, 32))


@register("halo_bricks", f"""WITH {VOXELS_SQL}, b AS (SELECT i.i AS bz, j.i AS by_, k.i AS bx FROM (SELECT DISTINCT z // 8 AS i FROM coded) i, range(4) j(i),
  range(4) k(i))
SELECT CAST(bz AS INT) AS bz, CAST(by_ AS INT) AS by, CAST(bx AS INT) AS bx, count(*) AS n, count(*) FILTER (WHERE z // 8 = bz AND y // 8 = by_
  AND x // 8 = bx) AS n_core, CAST(sum(u) AS BIGINT) AS sum_code
FROM b JOIN coded ON z BETWEEN bz * 8 - 2 AND bz * 8 + 9 AND y BETWEEN by_ * 8 - 2 AND by_ * 8 + 9 AND x BETWEEN bx * 8 - 2 AND bx * 8 + 9 GROUP BY 1, 2, 3""")
def halo_bricks(spark: SparkSession, folder: str) -> DataFrame:
    layers = (voxels(spark, folder).agg(F.max("z").alias("z")).first()["z"] or 0) + 1
    rows = grid.with_halo(coded_voxels(spark, folder), 8, 2, (0, 0, 0), (-(-layers // 8), 4, 4))
    return rows.groupBy("bz", "by", "bx").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("core"), 1)).alias("n_core"), F.sum("u").alias("sum_code"))


@register("window_plan_weights", f"""WITH {VOXELS_SQL}, s(start) AS (VALUES (0), (5), (10), (15), (20))
SELECT x, count(DISTINCT start) AS n_windows, round(sum(least(least(x - start + 1, 12 - (x - start)) / 7.0::DOUBLE, 1.0::DOUBLE)), 6) AS weight FROM vox, s
  WHERE x >= start AND x < start + 12 GROUP BY x""")
def window_plan_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Voxels covered by evenly spaced windows along x, with the number of windows and their total ramp weight."""
    starts = grid.even_window_starts(32, 12, 6)
    rows = coded_voxels(spark, folder).select("z", "y", "x", "u")
    windows = rows.withColumn("start", F.explode(F.array(*map(F.lit, starts)))).where("x >= start and x < start + 12")
    weight = grid.ramp_weight(F.col("x") - F.col("start"), 12, 6)
    return windows.groupBy("x").agg(F.countDistinct("start").alias("n_windows"), F.round(F.sum(weight), 6).alias("weight"))


@register("overlap_add_blend", f"""WITH {VOXELS_SQL}, s(start) AS (VALUES (0), (7), (13), (20)), w AS (SELECT z, y, x, start, v, least(least(x - start + 1,
  12 - (x - start)) / 7.0::DOUBLE, 1.0::DOUBLE) AS weight FROM vox, s WHERE x >= start AND x < start + 12),
m AS (SELECT z, y, start, avg(v) AS mean FROM w GROUP BY 1, 2, 3)
SELECT w.z, w.x, round(sum(weight * (v - mean)) / sum(weight), 6) AS blended FROM w JOIN m USING (z, y, start) GROUP BY w.z, w.x""")
def overlap_add_blend(spark: SparkSession, folder: str) -> DataFrame:
    rows = voxels(spark, folder).select(*AXES, "v").withColumn("start", F.explode(F.array(*map(F.lit, grid.even_window_starts(32, 12,
        7))))).where("x >= start and x < start + 12")
    mean = rows.groupBy("z", "y", "start").agg(F.avg("v").alias("mean"))
    weight = grid.ramp_weight(F.col("x") - F.col("start"), 12, 6)
    scored = rows.join(mean, ["z", "y", "start"]).withColumn("w", weight).withColumn("out", F.col("v") - F.col("mean"))
    return scored.groupBy("z", "x").agg(F.round(F.sum(F.col("w") * F.col("out")) / F.sum("w"), 6).alias("blended"))


@register("validity_three_state", f"""WITH {VOXELS_SQL} SELECT z, count(*) FILTER (WHERE valid = 0) AS no_data, count(*)
  FILTER (WHERE valid = 1) AS supervised, count(*) FILTER (WHERE valid = 2) AS ignored,
  count(*) FILTER (WHERE valid = 1 AND u > 128) AS outside FROM coded GROUP BY z""")
def validity_three_state(spark: SparkSession, folder: str) -> DataFrame:
    n = lambda c: F.count(F.when(c, 1))
    v = F.col("valid")
    return coded_voxels(spark, folder).groupBy("z").agg(n(v == 0).alias("no_data"), n(v == 1).alias("supervised"), n(v == 2).alias("ignored"),
        n((v == 1) & (F.col("u") > 128)).alias("outside"))


@register("masked_mean_by_label", f"""WITH {VOXELS_SQL} SELECT label, round(sum(CASE WHEN valid = 1 THEN u ELSE 0 END) / greatest(sum(CASE
  WHEN valid = 1 THEN 1 ELSE 0 END), 1.0::DOUBLE), 6) AS floored, round(avg(u) FILTER (WHERE valid = 1), 6) AS or_null FROM coded GROUP BY label""")
def masked_mean_by_label(spark: SparkSession, folder: str) -> DataFrame:
    one = F.col("valid") == 1
    return coded_voxels(spark, folder).groupBy("label").agg(F.round(aggregates.masked_mean(F.col("u"), one.cast("double")), 6).alias("floored"),
        F.round(aggregates.mean_where(F.col("u"), one), 6).alias("or_null"))


@register("per_sample_masked_mean", f"""WITH {VOXELS_SQL}, s AS (SELECT vec_id, sum(CASE WHEN valid = 1 AND u > 200 THEN v ELSE 0 END) / greatest(sum(CASE
  WHEN valid = 1 AND u > 200 THEN 1 ELSE 0 END), 1.0::DOUBLE) AS m, sum(CASE WHEN valid = 1 AND u > 200 THEN 1 ELSE 0 END) AS n FROM coded GROUP BY vec_id)
SELECT round(coalesce(sum(m) FILTER (WHERE n > 0), 0) / greatest(count(*) FILTER (WHERE n > 0), 1), 6) AS mean FROM s""")
def per_sample_masked_mean(spark: SparkSession, folder: str) -> DataFrame:
    mask = ((F.col("valid") == 1) & (F.col("u") > 200)).cast("double")
    return aggregates.per_sample_mean(coded_voxels(spark, folder), "vec_id", F.col("v"), mask).select(F.round("mean", 6).alias("mean"))


@register("dice_iou_two_masks", f"""WITH {VOXELS_SQL}, m AS (SELECT z, u > 150 AS a, x % 3 = 0 AND u > 100 AS b FROM coded), c AS (SELECT z, count(*)
  FILTER (WHERE a) AS na, count(*) FILTER (WHERE b) AS nb, count(*) FILTER (WHERE a AND b) AS nab, count(*) FILTER (WHERE a OR b) AS nor FROM m GROUP BY z)
SELECT z, round(CASE WHEN na + nb > 0 THEN 2 * nab / (na + nb) END, 6) AS dice, round(CASE WHEN nor > 0 THEN nab / nor ELSE 0 END, 6) AS iou FROM c""")
def dice_iou_two_masks(spark: SparkSession, folder: str) -> DataFrame:
    a, b = F.col("u") > 150, (F.col("x") % 3 == 0) & (F.col("u") > 100)
    return coded_voxels(spark, folder).groupBy("z").agg(F.round(aggregates.dice(a, b), 6).alias("dice"), F.round(aggregates.iou(a, b, 0.0), 6).alias("iou"))


@register("block_pool_mean_cover", f"""WITH {VOXELS_SQL} SELECT z // 4 AS z, y // 4 AS y, x // 4 AS x, round(sum(CASE WHEN valid = 1 THEN u
  ELSE 0 END) / greatest(sum(CASE WHEN valid = 1 THEN 1 ELSE 0 END), 1.0::DOUBLE), 6) AS u,
  round(sum(CASE WHEN valid = 1 THEN 1 ELSE 0 END) / 64.0, 6) AS cover FROM coded GROUP BY 1, 2, 3""")
def block_pool_mean_cover(spark: SparkSession, folder: str) -> DataFrame:
    pooled = aggregates.pool(coded_voxels(spark, folder), 4, "u", F.col("valid") == 1)
    return pooled.select(*AXES, F.round("u", 6).alias("u"), F.round("cover", 6).alias("cover"))


@register("block_sum_stats", f"""WITH {VOXELS_SQL} SELECT z // 8 AS bz, y // 8 AS by, x // 8 AS bx, CAST(sum(u) AS BIGINT) AS total,
  CAST(sum(u * u) AS BIGINT) AS squares, count(*) FILTER (WHERE valid = 1) AS n_valid, CAST(max(u) AS INT) AS top FROM coded GROUP BY 1, 2, 3""")
def block_sum_stats(spark: SparkSession, folder: str) -> DataFrame:
    keys = grid.brick_of(8)
    return coded_voxels(spark, folder).groupBy(*keys).agg(F.sum("u").alias("total"), F.sum(F.col("u").cast("long") * F.col("u")).alias("squares"),
        F.count(F.when(F.col("valid") == 1, 1)).alias("n_valid"), F.max("u").alias("top"))


@register("pyramid_levels", f"""WITH {VOXELS_SQL}, l1 AS (SELECT z // 2 AS z, y // 2 AS y, x // 2 AS x, avg(u) AS u FROM coded GROUP BY 1, 2, 3),
  l2 AS (SELECT z // 2 AS z, y // 2 AS y, x // 2 AS x, avg(u) AS u FROM l1 GROUP BY 1, 2, 3)
SELECT level, count(*) AS n, round(sum(u), 4) AS total, round(max(u), 6) AS top FROM (SELECT 0 AS level, u FROM coded UNION ALL SELECT 1, u FROM l1
  UNION ALL SELECT 2, u FROM l2) GROUP BY level""")
def pyramid_levels(spark: SparkSession, folder: str) -> DataFrame:
    return aggregates.pyramid(coded_voxels(spark, folder), "u", 2).groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("u"), 4).alias("total"),
        F.round(F.max("u"), 6).alias("top"))


@register("downsample_targets", f"""WITH {VOXELS_SQL}, b AS (SELECT z // 2 AS z, y // 2 AS y, x // 2 AS x, avg(v) FILTER (WHERE valid = 1) AS masked,
  avg(v) AS plain FROM coded GROUP BY 1, 2, 3),
d AS (SELECT z // 2 AS z, y // 2 AS y, x // 2 AS x, valid FROM coded WHERE z % 2 = 0 AND y % 2 = 0 AND x % 2 = 0)
SELECT z, count(*) AS n, round(sum(coalesce(masked, plain)), 6) AS total, CAST(sum(valid) AS BIGINT) AS sum_valid FROM b JOIN d USING (z, y, x) GROUP BY z""")
def downsample_targets(spark: SparkSession, folder: str) -> DataFrame:
    rows = coded_voxels(spark, folder)
    half = [F.floor(F.col(a) / 2).cast("int").alias(a) for a in AXES]
    values = rows.groupBy(*half).agg(F.coalesce(aggregates.mean_where(F.col("v"), F.col("valid") == 1), F.avg("v")).alias("v"))
    valid = rows.where("z % 2 = 0 and y % 2 = 0 and x % 2 = 0").select(*half, "valid")
    return values.join(valid, AXES).groupBy("z").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 6).alias("total"), F.sum("valid").alias("sum_valid"))


@register("hist_percentiles_weighted", f"""WITH {VOXELS_SQL} SELECT label, round(quantile_cont(u, 0.05), 6) AS p5, round(quantile_cont(u, 0.5), 6) AS p50,
  round(quantile_cont(u, 0.9), 6) AS p90 FROM coded WHERE u <> 1 GROUP BY label""")
def hist_percentiles_weighted(spark: SparkSession, folder: str) -> DataFrame:
    hist = coded_voxels(spark, folder).where("u <> 1").groupBy("label", "u").agg(F.count(F.lit(1)).alias("n"))
    return hist.groupBy("label").agg(*[F.round(aggregates.weighted_percentile("u", p / 100, "n"), 6).alias(f"p{p}") for p in (5, 50, 90)])


@register("hist_lower_percentile", f"""WITH {VOXELS_SQL} SELECT label, quantile_disc(u, 0.25) AS p25, quantile_disc(u, 0.75) AS p75 FROM coded
  GROUP BY label""")
def hist_lower_percentile(spark: SparkSession, folder: str) -> DataFrame:
    hist = coded_voxels(spark, folder).groupBy("label", "u").agg(F.count(F.lit(1)).alias("n"))
    low, high = (aggregates.lower_order_statistic(hist, "u", "n", p, ["label"]) for p in (0.25, 0.75))
    return low.withColumnRenamed("u", "p25").join(high.withColumnRenamed("u", "p75"), "label")


@register("distribution_by_label", f"""WITH {VOXELS_SQL} SELECT label, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std,
  round(quantile_cont(v, 0.05), 6) AS p5, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.75),
  6) AS p75, round(quantile_cont(v, 0.95), 6) AS p95 FROM vox GROUP BY label""")
def distribution_by_label(spark: SparkSession, folder: str) -> DataFrame:
    return aggregates.distributions(voxels(spark, folder), "v", ["label"])


@register("per_slice_occupancy_bbox", f"""WITH {VOXELS_SQL} SELECT z, round(avg(CASE WHEN u > 140 THEN 1.0 ELSE 0.0 END), 6) AS occupancy, min(y)
  FILTER (WHERE u > 140) AS y0, max(y) FILTER (WHERE u > 140) AS y1, min(x) FILTER (WHERE u > 140) AS x0, max(x) FILTER (WHERE u > 140) AS x1 FROM coded
    GROUP BY z""")
def per_slice_occupancy_bbox(spark: SparkSession, folder: str) -> DataFrame:
    on = F.col("u") > 140
    return coded_voxels(spark, folder).groupBy("z").agg(F.round(F.avg(on.cast("double")), 6).alias("occupancy"), *[f(F.when(on,
        F.col(a))).alias(f"{a}{i}") for a in "yx" for i, f in enumerate((F.min, F.max))])


@register("per_store_grouping_sets", f"""WITH {VOXELS_SQL} SELECT coalesce(CAST(vec_id % 4 AS VARCHAR), 'pooled') AS store, count(*) AS n, round(avg(CASE
  WHEN u > 150 THEN 1.0 ELSE 0.0 END), 6) AS share, CAST(sum(u) AS BIGINT) AS sum_code FROM coded WHERE valid = 1 GROUP BY GROUPING SETS ((), (vec_id % 4))""")
def per_store_grouping_sets(spark: SparkSession, folder: str) -> DataFrame:
    rows = coded_voxels(spark, folder).where("valid = 1").withColumn("store", (F.col("vec_id") % 4).cast("string"))
    return rows.rollup("store").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("u") > 150).cast("double")), 6).alias("share"),
        F.sum("u").alias("sum_code")).withColumn("store", F.coalesce("store", F.lit("pooled")))


@register("circular_mean_by_label", f"""WITH {VOXELS_SQL} SELECT label, round(atan2(sum(sin(v * 20)), sum(cos(v * 20))) / (2 * pi()), 6) AS turns FROM vox
  GROUP BY label""")
def circular_mean_by_label(spark: SparkSession, folder: str) -> DataFrame:
    return voxels(spark, folder).groupBy("label").agg(F.round(circular_mean_turns(F.col("v") * 20, F.lit(1.0)), 6).alias("turns"))


_MERGE_SQL = f"""WITH {VOXELS_SQL}, a AS (SELECT z, y, x, u, CASE WHEN label % 3 = 0 THEN 1 WHEN label % 3 = 1 THEN 0 ELSE 2 END AS valid FROM coded
  WHERE z % 7 <> 3),
b AS (SELECT z, CAST(31 - y AS INT) AS y, x, u, CASE WHEN label % 4 < 2 THEN 1 WHEN label % 4 = 2 THEN 0 ELSE 2 END AS valid FROM coded WHERE x < 30),
j AS (SELECT z, y, x, a.u AS ua, b.u AS ub, coalesce(a.valid, 0) AS va, coalesce(b.valid, 0) AS vb FROM a FULL JOIN b USING (z, y, x))"""


def _two_sources(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = coded_voxels(spark, folder)
    a = rows.where("z % 7 <> 3").select(*AXES, "u", F.when(F.col("label") % 3 == 0, 1).when(F.col("label") % 3 == 1, 0).otherwise(2).alias("valid"))
    b = rows.where("x < 30").select("z", (31 - F.col("y")).alias("y"), "x", "u", F.when(F.col("label") % 4 < 2, 1).when(F.col("label") % 4 == 2,
        0).otherwise(2).alias("valid"))
    return a, b


@register("merge_priority_sources", _MERGE_SQL + """, m AS (SELECT CASE WHEN va = 1 OR vb = 1 THEN 1 WHEN va = 0 AND vb = 0 THEN 0 ELSE 2 END AS valid, CASE
  WHEN va = 1 THEN 1 WHEN vb = 1 THEN 2 ELSE 0 END AS source, CASE WHEN va = 0 AND vb = 0 THEN 0 WHEN va = 1 THEN ua ELSE coalesce(ub, 0) END AS u FROM j)
SELECT valid, source, count(*) AS n, CAST(sum(u) AS BIGINT) AS sum_code FROM m GROUP BY valid, source""")
def merge_priority_sources(spark: SparkSession, folder: str) -> DataFrame:
    merged = joins.priority_merge(*_two_sources(spark, folder), ["u"], AXES)
    return merged.groupBy("valid", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("u").alias("sum_code"))


@register("merge_disagreement_hist", _MERGE_SQL + """, d AS (SELECT least(40, CAST(round_even(abs(ua - ub) / 4.0::DOUBLE, 0) AS INT)) AS bin FROM j
  WHERE va = 1 AND vb = 1)
SELECT bin, count(*) AS n FROM d GROUP BY bin""")
def merge_disagreement_hist(spark: SparkSession, folder: str) -> DataFrame:
    a, b = _two_sources(spark, folder)
    both = a.where("valid = 1").join(b.where("valid = 1").withColumnRenamed("u", "ub"), AXES)
    return both.groupBy(F.least(F.lit(40), F.rint(F.abs(F.col("u") - F.col("ub")) / 4.0).cast("int")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@register("coarse_fine_join", f"""WITH {VOXELS_SQL}, c AS (SELECT (z + 1) // 4 AS z, y // 4 AS y, x // 4 AS x, CAST(max(u) AS INT) AS top FROM coded
  GROUP BY 1, 2, 3)
SELECT f.z, count(*) AS n, count(c.top) AS n_joined, CAST(sum(c.top - f.u) AS BIGINT) AS gap FROM coded f LEFT JOIN c ON c.z = (f.z + 1) // 4
  AND c.y = f.y // 4 AND c.x = f.x // 4 GROUP BY f.z""")
def coarse_fine_join(spark: SparkSession, folder: str) -> DataFrame:
    rows = coded_voxels(spark, folder).select(*AXES, "u")
    coarse = rows.groupBy(F.floor((F.col("z") + 1) / 4).cast("int").alias("z"), F.floor(F.col("y") / 4).cast("int").alias("y"),
        F.floor(F.col("x") / 4).cast("int").alias("x")).agg(F.max("u").alias("top"))
    both = joins.coarse_join(rows, coarse, 4, (1, 0, 0))
    return both.groupBy("z").agg(F.count(F.lit(1)).alias("n"), F.count("top").alias("n_joined"), F.sum(F.col("top") - F.col("u")).alias("gap"))


@register("upsample_nearest", f"""WITH {VOXELS_SQL}, s AS (SELECT unnest(range(3)) AS d), f AS (SELECT CAST(c.z * 3 + a.d AS INT) AS z, u FROM coded c, s a,
  s b, s e)
SELECT z, CAST(sum(u) AS BIGINT) AS total, count(*) AS n FROM f GROUP BY z""")
def upsample_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """Every voxel of a three times finer grid with the value of the voxel that covers it."""
    coarse = coded_voxels(spark, folder).select(*AXES, "u")
    fine = joins.coarse_join(grid.refined(coarse.select(*AXES), 3), coarse, 3, how="inner")
    return fine.groupBy("z").agg(F.sum("u").alias("total"), F.count(F.lit(1)).alias("n"))


@register("affine_resample_nearest", f"""WITH {VOXELS_SQL}, t AS (SELECT z, y, x, CAST(round_even(z * 0.5::DOUBLE + 1.25::DOUBLE, 0) AS INT) AS sz,
  CAST(round_even(-y * 1.0::DOUBLE + 31.0::DOUBLE, 0) AS INT) AS sy, CAST(round_even(x * 0.8::DOUBLE + y * 0.1::DOUBLE, 0) AS INT) AS sx FROM coded)
SELECT t.z, count(c.u) AS n_hit, CAST(sum(coalesce(c.u, 0)) AS BIGINT) AS total FROM t LEFT JOIN coded c ON c.z = sz AND c.y = sy AND c.x = sx GROUP BY t.z""")
def affine_resample_nearest(spark: SparkSession, folder: str) -> DataFrame:
    rows = coded_voxels(spark, folder).select(*AXES, "u")
    found = joins.affine_nearest(rows.select(*AXES), rows, [[0.5, 0.0, 0.0, 1.25], [0.0, -1.0, 0.0, 31.0], [0.0, 0.1, 0.8, 0.0]], "u")
    return found.groupBy("z").agg(F.count(F.when(F.col("u") > 0, 1)).alias("n_hit"), F.sum("u").alias("total"))


@register("trilinear_gather", f"""WITH {VOXELS_SQL}, p AS (SELECT event_id AS id, event_id % 250 / 10.0::DOUBLE AS pz, event_id % 310 / 10.0::DOUBLE AS py,
  event_id % 290 / 9.5::DOUBLE AS px FROM events), o(n) AS (VALUES (0), (1)),
w AS (SELECT id, CAST(floor(pz) AS INT) + a.n AS z, CAST(floor(py) AS INT) + b.n AS y, CAST(floor(px) AS INT) + c.n AS x,
  (CASE a.n WHEN 1 THEN pz - floor(pz) ELSE 1 - (pz - floor(pz)) END) * (CASE b.n WHEN 1 THEN py - floor(py) ELSE 1 - (py - floor(py)) END) * (CASE c.n
  WHEN 1 THEN px - floor(px) ELSE 1 - (px - floor(px)) END) AS w FROM p, o a, o b, o c)
SELECT id, round(sum(w * coalesce(u, 0)), 6) AS u FROM w LEFT JOIN coded USING (z, y, x) WHERE w > 0 GROUP BY id""")
def trilinear_gather(spark: SparkSession, folder: str) -> DataFrame:
    points = table(spark, folder, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 250 / 10.0).alias("pz"),
        (F.col("event_id") % 310 / 10.0).alias("py"), (F.col("event_id") % 290 / 9.5).alias("px"))
    return joins.trilinear(points, coded_voxels(spark, folder), "u").select("id", F.round("u", 6).alias("u"))


@register("axis_asof_lerp", """WITH p AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'purchase' AND ts IS NOT NULL),
  c AS (SELECT user_id, ts, avg(value) AS value FROM events WHERE event_type = 'click' AND value IS NOT NULL GROUP BY user_id, ts),
n AS (SELECT p.user_id, p.event_id, epoch(p.ts) AS t, (SELECT max(ts) FROM c WHERE c.user_id = p.user_id AND c.ts <= p.ts) AS lo, (SELECT min(ts) FROM c
  WHERE c.user_id = p.user_id AND c.ts >= p.ts) AS hi FROM p)
SELECT n.user_id, n.event_id, round(CASE WHEN lo IS NULL THEN h.value WHEN hi IS NULL OR hi = lo THEN l.value
  ELSE l.value + (t - epoch(lo)) / (epoch(hi) - epoch(lo)) * (h.value - l.value) END, 6) AS value
FROM n LEFT JOIN c l ON l.user_id = n.user_id AND l.ts = lo LEFT JOIN c h ON h.user_id = n.user_id AND h.ts = hi""")
def axis_asof_lerp(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").where("ts is not null").withColumn("t",
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) / 1e6"))
    clicks = events.where("event_type = 'click' and value is not null").groupBy("user_id", "t").agg(F.avg("value").alias("value"))
    probes = events.where("event_type = 'purchase'").select("user_id", "event_id", "t")
    return joins.as_of_interpolated(probes, clicks, "t", ["value"], "user_id").select("user_id", "event_id", F.round("value", 6).alias("value"))


@register("axis_core_mask", f"""WITH {VOXELS_SQL}, a AS (SELECT z, y, x, 10 + z * 0.25::DOUBLE AS ay, 20 - z * 0.125::DOUBLE AS ax FROM coded)
SELECT z, count(*) AS n FROM a WHERE sqrt((y - ay)**2 + (x - ax)**2) <= 6 GROUP BY z""")
def axis_core_mask(spark: SparkSession, folder: str) -> DataFrame:
    rows = voxels(spark, folder).select(*AXES)
    last = rows.agg(F.max("z").alias("z")).first()["z"] or 0
    axis = spark.range(last // 64 + 2).select((F.col("id") * 64).cast("double").alias("z"), (10 + F.col("id") * 16.0).alias("ay"),
        (20 - F.col("id") * 8.0).alias("ax"))
    layers = joins.as_of_interpolated(rows.select("z").distinct(), axis.withColumn("z", F.col("z").cast("int")), "z", ["ay", "ax"])
    near = F.hypot(F.col("y") - F.col("ay"), F.col("x") - F.col("ax")) <= 6
    return rows.join(broadcast_if_small(layers), "z").where(near).groupBy("z").agg(F.count(F.lit(1)).alias("n"))


@register("nn_distance_two_way_censored", f"""WITH {VOXELS_SQL}, a AS (SELECT z, y, x FROM coded WHERE u > 225), b AS (SELECT z, y, x FROM coded WHERE u < 30),
ab AS (SELECT a.z, a.y, a.x, min((a.z-b.z)**2 + (a.y-b.y)**2 + (a.x-b.x)**2) AS d2 FROM a LEFT JOIN b ON b.z BETWEEN a.z-3 AND a.z+3 AND b.y BETWEEN a.y-3
  AND a.y+3 AND b.x BETWEEN a.x-3 AND a.x+3 AND (a.z-b.z)**2 + (a.y-b.y)**2 + (a.x-b.x)**2 <= 9 GROUP BY 1, 2, 3),
ba AS (SELECT b.z, b.y, b.x, min((a.z-b.z)**2 + (a.y-b.y)**2 + (a.x-b.x)**2) AS d2 FROM b LEFT JOIN a ON b.z BETWEEN a.z-3 AND a.z+3 AND b.y BETWEEN a.y-3
  AND a.y+3 AND b.x BETWEEN a.x-3 AND a.x+3 AND (a.z-b.z)**2 + (a.y-b.y)**2 + (a.x-b.x)**2 <= 9 GROUP BY 1, 2, 3)
SELECT way, CAST(coalesce(d2, 16) AS BIGINT) AS d2, count(*) AS n FROM (SELECT 'ab' AS way, d2 FROM ab UNION ALL SELECT 'ba', d2 FROM ba) GROUP BY 1, 2""")
def nn_distance_two_way_censored(spark: SparkSession, folder: str) -> DataFrame:
    rows = coded_voxels(spark, folder)
    a, b = rows.where("u > 225").select(*AXES), rows.where("u < 30").select(*AXES)
    both = joins.nearest(a, b, 3, [], []).select(F.lit("ab").alias("way"), "d2").unionByName(joins.nearest(b, a, 3, [], []).select(F.lit("ba").alias("way"),
        "d2"))
    return both.groupBy("way", F.coalesce(F.col("d2").cast("long"), F.lit(16)).alias("d2")).agg(F.count(F.lit(1)).alias("n"))


@register("tolerant_dice_r1", f"""WITH {VOXELS_SQL}, a AS (SELECT z, y, x FROM coded WHERE u > 215), b AS (SELECT z, y, x FROM coded WHERE u < 41),
ha AS (SELECT DISTINCT a.z, a.y, a.x FROM a JOIN b ON abs(a.z-b.z) <= 1 AND abs(a.y-b.y) <= 1 AND abs(a.x-b.x) <= 1), hb AS (SELECT DISTINCT b.z, b.y, b.x
  FROM b JOIN a ON abs(a.z-b.z) <= 1 AND abs(a.y-b.y) <= 1 AND abs(a.x-b.x) <= 1)
SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, round(((SELECT count(*) FROM ha) + (SELECT count(*) FROM hb)) / ((SELECT count(*)
  FROM a) + (SELECT count(*) FROM b)), 6) AS dice""")
def tolerant_dice_r1(spark: SparkSession, folder: str) -> DataFrame:
    rows = coded_voxels(spark, folder)
    a, b = rows.where("u > 215").select(*AXES), rows.where("u < 41").select(*AXES)
    reach = [(0, 0, 0), *grid.cube(1)]
    parts = [("n_a", a), ("n_b", b), ("hits", stencil.touching(a, b, reach)), ("hits", stencil.touching(b, a, reach))]
    tagged = None
    for name, part in parts:
        one = part.select(F.lit(name).alias("part"))
        tagged = one if tagged is None else tagged.unionByName(one)
    n = lambda name: F.count(F.when(F.col("part") == name, 1))
    return tagged.agg(n("n_a").alias("n_a"), n("n_b").alias("n_b"), F.round(n("hits") / (n("n_a") + n("n_b")), 6).alias("dice"))


@register("march_contact", f"""WITH {VOXELS_SQL}, s AS (SELECT z, y, x, u FROM coded WHERE u BETWEEN 126 AND 130), body AS (SELECT z, y, x FROM coded
  WHERE u > 200), k(k) AS (VALUES (1), (2), (3), (4)),
hit AS (SELECT DISTINCT s.z, s.y, s.x FROM s, k, body b WHERE b.z = CAST(round_even(s.z + k * 0.6::DOUBLE, 0) AS INT)
  AND b.y = CAST(round_even(s.y + k * 0.8::DOUBLE, 0) AS INT) AND b.x = s.x)
SELECT z, count(*) AS n FROM hit GROUP BY z""")
def march_contact(spark: SparkSession, folder: str) -> DataFrame:
    rows = coded_voxels(spark, folder)
    hit = joins.march(rows.where("u between 126 and 130").select(*AXES), rows.where("u > 200"), (F.lit(0.6), F.lit(0.8), F.lit(0.0)), 4, AXES)
    return hit.groupBy("z").agg(F.count(F.lit(1)).alias("n"))


def _labelled(mask: DataFrame) -> DataFrame:
    """``mask`` with ``component``: its 26-connected component's smallest voxel number."""
    number = F.col("z").cast("long") * (1 << 40) + F.col("y").cast("long") * (1 << 20) + F.col("x")
    keyed = mask.select(*AXES, number.alias("id"))
    half = [o for o in grid.cube(1) if o > (0, 0, 0)]
    edges = grid.around(keyed, half, ("id",)).withColumnRenamed("id", "a").join(keyed.withColumnRenamed("id", "b"), AXES).select("a", "b")
    roots = connected_components(edges).withColumnRenamed("node", "id")
    return keyed.join(roots, "id", "left").select(*AXES, F.coalesce("root", "id").alias("component"))


_CC_SQL = f"""WITH RECURSIVE {VOXELS_SQL}, m AS (SELECT z, y, x, CAST(z AS BIGINT) * 1099511627776 + CAST(y AS BIGINT) * 1048576 + x AS id FROM coded
  WHERE u > 205),
e AS (SELECT a.id AS a, b.id AS b FROM m a JOIN m b ON abs(a.z - b.z) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
reach AS (SELECT id AS node, id AS other FROM m UNION SELECT r.node, e.b FROM reach r JOIN e ON e.a = r.other),
comp AS (SELECT node AS id, min(other) AS component FROM reach GROUP BY node), sizes AS (SELECT component, count(*) AS size FROM comp GROUP BY component)"""


@register("connected_components_26", _CC_SQL + " SELECT size, count(*) AS n FROM sizes GROUP BY size")
def connected_components_26(spark: SparkSession, folder: str) -> DataFrame:
    sizes = _labelled(coded_voxels(spark, folder).where("u > 205")).groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n"))


@register("drop_small_components", _CC_SQL + " SELECT m.z, count(*) AS n FROM m JOIN comp USING (id) JOIN sizes USING (component) WHERE size >= 3 GROUP BY m.z")
def drop_small_components(spark: SparkSession, folder: str) -> DataFrame:
    labelled = _labelled(coded_voxels(spark, folder).where("u > 205"))
    large = labelled.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where("size >= 3")
    return labelled.join(large, "component", "left_semi").groupBy("z").agg(F.count(F.lit(1)).alias("n"))


@register("topology_merge_break", _CC_SQL + """, o AS (SELECT z, y, x, (z // 4) * 64 + (y // 4) * 8 + x // 4 AS object FROM coded WHERE u BETWEEN 200 AND 255),
t AS (SELECT DISTINCT comp.component, o.object FROM m JOIN comp USING (id) JOIN o ON o.z = m.z AND o.y = m.y AND o.x = m.x)
SELECT (SELECT count(*) FROM (SELECT component FROM t GROUP BY component HAVING count(*) >= 2)) AS merging, (SELECT count(*) FROM (SELECT object FROM t
  GROUP BY object HAVING count(*) >= 2)) AS broken,
  (SELECT count(DISTINCT object) FROM o WHERE object NOT IN (SELECT object FROM t)) AS missed""")
def topology_merge_break(spark: SparkSession, folder: str) -> DataFrame:
    rows = coded_voxels(spark, folder)
    labelled = _labelled(rows.where("u > 205"))
    objects = rows.where("u between 200 and 255").select(*AXES,
        (F.floor(F.col("z") / 4) * 64 + F.floor(F.col("y") / 4) * 8 + F.floor(F.col("x") / 4)).alias("object"))
    touches = labelled.join(objects, AXES).select("component", "object").distinct()
    merging = touches.groupBy("component").count().where("count >= 2").agg(F.count(F.lit(1)).alias("merging"))
    broken = touches.groupBy("object").count().where("count >= 2").agg(F.count(F.lit(1)).alias("broken"))
    missed = objects.join(touches, "object", "left_anti").agg(F.countDistinct("object").alias("missed"))
    return merging.crossJoin(broken).crossJoin(missed)  # one row each


@register("cross_links_pairs", f"""WITH {VOXELS_SQL}, a AS (SELECT z, y, x, vec_id AS ca FROM coded WHERE u > 215), b AS (SELECT z, y, x, vec_id AS cb
  FROM coded WHERE u < 41),
l AS (SELECT DISTINCT ca, cb FROM a JOIN b ON abs(a.z-b.z) <= 1 AND abs(a.y-b.y) <= 1 AND abs(a.x-b.x) <= 1)
SELECT ca, count(*) AS n_links FROM l GROUP BY ca HAVING count(*) >= 2""")
def cross_links_pairs(spark: SparkSession, folder: str) -> DataFrame:
    rows = coded_voxels(spark, folder)
    a = rows.where("u > 215").select(*AXES, F.col("vec_id").alias("ca"))
    b = rows.where("u < 41").select(*AXES, F.col("vec_id").alias("cb"))
    links = grid.around(a, [(0, 0, 0), *grid.cube(1)], ("ca",)).join(b, AXES).select("ca", "cb").distinct()
    return links.groupBy("ca").agg(F.count(F.lit(1)).alias("n_links")).where("n_links >= 2")


@register("label_dilated_max", f"""WITH {VOXELS_SQL}, p AS (SELECT z, y, x FROM coded WHERE u > 230), l AS (SELECT z, y, x, label FROM coded WHERE valid = 1)
SELECT p.z, p.y, p.x, max(label) AS label FROM p LEFT JOIN l ON abs(p.z-l.z) <= 1 AND abs(p.y-l.y) <= 1 AND abs(p.x-l.x) <= 1 GROUP BY 1, 2, 3""")
def label_dilated_max(spark: SparkSession, folder: str) -> DataFrame:
    rows = coded_voxels(spark, folder)
    spread = stencil.spread_extreme(rows.where("valid = 1"), "label", 1, True)
    return rows.where("u > 230").select(*AXES).join(spread, AXES, "left")


@register("holdout_box_anti", """WITH o AS (SELECT p_partkey, CAST(p_partkey % 10 * 3 AS INT) AS z, CAST(p_partkey // 10 % 10 * 3 AS INT) AS y,
  CAST(p_partkey // 100 % 10 * 3 AS INT) AS x FROM part), h AS (SELECT z, y, x FROM o WHERE p_partkey % 97 = 0)
SELECT count(*) AS n_train, CAST(sum(p_partkey) AS BIGINT) AS key_sum FROM o WHERE NOT EXISTS (SELECT 1 FROM h WHERE abs(o.z - h.z) < 5 AND abs(o.y - h.y) < 5
  AND abs(o.x - h.x) < 5)""")
def holdout_box_anti(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("p_partkey")
    o = table(spark, folder, "part").select("p_partkey", *[(F.floor(key / 10**k) % 10 * 3).cast("int").alias(a) for k, a in enumerate(AXES)])
    train = joins.box_overlap(o, o.where("p_partkey % 97 = 0").select(*AXES), 5, 5, anti=True)
    return train.agg(F.count(F.lit(1)).alias("n_train"), F.sum("p_partkey").alias("key_sum"))


@register("exclusion_islands", """WITH i AS (SELECT l_suppkey, l_quantity AS lo, l_quantity + l_tax * 10 AS hi FROM lineitem WHERE l_linenumber = 1
  AND l_discount > 0.05),
s AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY l_suppkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0
  ELSE 1 END AS fresh FROM i),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY l_suppkey ORDER BY lo, hi) AS island FROM s)
SELECT l_suppkey, count(DISTINCT island) AS islands, round(sum(w), 4) AS covered FROM (SELECT l_suppkey, island, max(hi) - min(lo) AS w FROM g GROUP BY 1, 2)
  JOIN (SELECT DISTINCT l_suppkey FROM g) USING (l_suppkey) GROUP BY l_suppkey""")
def exclusion_islands(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").where("l_linenumber = 1 and l_discount > 0.05").select("l_suppkey", F.col("l_quantity").alias("lo"),
        (F.col("l_quantity") + F.col("l_tax") * 10).alias("hi"))
    return joins.merge_intervals(rows, "lo", "hi", ["l_suppkey"]).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("islands"),
        F.round(F.sum(F.col("hi") - F.col("lo")), 4).alias("covered"))


@register("box_containment_plan", f"""WITH {VOXELS_SQL}, b AS (SELECT label, min(z) AS z0, max(z) AS z1, min(y) AS y0, max(y) AS y1, min(x) AS x0,
  max(x) AS x1 FROM coded GROUP BY label)
SELECT label, z0 <= 3 AND z1 >= 20 AND y0 <= 2 AND y1 >= 30 AND x0 <= 2 AND x1 >= 30 AS covers FROM b""")
def box_containment_plan(spark: SparkSession, folder: str) -> DataFrame:
    b = coded_voxels(spark, folder).groupBy("label").agg(*[f(a).alias(f"{a}{i}") for a in AXES for i, f in enumerate((F.min, F.max))])
    return b.select("label", F.expr("z0 <= 3 and z1 >= 20 and y0 <= 2 and y1 >= 30 and x0 <= 2 and x1 >= 30").alias("covers"))


@register("window_sum_2d", """WITH c AS (SELECT CAST(l_suppkey % 10 AS INT) AS cy, CAST(l_partkey % 12 AS INT) AS cx, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT a.cy, a.cx, CAST(sum(b.n) AS BIGINT) AS total FROM c a JOIN c b ON b.cy BETWEEN a.cy AND a.cy + 2 AND b.cx BETWEEN a.cx AND a.cx + 2 WHERE a.cy <= 7
  AND a.cx <= 9 GROUP BY 1, 2""")
def window_sum_2d(spark: SparkSession, folder: str) -> DataFrame:
    cells = table(spark, folder, "lineitem").groupBy((F.col("l_suppkey") % 10).cast("int").alias("cy"),
        (F.col("l_partkey") % 12).cast("int").alias("cx")).agg(F.count(F.lit(1)).alias("n"))
    back = lambda c: F.explode(F.sequence(F.col(c) - 2, F.col(c))).alias(c)
    spread = cells.select(back("cy"), "cx", "n").groupBy("cy", "cx").agg(F.sum("n").alias("n"))
    spread = spread.select("cy", back("cx"), "n").groupBy("cy", "cx").agg(F.sum("n").alias("total"))
    return spread.where("cy between 0 and 7 and cx between 0 and 9")


@register("slab_scores", """WITH o AS (SELECT CAST(floor(epoch(l_shipdate) / 86400) AS BIGINT) AS day, count(*) AS n FROM lineitem GROUP BY 1),
  s AS (SELECT day, avg(n) OVER (ORDER BY day RANGE BETWEEN CURRENT ROW AND 13 FOLLOWING) AS score FROM o)
SELECT day, round(score, 6) AS score FROM s WHERE day % 7 = 0""")
def slab_scores(spark: SparkSession, folder: str) -> DataFrame:
    days = table(spark, folder,
        "lineitem").groupBy(F.expr("cast(datediff(l_shipdate, DATE '1970-01-01') as bigint)").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy(F.lit(0)).orderBy("day").rangeBetween(0, 13)  # a row per day
    return days.withColumn("score", F.avg("n").over(ahead)).where("day % 7 = 0").select("day", F.round("score", 6).alias("score"))


@register("valid_origins_min_frac", f"""WITH {VOXELS_SQL}, c AS (SELECT z // 4 AS cz, y // 4 AS cy, x // 4 AS cx, count(*) FILTER (WHERE valid = 1) AS n
  FROM coded GROUP BY 1, 2, 3)
SELECT a.cz * 4 AS z, a.cy * 4 AS y, a.cx * 4 AS x, CAST(sum(b.n) AS BIGINT) AS n_valid FROM c a JOIN c b ON b.cz BETWEEN a.cz AND a.cz + 1
  AND b.cy BETWEEN a.cy AND a.cy + 1 AND b.cx BETWEEN a.cx AND a.cx + 1
WHERE a.cy <= 6 AND a.cx <= 6 AND a.cz <= (SELECT max(cz) FROM c) - 1 GROUP BY 1, 2, 3 HAVING sum(b.n) >= 0.7 * 512""")
def valid_origins_min_frac(spark: SparkSession, folder: str) -> DataFrame:
    cubes = coded_voxels(spark, folder).groupBy(*[F.floor(F.col(a) / 4).cast("int").alias(a) for a in AXES]).agg(F.count(F.when(F.col("valid") == 1,
        1)).alias("n"))
    back = [(-a, -b, -c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    summed = grid.around(cubes, back, ("n",)).groupBy(*AXES).agg(F.sum("n").alias("n_valid"))
    top = cubes.agg(F.max("z").alias("top"))
    found = cubes.select(*AXES).join(summed,
        AXES).crossJoin(F.broadcast(top)).where("z <= top - 1 and y <= 6 and x <= 6 and n_valid >= 0.7 * 512")  # top: one row
    return found.select(*[(F.col(a) * 4).alias(a) for a in AXES], "n_valid")
