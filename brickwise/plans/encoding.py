"""Queries on fixed-point codes and vectors of voxel channels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickwise.functions import codec, vectors
from brickwise.operators import aggregates
from brickwise.plans.catalog import register
from brickwise.runtime import materialize
from brickwise.sources.tables import table
from brickwise.sources.voxels import CLIP, VOXELS_SQL, coded_voxels, voxels


@register("sdf_encode_roundtrip", f"""WITH {VOXELS_SQL}
SELECT label, count(*) AS n, CAST(sum(u) AS BIGINT) AS sum_code, CAST(min(u) AS INT) AS low_code, CAST(max(u) AS INT) AS high_code,
  round(max(abs((u - 128) * (0.25::DOUBLE / 127.0::DOUBLE) - greatest(-0.25::DOUBLE, least(0.25::DOUBLE, v)))), 9) AS worst_error
FROM coded GROUP BY label""")
def sdf_encode_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    rows = coded_voxels(spark, folder)
    error = F.abs(codec.decode_sdf(F.col("u"), CLIP) - codec.clip(F.col("v"), -CLIP, CLIP))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("u").alias("sum_code"), F.min("u").alias("low_code"), F.max("u").alias("high_code"),
        F.round(F.max(error), 9).alias("worst_error"))


@register("signed_encode_hist", f"""WITH {VOXELS_SQL}
SELECT CAST(least(255.0, greatest(0.0, round_even(127.5 + 127.5 * v, 0))) AS INT) AS code, count(*) AS n FROM vox GROUP BY 1""")
def signed_encode_hist(spark: SparkSession, folder: str) -> DataFrame:
    return voxels(spark, folder).groupBy(codec.encode_signed(F.col("v")).alias("code")).agg(F.count(F.lit(1)).alias("n"))


@register("density_encode", f"""WITH {VOXELS_SQL}
SELECT CAST(least(255.0, greatest(0.0, round_even(abs(v) * 1000, 0))) AS INT) AS code, count(*) AS n FROM vox GROUP BY 1""")
def density_encode(spark: SparkSession, folder: str) -> DataFrame:
    return voxels(spark, folder).groupBy(codec.encode_density(F.abs("v")).alias("code")).agg(F.count(F.lit(1)).alias("n"))


@register("prob_encode_by_label", f"""WITH {VOXELS_SQL}, p AS (SELECT label, CAST(least(255.0, greatest(0.0, round_even(1 / (1 + exp(-8 * v)) * 255,
  0))) AS INT) AS code FROM vox)
SELECT label, count(*) AS n, CAST(sum(code) AS BIGINT) AS sum_code, count(*) FILTER (WHERE code > 127) AS n_high FROM p GROUP BY label""")
def prob_encode_by_label(spark: SparkSession, folder: str) -> DataFrame:
    code = codec.encode_prob(codec.activate(8 * F.col("v"), "sigmoid"))
    return voxels(spark, folder).withColumn("code", code).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("code").alias("sum_code"),
        F.count(F.when(F.col("code") > 127, 1)).alias("n_high"))


@register("source_type_to_byte", """
SELECT l_linestatus, CAST(sum(CAST(l_extendedprice AS INT) % 65536 >> 8) AS BIGINT) AS from_u16,
  CAST(sum(CAST(trunc(least(255.0, greatest(0.0, l_discount * 10 * 255))) AS INT)) AS BIGINT) AS from_float,
  CAST(sum(greatest(0, least(255, CAST(l_suppkey AS INT) - 20))) AS BIGINT) AS from_int
FROM lineitem GROUP BY l_linestatus""")
def source_type_to_byte(spark: SparkSession, folder: str) -> DataFrame:
    wide = F.round("l_extendedprice").cast("int") % 65536
    return (
        table(spark, folder, "lineitem").groupBy("l_linestatus")
        .agg(F.sum(codec.to_byte(wide, "u16")).alias("from_u16"), F.sum(codec.to_byte(F.col("l_discount") * 10, "float")).alias("from_float"),
            F.sum(codec.to_byte(F.col("l_suppkey") - 20, "int")).alias("from_int"))
    )


@register("band_distance_codes", f"""WITH {VOXELS_SQL}
SELECT CASE WHEN valid = 0 THEN 0 WHEN abs(v * 100) <= 6 THEN CAST(127 + least(48.0, greatest(1.0, round_even(6 - abs(v * 100) + 1, 0))) AS INT)
  ELSE CAST(128 - least(48.0, greatest(1.0, round_even(abs(v * 100) - 6, 0))) AS INT) END AS code, count(*) AS n
FROM coded GROUP BY 1""")
def band_distance_codes(spark: SparkSession, folder: str) -> DataFrame:
    code = codec.encode_band_distance(F.col("v") * 100, F.col("valid") != 0, 6.0)
    return coded_voxels(spark, folder).groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("n"))


_TRIPLES_SQL = """tri AS (SELECT vec_id, label, i, CAST(embedding[3 * i + 1] AS DOUBLE) AS a, CAST(embedding[3 * i + 2] AS DOUBLE) AS b,
  CAST(embedding[3 * i + 3] AS DOUBLE) AS c
  FROM (SELECT vec_id, label, embedding, unnest(range(21)) AS i FROM embeddings))"""


def triples(spark: SparkSession, folder: str) -> DataFrame:
    """(vec_id, label, i, a, b, c): 21 vectors in z, y, x order of each row of ``embeddings``."""
    rows = table(spark, folder, "embeddings").select("vec_id", "label", "embedding", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("i"))
    return rows.select("vec_id", "label", "i", *[F.get("embedding", 3 * F.col("i") + k).cast("double").alias(n) for k, n in enumerate("abc")])



def _abc() -> vectors.Vec:
    return F.col("a"), F.col("b"), F.col("c")


@register("hemisphere_bytes", f"""WITH {_TRIPLES_SQL}, n AS (SELECT label, a / sqrt(a*a + b*b + c*c) AS nz, b / sqrt(a*a + b*b + c*c) AS ny,
  c / sqrt(a*a + b*b + c*c) AS nx FROM tri)
SELECT label, CAST(sum(CAST(round_even(128 + 127 * nx * CASE WHEN nz < 0 THEN -1.0 ELSE 1.0 END, 0) AS INT)) AS BIGINT) AS sum_x,
  CAST(sum(CAST(round_even(128 + 127 * ny * CASE WHEN nz < 0 THEN -1.0 ELSE 1.0 END, 0) AS INT)) AS BIGINT) AS sum_y FROM n GROUP BY label""")
def hemisphere_bytes(spark: SparkSession, folder: str) -> DataFrame:
    z, y, x = vectors.unit(_abc())
    bx, by = codec.hemisphere_bytes(x, y, z)
    return triples(spark, folder).groupBy("label").agg(F.sum(bx).alias("sum_x"), F.sum(by).alias("sum_y"))


@register("line_angle_roundtrip", f"""WITH {_TRIPLES_SQL}, d AS (
  SELECT label, b, c, 0.5 + 0.5 * ((c*c - b*b) / (c*c + b*b + 1e-12::DOUBLE)) AS d0,
  0.5 + 0.5 * ((c*c - b*b) / (c*c + b*b + 1e-12::DOUBLE) - 2.0 * c * b / (c*c + b*b + 1e-12::DOUBLE)) / sqrt(2.0::DOUBLE) AS d1 FROM tri
), t AS (SELECT *, atan2((2.0 * d0 - 1.0) - sqrt(2.0::DOUBLE) * (2.0 * d1 - 1.0), 2.0 * d0 - 1.0) * 0.5 AS angle FROM d)
SELECT label, count(*) AS n, round(avg(d0), 6) AS mean_d0, round(avg(d1), 6) AS mean_d1, count(*)
  FILTER (WHERE abs(sin(angle) * c - cos(angle) * b) > 1e-5) AS n_off FROM t GROUP BY label""")
def line_angle_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    d0, d1 = codec.line_codes(F.col("c"), F.col("b"))
    rows = triples(spark, folder).withColumns({"d0": d0, "d1": d1}).withColumn("angle", codec.line_angle(F.col("d0"), F.col("d1")))
    off = F.abs(F.sin("angle") * F.col("c") - F.cos("angle") * F.col("b")) > 1e-5
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("d0"), 6).alias("mean_d0"), F.round(F.avg("d1"), 6).alias("mean_d1"),
        F.count(F.when(off, 1)).alias("n_off"))


@register("faces_body_and_distance", f"""WITH {VOXELS_SQL}, f AS (
  SELECT label, v * 40 + 3 AS si, v * 40 - 3 AS so FROM vox)
SELECT label, count(*) FILTER (WHERE si > 0 AND so < 0) AS n_body, round(avg(least(si, -so)), 6) AS mean_body, round(avg(least(abs(si), abs(so))),
  6) AS mean_face, round(avg(0.5 * (si + so)), 6) AS mean_medial
FROM f GROUP BY label""")
def faces_body_and_distance(spark: SparkSession, folder: str) -> DataFrame:
    si, so = F.col("v") * 40 + 3, F.col("v") * 40 - 3
    return voxels(spark, folder).groupBy("label").agg(
        F.count(F.when(codec.in_body(si, so), 1)).alias("n_body"), F.round(F.avg(codec.body_sdf(si, so)), 6).alias("mean_body"),
        F.round(F.avg(codec.face_distance(si, so)), 6).alias("mean_face"), F.round(F.avg(codec.medial_sdf(si, so)), 6).alias("mean_medial"),
    )


@register("face_saturation", f"""WITH {VOXELS_SQL}, f AS (
  SELECT label, CAST(least(255.0, greatest(1.0, round_even(128 + greatest(-0.1::DOUBLE, least(0.1::DOUBLE, v)) * (127.0::DOUBLE / 0.1::DOUBLE),
  0))) AS INT) AS ui,
    CAST(least(255.0, greatest(1.0, round_even(128 + greatest(-0.1::DOUBLE, least(0.1::DOUBLE, v - 0.15)) * (127.0::DOUBLE / 0.1::DOUBLE), 0))) AS INT) AS uo
    FROM vox)
SELECT label, count(*) FILTER (WHERE ui IN (1, 255) AND uo IN (1, 255)) AS n_saturated, count(*) FILTER (WHERE ui <> 0 AND abs(ui - 128) <= 4) AS n_zero_set
  FROM f GROUP BY label""")
def face_saturation(spark: SparkSession, folder: str) -> DataFrame:
    rows = voxels(spark, folder).select("label", codec.encode_sdf(F.col("v"), 0.1).alias("ui"), codec.encode_sdf(F.col("v") - 0.15, 0.1).alias("uo"))
    return rows.groupBy("label").agg(F.count(F.when(codec.face_saturated(F.col("ui"), F.col("uo")), 1)).alias("n_saturated"),
        F.count(F.when(codec.zero_set(F.col("ui"), 4), 1)).alias("n_zero_set"))


@register("softmax_sigmoid", f"""WITH {_TRIPLES_SQL}
SELECT label, round(avg(1 / (1 + exp(a - b))), 6) AS p_second, round(avg(1 / (1 + exp(-c))), 6) AS p_third, round(avg(greatest(0.0, c)), 6) AS relu,
  round(avg(least(1.0, greatest(0.0, a))), 6) AS clamped FROM tri GROUP BY label""")
def softmax_sigmoid(spark: SparkSession, folder: str) -> DataFrame:
    a, b, c = _abc()
    shown = {"p_second": codec.softmax2(a, b), "p_third": codec.activate(c, "sigmoid"), "relu": codec.activate(c, "relu"), "clamped": codec.activate(a,
        "clamp01")}
    return triples(spark, folder).groupBy("label").agg(*[F.round(F.avg(e), 6).alias(n) for n, e in shown.items()])


@register("radial_field_angles", f"""WITH {VOXELS_SQL}, r AS (
  SELECT z, y, x, (y - 15.5) / sqrt((y - 15.5)**2 + (x - 15.5)**2) AS ry, (x - 15.5) / sqrt((y - 15.5)**2 + (x - 15.5)**2) AS rx, (x - 15.5) * 2 + 0.5 AS x0
  FROM vox)
SELECT z, round(sum(ry * ry), 6) AS sum_ry2, round(sum(abs(rx)), 6) AS sum_rx, CAST(count(*) FILTER (WHERE degrees(acos(least(1.0, greatest(-1.0,
  rx)))) < 45) AS BIGINT) AS n_ahead FROM r GROUP BY z""")
def radial_field_angles(spark: SparkSession, folder: str) -> DataFrame:
    ry, rx = vectors.radial(F.col("y"), F.col("x"), F.lit(15.5), F.lit(15.5))
    rows = voxels(spark, folder).select("z", ry.alias("ry"), rx.alias("rx"))
    ahead = vectors.angle_deg((F.lit(0.0), F.col("ry"), F.col("rx")), (F.lit(0.0), F.lit(0.0), F.lit(1.0))) < 45
    return rows.groupBy("z").agg(F.round(F.sum(F.col("ry") * F.col("ry")), 6).alias("sum_ry2"), F.round(F.sum(F.abs("rx")), 6).alias("sum_rx"),
        F.count(F.when(ahead, 1)).alias("n_ahead"))


@register("geometry_basis_cross", f"""WITH {_TRIPLES_SQL}, n AS (SELECT label, a / sqrt(a*a+b*b+c*c) AS nz, b / sqrt(a*a+b*b+c*c) AS ny,
  c / sqrt(a*a+b*b+c*c) AS nx FROM tri),
p AS (SELECT *, sqrt((1 - nz*nz)**2 + (nz*ny)**2 + (nz*nx)**2) AS lv, sqrt(nx*nx + ny*ny) AS lh FROM n)
SELECT label, count(*) FILTER (WHERE lv > 1e-3 AND lh > 1e-3) AS n_ok, round(sum((1 - nz*nz) / lv), 6) AS sum_vz, round(sum(abs(nx / lh)), 6) AS sum_hy FROM p
  GROUP BY label""")
def geometry_basis_cross(spark: SparkSession, folder: str) -> DataFrame:
    n = vectors.unit(_abc())
    v, h, ok = vectors.fibre_basis(n, (F.lit(1.0), F.lit(0.0), F.lit(0.0)))
    rows = triples(spark, folder).select("label", ok.alias("ok"), v[0].alias("vz"), F.abs(h[1]).alias("hy"))
    return rows.groupBy("label").agg(F.count(F.when(F.col("ok"), 1)).alias("n_ok"), F.round(F.sum("vz"), 6).alias("sum_vz"), F.round(F.sum("hy"),
        6).alias("sum_hy"))


@register("axial_angle_stats", f"""WITH {_TRIPLES_SQL}, u AS (SELECT vec_id, label, i, a / sqrt(a*a+b*b+c*c) AS nz, b / sqrt(a*a+b*b+c*c) AS ny,
  c / sqrt(a*a+b*b+c*c) AS nx FROM tri),
g AS (SELECT p.label, degrees(acos(least(1.0, greatest(-1.0, abs(p.nz*q.nz + p.ny*q.ny + p.nx*q.nx))))) AS angle FROM u p JOIN u q ON p.vec_id = q.vec_id
  AND q.i = p.i + 1)
SELECT label, count(*) AS n, round(avg(angle), 6) AS mean_angle, round(quantile_cont(angle, 0.5), 6) AS median_angle, round(quantile_cont(angle, 0.9),
  6) AS p90_angle,
  round(avg(CASE WHEN angle > 10 THEN 1.0 ELSE 0.0 END), 6) AS over10, round(avg(CASE WHEN angle > 30 THEN 1.0 ELSE 0.0 END), 6) AS over30 FROM g
  GROUP BY label""")
def axial_angle_stats(spark: SparkSession, folder: str) -> DataFrame:
    n = vectors.unit(_abc())
    u = triples(spark, folder).select("vec_id", "label", "i", *[c.alias(k) for c, k in zip(n, ("nz", "ny", "nx"), strict=True)])
    q = u.select("vec_id", (F.col("i") - 1).alias("i"), *[F.col(k).alias(f"q{k}") for k in ("nz", "ny", "nx")])
    angle = vectors.angle_deg((F.col("nz"), F.col("ny"), F.col("nx")), (F.col("qnz"), F.col("qny"), F.col("qnx")), axial=True)
    g = materialize(u.join(q, ["vec_id", "i"]).select("label", angle.alias("angle")), "angles")
    share = lambda t: F.round(F.avg(F.when(F.col("angle") > t, 1.0).otherwise(0.0)), 6)
    ends = aggregates.percentiles(g, "angle", ["label"], {"median_angle": 0.5, "p90_angle": 0.9})
    ends = ends.select("label", F.round("median_angle", 6).alias("median_angle"), F.round("p90_angle", 6).alias("p90_angle"))
    sums = g.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("angle"), 6).alias("mean_angle"), share(10).alias("over10"),
        share(30).alias("over30"))
    return sums.join(ends, "label")


@register("local_covariance_max_eigenvalue", f"""WITH {_TRIPLES_SQL}, m AS (SELECT vec_id, avg(a * a) AS aa, avg(b * b) AS bb, avg(c * c) AS cc,
  avg(a * b) AS ab, avg(a * c) AS ac, avg(b * c) AS bc FROM tri
  GROUP BY vec_id), q AS (SELECT *, (aa + bb + cc) / 3 AS q, ab * ab + ac * ac + bc * bc AS o FROM m), p AS (SELECT *, sqrt((pow(aa - q, 2) + pow(bb - q,
  2) + pow(cc - q, 2) + 2 * o) / 6) AS p FROM q),
d AS (SELECT *, (aa - q) / p AS d1, (bb - q) / p AS d2, (cc - q) / p AS d3, ab / p AS e, ac / p AS f, bc / p AS g FROM p)
SELECT vec_id, round(CASE WHEN p < 1e-12 THEN q ELSE q + 2 * p * cos(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE,
  (d1 * (d2 * d3 - g * g) - e * (e * d3 - g * f) + f * (e * g - d2 * f)) / 2))) / 3) END, 6)
  AS max_eigenvalue FROM d""")
def local_covariance_max_eigenvalue(spark: SparkSession, folder: str) -> DataFrame:
    """Largest eigenvalue of the second moments of each row's vectors."""
    m = triples(spark, folder).groupBy("vec_id").agg(*[F.avg(F.col(p) * F.col(q)).alias(p + q) for p, q in ("aa", "bb", "cc", "ab", "ac", "bc")])
    value = vectors.max_eigenvalue_sym3(*map(F.col, ("aa", "bb", "cc", "ab", "ac", "bc")))
    return m.select("vec_id", F.round(value, 6).alias("max_eigenvalue"))
