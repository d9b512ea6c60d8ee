"""Queries on line fields, normals, fibre targets, tangents and propagated signs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickwise.functions import codec, vectors
from brickwise.operators import fields, grid, stencil
from brickwise.plans.catalog import register
from brickwise.plans.encoding import _TRIPLES_SQL, triples
from brickwise.runtime import materialize
from brickwise.sources.voxels import VOXELS_SQL, coded_voxels, voxels

AXES = list(grid.AXES)


def _named(rows: DataFrame, prefix: str) -> vectors.Vec:
    return tuple(F.col(f"{prefix}_{a}") for a in AXES)


def _codes_sql(a: str, b: str) -> tuple[str, str]:
    """The two codes of the doubled angle of (a, b), as SQL."""
    r = f"({a} * {a} + {b} * {b} + 1e-12::DOUBLE)"
    c, s = f"(({a} * {a} - {b} * {b}) / {r})", f"(2.0::DOUBLE * {a} * {b} / {r})"
    return f"(0.5::DOUBLE + 0.5::DOUBLE * {c})", f"(0.5::DOUBLE + 0.5::DOUBLE * ({c} - {s}) / sqrt(2.0::DOUBLE))"


def _channels_sql(z: str, y: str, x: str) -> list[str]:
    return [c for a, b in ((x, y), (x, z), (y, z)) for c in _codes_sql(a, b)]


def _misfit_sql(z: str, y: str, x: str) -> str:
    own = _channels_sql(z, y, x)
    weights = [f"({a} * {a} + {b} * {b})" for a, b in ((x, y), (x, z), (y, z))]
    return "(" + " + ".join(f"{w} * (({own[2 * k]} - k{2 * k})**2 + ({own[2 * k + 1]} - k{2 * k + 1})**2)" for k, w in enumerate(weights)) + ")"


def _turned_sql(columns: str, of: int) -> str:
    """Vectors 1 and 2 of three turned to the side of vector 0, as a select list."""
    side = lambda i: f"CASE WHEN x0 * x{i} + y0 * y{i} + z0 * z{i} >= 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END"
    turned = ", ".join(f"{a}{i} * {side(i)} AS {a}{i}" for i in (1, 2) for a in "xyz")
    return f"SELECT * REPLACE ({turned}) FROM {columns}"


_UNIT_SQL = "u AS (SELECT vec_id, label, a / sqrt(a*a + b*b + c*c) AS nz, b / sqrt(a*a + b*b + c*c) AS ny, c / sqrt(a*a + b*b + c*c) AS nx FROM tri)"
_BYTES_SQL = ", ".join(f"round_even(255 * {c}, 0) / 255.0::DOUBLE AS k{i}" for i, c in enumerate(_channels_sql("nz", "ny", "nx")))
_ANGLES_SQL = ", ".join(f"atan2((2.0::DOUBLE * k{2 * k} - 1) - sqrt(2.0::DOUBLE) * (2.0::DOUBLE * k{2 * k + 1} - 1), 2.0::DOUBLE * k{2 * k} - 1) * 0.5::DOUBLE AS t{k}" for k in range(3))
#: The decoded line of bytes, from candidates of two planes each, in the steps of the definition.
_DECODE_STEPS_SQL = f"""coded6 AS (SELECT *, {_BYTES_SQL} FROM u), turned AS (SELECT *, {_ANGLES_SQL} FROM coded6),
cand AS (SELECT *, cos(t0) * cos(t1) AS x0, sin(t0) * cos(t1) AS y0, cos(t0) * sin(t1) AS z0, cos(t0) * cos(t2) AS x1, sin(t0) * cos(t2) AS y1,
  sin(t0) * sin(t2) AS z1,
  cos(t1) * sin(t2) AS x2, sin(t1) * cos(t2) AS y2, sin(t1) * sin(t2) AS z2 FROM turned),
cand2 AS ({_turned_sql("cand", 3)}),
weighed AS (SELECT *, 1 / ({_misfit_sql("z0", "y0", "x0")} + 1e-12::DOUBLE) AS w0, 1 / ({_misfit_sql("z1", "y1", "x1")} + 1e-12::DOUBLE) AS w1,
  1 / ({_misfit_sql("z2", "y2", "x2")} + 1e-12::DOUBLE) AS w2 FROM cand2),
mean AS (SELECT *, w0*x0 + w1*x1 + w2*x2 AS ex, w0*y0 + w1*y1 + w2*y2 AS ey, w0*z0 + w1*z1 + w2*z2 AS ez FROM weighed),
mean2 AS (SELECT * REPLACE (ex / (sqrt(ex*ex + ey*ey + ez*ez) + 1e-12::DOUBLE) AS ex, ey / (sqrt(ex*ex + ey*ey + ez*ez) + 1e-12::DOUBLE) AS ey,
  ez / (sqrt(ex*ex + ey*ey + ez*ez) + 1e-12::DOUBLE) AS ez) FROM mean),
long AS (SELECT *, sqrt(ex*ex + ey*ey + 1e-12::DOUBLE) AS l0, sqrt(ex*ex + ez*ez + 1e-12::DOUBLE) AS l1, sqrt(ey*ey + ez*ez + 1e-12::DOUBLE) AS l2 FROM mean2),
scaled AS (SELECT * REPLACE ({", ".join(f"{a}{i} * (l{p} * l{q}) AS {a}{i}" for i, (p, q) in enumerate(((0, 1), (0, 2), (1, 2))) for a in "xyz")}) FROM long),
scaled2 AS ({_turned_sql("scaled", 3)}),
summed AS (SELECT *, x0 + x1 + x2 AS sx, y0 + y1 + y2 AS sy, z0 + z1 + z2 AS sz,
  sqrt(x0*x0 + y0*y0 + z0*z0) + sqrt(x1*x1 + y1*y1 + z1*z1) + sqrt(x2*x2 + y2*y2 + z2*z2) + 1e-12::DOUBLE AS whole FROM scaled2),
decoded AS (SELECT *, sx / (sqrt(sx*sx + sy*sy + sz*sz) + 1e-12::DOUBLE) AS dx, sy / (sqrt(sx*sx + sy*sy + sz*sz) + 1e-12::DOUBLE) AS dy,
  sz / (sqrt(sx*sx + sy*sy + sz*sz) + 1e-12::DOUBLE) AS dz, sqrt(sx*sx + sy*sy + sz*sz) / whole AS agreement FROM summed)"""

_DECODED_SQL = f"{_TRIPLES_SQL}, {_UNIT_SQL}, {_DECODE_STEPS_SQL}"


def _unit_rows(spark: SparkSession, folder: str) -> DataFrame:
    n = vectors.unit((F.col("a"), F.col("b"), F.col("c")))
    return triples(spark, folder).select("vec_id", "label", *[c.alias(f"u_{a}") for c, a in zip(n, AXES, strict=True)])


def _decoded(spark: SparkSession, folder: str) -> DataFrame:
    rows = _unit_rows(spark, folder)
    rows = rows.select("*", *fields.encode_line_field(_named(rows, "u")))
    return fields.decode_line_field(rows.withColumns({c: F.rint(255 * F.col(c)) / 255.0 for c in fields.LINE_CHANNELS}))


@register("line_field_decode", f"""WITH {_DECODED_SQL}
SELECT label, count(*) AS n, round(avg(agreement), 4) AS agreement,
  round(avg(sqrt({_misfit_sql("dz", "dy", "dx")} / (4 * (dx*dx + dy*dy + dz*dz) + 1e-12::DOUBLE))), 4) AS misfit,
  round(avg(degrees(acos(least(1.0, abs(dz * nz + dy * ny + dx * nx))))), 3) AS mean_angle FROM decoded GROUP BY label""")
def line_field_decode(spark: SparkSession, folder: str) -> DataFrame:
    """Normals coded as bytes of six channels and decoded again: agreement of the planes, misfit, and angle to the normal."""
    rows = _decoded(spark, folder)
    angle = vectors.angle_deg(_named(rows, "n"), _named(rows, "u"), axial=True)
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("agreement"), 4).alias("agreement"), F.round(F.avg("misfit"),
        4).alias("misfit"), F.round(F.avg(angle), 3).alias("mean_angle"))


_ROTATED = ((1, 2, 0), (1, -1, 1))
_ROTATED_SQL = _channels_sql("dy", "-dx", "dz")


@register("line_field_turned", f"""WITH {_DECODED_SQL}
SELECT label, {", ".join(f"round(avg({c}), 4) AS {n}" for c, n in zip(_ROTATED_SQL, fields.LINE_CHANNELS, strict=True))} FROM decoded GROUP BY label""")
def line_field_turned(spark: SparkSession, folder: str) -> DataFrame:
    """Channels of the decoded lines under a signed permutation of the axes."""
    rows = _decoded(spark, folder)
    turned = fields.encode_line_field(fields.permuted(_named(rows, "n"), *_ROTATED))
    return rows.select("label", *turned).groupBy("label").agg(*[F.round(F.avg(c), 4).alias(c) for c in fields.LINE_CHANNELS])


_GRAD_SQL = ", ".join(
    f"coalesce((CASE WHEN lead({a}) OVER w{a} = {a} + 1 THEN lead(v) OVER w{a} END - CASE WHEN lag({a}) OVER w{a} = {a} - 1 THEN lag(v) OVER w{a} END) / 2, "
    f"CASE WHEN lead({a}) OVER w{a} = {a} + 1 THEN lead(v) OVER w{a} END - v, v - CASE WHEN lag({a}) OVER w{a} = {a} - 1 THEN lag(v) OVER w{a} END, 0) AS g{a}"
    for a in AXES
)
_LINES_SQL = "WINDOW wz AS (PARTITION BY y, x ORDER BY z), wy AS (PARTITION BY z, x ORDER BY y), wx AS (PARTITION BY z, y ORDER BY x)"
#: Gradients of ten times the value, and normals of those between a half and one and a half, else away from the middle.
_NORMALS_SQL = f"""{VOXELS_SQL}, g AS (SELECT z, y, x, label, valid, u, {_GRAD_SQL} FROM (SELECT * REPLACE (v * 10 AS v) FROM coded) {_LINES_SQL}),
m AS (SELECT *, sqrt(gz*gz + gy*gy + gx*gx) AS steep, (y - 15.5::DOUBLE) / sqrt((y - 15.5::DOUBLE)**2 + (x - 15.5::DOUBLE)**2) AS ry,
  (x - 15.5::DOUBLE) / sqrt((y - 15.5::DOUBLE)**2 + (x - 15.5::DOUBLE)**2) AS rx FROM g),
n AS (SELECT *, steep >= 0.5 AND steep <= 1.5 AS own, CASE WHEN steep >= 0.5 AND steep <= 1.5 THEN gz / steep ELSE 0.0::DOUBLE END AS nz,
  CASE WHEN steep >= 0.5 AND steep <= 1.5 THEN gy / steep ELSE ry END AS ny, CASE WHEN steep >= 0.5 AND steep <= 1.5 THEN gx / steep ELSE rx END AS nx
  FROM m)"""


def _normals(spark: SparkSession, folder: str) -> DataFrame:
    rows = coded_voxels(spark, folder).select(*AXES, "label", "valid", "u", (F.col("v") * 10).alias("v"))
    ry, rx = vectors.radial(F.col("y"), F.col("x"), F.lit(15.5), F.lit(15.5))
    out = fields.gradient(rows, "v").withColumns({"r_z": F.lit(0.0), "r_y": ry, "r_x": rx})
    return fields.sheet_normal(out, 0.5, 1.5, (F.col("r_z"), F.col("r_y"), F.col("r_x")))


@register("sheet_normals", f"""WITH {_NORMALS_SQL}, o AS (SELECT *, CASE WHEN ny * ry + nx * rx < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS side FROM n)
SELECT z, count(*) FILTER (WHERE own) AS n_own, count(*) FILTER (WHERE side < 0) AS n_turned, round(sum(nz * side), 4) AS sum_z,
  round(sum(ny * side * ry + nx * side * rx), 4) AS outward FROM o GROUP BY z""")
def sheet_normals(spark: SparkSession, folder: str) -> DataFrame:
    """Normals of the gradient where it is steep as a distance is, else away from the middle, all turned outward."""
    rows = _normals(spark, folder)
    n, r = _named(rows, "n"), _named(rows, "r")
    out = fields.outward(n, r)
    steep = vectors.norm(_named(rows, "g"))
    return rows.groupBy("z").agg(
        F.count(F.when((steep >= 0.5) & (steep <= 1.5), 1)).alias("n_own"), F.count(F.when(vectors.dot(n, r) < 0, 1)).alias("n_turned"),
        F.round(F.sum(out[0]), 4).alias("sum_z"), F.round(F.sum(vectors.dot(out, r)), 4).alias("outward"),
    )


_FIBRE_SQL = f"""{_NORMALS_SQL}, b AS (SELECT *, (x + y) % 4 AS band, abs(sin(u)) AS pv, abs(cos(u)) AS ph,
  sqrt((1 - nz*nz)**2 + (nz*ny)**2 + (nz*nx)**2) AS lv, sqrt(nx*nx + ny*ny) AS lh FROM n),
t AS (SELECT *, lv > 1e-3 AND lh > 1e-3 AS ok, (1 - nz*nz) / lv AS vz, -nz*ny / lv AS vy, -nz*nx / lv AS vx, nx / lh AS hy, -ny / lh AS hx FROM b),
d AS (SELECT *, sqrt((pv*vz)**2 + (pv*vy + ph*hy)**2 + (pv*vx + ph*hx)**2) AS ld, band <> 3 AND ok AND (valid = 1 OR band IN (1, 2)) AS fits FROM t),
o AS (SELECT *, CASE WHEN NOT fits THEN 0 WHEN band = 2 THEN vz WHEN band = 1 THEN 0 ELSE pv*vz / ld END AS dz, CASE WHEN NOT fits THEN 0
  WHEN band = 2 THEN vy WHEN band = 1 THEN hy ELSE (pv*vy + ph*hy) / ld END AS dy,
  CASE WHEN NOT fits THEN 0 WHEN band IN (1, 2) THEN 1 ELSE greatest(pv, ph) END AS strength FROM d)"""


def _fibres(spark: SparkSession, folder: str) -> DataFrame:
    rows = _normals(spark, folder)
    return fields.fibre_targets(rows, F.abs(F.sin("u")), F.abs(F.cos("u")), _named(rows, "n"), F.col("valid"), (F.col("x") + F.col("y")) % 4, (F.lit(1.0),
        F.lit(0.0), F.lit(0.0)))


@register("fibre_targets", f"""WITH {_FIBRE_SQL}
SELECT band, count(*) FILTER (WHERE fits) AS n_valid, round(sum(dz), 4) AS sum_z, round(sum(abs(dy)), 4) AS sum_y, round(sum(strength), 4) AS strength, CASE
  WHEN band IN (1, 2) THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM o GROUP BY band""")
def fibre_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Direction, strength and validity of fibres from class probabilities, with drawn bands that replace them."""
    rows = _fibres(spark, folder).withColumn("band", (F.col("x") + F.col("y")) % 4)
    return rows.groupBy("band").agg(
        F.sum(F.col("target_valid").cast("long")).alias("n_valid"), F.round(F.sum("d_z"), 4).alias("sum_z"), F.round(F.sum(F.abs("d_y")), 4).alias("sum_y"),
        F.round(F.sum("strength"), 4).alias("strength"), F.max("weight").alias("weight"),
    )


@register("fibre_classes", f"""WITH {_FIBRE_SQL}
SELECT CASE band WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE band END AS band, round(sum(strength * abs(dz*vz + dy*vy + CASE WHEN NOT fits THEN 0 WHEN band = 2 THEN vx
  WHEN band = 1 THEN hx ELSE (pv*vx + ph*hx) / ld END * vx)), 3) AS along,
  round(sum(strength * abs(dy*hy + CASE WHEN NOT fits THEN 0 WHEN band = 2 THEN vx WHEN band = 1 THEN hx ELSE (pv*vx + ph*hx) / ld END * hx)), 3) AS across
  FROM o WHERE ok GROUP BY 1""")
def fibre_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Class probabilities back from directions, by band; under a quarter turn that moves the axis the bands' two classes change places."""
    rows = _fibres(spark, folder)
    rows = materialize(rows.select(*AXES, *[f"n_{a}" for a in AXES], *[f"d_{a}" for a in AXES], "strength"), "fibres")
    rows, along, across = fields.fibre_basis(rows, _named(rows, "n"), (F.lit(1.0), F.lit(0.0), F.lit(0.0)))
    rows = fields.classes_of_direction(rows, "strength", along, across)
    band = (F.col("x") + F.col("y")) % 4
    turned = fields.axis_is_swapped([[0.0, 0.0, 1.0], [0.0, 1.0, 0.0], [-1.0, 0.0, 0.0]])
    found = rows.where("_ok").select((fields.swapped_band(band) if turned else band).alias("band"), "p_along", "p_across")
    return found.groupBy("band").agg(F.round(F.sum("p_along"), 3).alias("along"), F.round(F.sum("p_across"), 3).alias("across"))


@register("axis_tangents", f"""WITH {VOXELS_SQL}, l AS (SELECT DISTINCT z FROM vox), top AS (SELECT max(z) // 16 + 1 AS k FROM l), p AS (SELECT i * 16 AS z,
  10 + 3 * sin(i) AS ay, 20 - 2 * cos(i) AS ax FROM top, range(0, 1000000) r(i) WHERE i <= k),
s AS (SELECT l.z, q.side, least(greatest(l.z + q.side * 8, 0), (SELECT max(z) FROM p)) AS place FROM l, (VALUES (-1), (1)) q(side)),
e AS (SELECT s.z, side, a.ay + (place - a.z) / 16.0 * (coalesce(b.ay, a.ay) - a.ay) AS ay, a.ax + (place - a.z) / 16.0 * (coalesce(b.ax, a.ax) - a.ax) AS ax
  FROM s JOIN p a ON a.z = s.place // 16 * 16 LEFT JOIN p b ON b.z = a.z + 16),
t AS (SELECT z, sum(side * ay) AS dy, sum(side * ax) AS dx FROM e GROUP BY z)
SELECT t.z, round(16 / sqrt(256 + dy*dy + dx*dx), 5) AS t_z, round(dy / sqrt(256 + dy*dy + dx*dx), 5) AS t_y, round(dx / sqrt(256 + dy*dy + dx*dx), 5) AS t_x,
  count(*) AS n FROM t JOIN vox USING (z) GROUP BY ALL""")
def axis_tangents(spark: SparkSession, folder: str) -> DataFrame:
    """Unit tangents of an axis of control points at every layer, held by the voxels of the layer."""
    rows = voxels(spark, folder).groupBy("z").agg(F.count(F.lit(1)).alias("n"))
    last = rows.agg(F.max("z").alias("z")).first()["z"] or 0
    i = F.col("id")
    points = spark.range(last // 16 + 2).select((i * 16).cast("int").alias("z"), (10 + 3 * F.sin(i)).alias("ay"), (20 - 2 * F.cos(i)).alias("ax"))
    found = fields.tangents(rows, points, "z", ("ay", "ax"), 8.0)
    return found.select(F.col("z").cast("int").alias("z"), "n", *[F.round(c, 5).alias(c) for c in ("t_z", "t_y", "t_x")])


@register("propagated_phase_sign", f"""WITH RECURSIVE {VOXELS_SQL}, g AS (SELECT z, y, x, u, {_GRAD_SQL} FROM coded {_LINES_SQL}), s0 AS (SELECT z, y, x, u,
  CASE WHEN abs(gx + gy) < 0.05 THEN 0 ELSE CAST(sign(gx + gy) AS INT) END AS s FROM g),
{", ".join(f"s{k + 1} AS (SELECT a.z, a.y, a.x, a.u, CASE WHEN a.s <> 0 THEN a.s ELSE CAST(sign(sum(b.s)) AS INT) END AS s FROM s{k} a JOIN s{k} b ON b.z BETWEEN a.z - 1 AND a.z + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY a.z, a.y, a.x, a.u, a.s)" for k in range(2))}
SELECT z, count(*) FILTER (WHERE s > 0 OR s = 0) AS n_up, round(sum(CASE WHEN s < 0 THEN 1 ELSE -1 END * sqrt(greatest(0.0::DOUBLE,
  1 - cos(u / 40.0::DOUBLE)**2))), 4) AS total FROM s2 GROUP BY z""")
def propagated_phase_sign(spark: SparkSession, folder: str) -> DataFrame:
    """Sines from cosines: the sign of the slope, taken from around where it is flat, two rounds."""
    rows = fields.gradient(coded_voxels(spark, folder).select(*AXES, "u", "v"), "v").withColumn("slope", F.col("g_x") + F.col("g_y"))
    found = fields.propagated_sign(rows.select(*AXES, "u", "slope"), "slope", 0.05, 2)
    c = F.cos(F.col("u") / 40.0)
    sine = -F.col("sign") * F.sqrt(F.greatest(F.lit(0.0), 1 - c * c))
    return found.groupBy("z").agg(F.count(F.when(F.col("sign") > 0, 1)).alias("n_up"), F.round(F.sum(sine), 4).alias("total"))


@register("pooled_phase", f"""WITH {VOXELS_SQL}, p AS (SELECT z // 2 AS z, y // 2 AS y, x // 2 AS x, sum(CASE WHEN valid > 0 THEN sin(u / 40.0::DOUBLE)
  ELSE 0 END) / greatest(sum(CASE WHEN valid > 0 THEN 1 ELSE 0 END), 1) AS s,
  sum(CASE WHEN valid > 0 THEN cos(u / 40.0::DOUBLE) ELSE 0 END) / greatest(sum(CASE WHEN valid > 0 THEN 1 ELSE 0 END), 1) AS c, sum(CASE
  WHEN valid > 0 THEN abs(v) ELSE 0 END) / greatest(sum(CASE WHEN valid > 0 THEN 1 ELSE 0 END), 1) AS d FROM coded GROUP BY 1, 2, 3)
SELECT z, round(sum(CASE WHEN sqrt(s*s + c*c) > 1e-6 THEN s / sqrt(s*s + c*c) ELSE 0 END), 4) AS sines, round(sum(CASE
  WHEN sqrt(s*s + c*c) > 1e-6 THEN c / sqrt(s*s + c*c) ELSE 0 END), 4) AS cosines, round(sum(2 * d), 4) AS density FROM p GROUP BY z""")
def pooled_phase(spark: SparkSession, folder: str) -> DataFrame:
    """Phases pooled by two as unit vectors, and densities per pooled voxel."""
    rows = coded_voxels(spark, folder)
    known = (F.col("valid") > 0).cast("double")
    mean = lambda x: F.sum(x * known) / F.greatest(F.sum(known), F.lit(1.0))
    keys = [F.floor(F.col(a) / 2).cast("int").alias(a) for a in AXES]
    pooled = rows.groupBy(*keys).agg(mean(F.sin(F.col("u") / 40.0)).alias("s"), mean(F.cos(F.col("u") / 40.0)).alias("c"), mean(F.abs("v")).alias("d"))
    length = F.hypot("s", "c")
    one = lambda c: F.round(F.sum(F.when(length > 1e-6, F.col(c) / length).otherwise(0.0)), 4)
    return pooled.groupBy("z").agg(one("s").alias("sines"), one("c").alias("cosines"), F.round(F.sum(2 * F.col("d")), 4).alias("density"))


_STEPS_SQL = "steps(dz, dy, dx) AS (VALUES (1,0,0), (-1,0,0), (0,1,0), (0,-1,0), (0,0,1), (0,0,-1))"


@register("medial_crossings", f"""WITH {VOXELS_SQL}, {_STEPS_SQL}, f AS (SELECT z, y, x, label, u + 30 - 128 AS si, u - 40 - 128 AS so FROM coded),
  i AS (SELECT *, si + so AS g FROM f WHERE si > 0 AND so < 0)
SELECT label, count(*) AS n FROM (SELECT DISTINCT a.z, a.y, a.x, a.label FROM i a, steps s, i b WHERE a.g <= 0 AND b.g > 0 AND b.z = a.z + s.dz
  AND b.y = a.y + s.dy AND b.x = a.x + s.dx) GROUP BY label""")
def medial_crossings(spark: SparkSession, folder: str) -> DataFrame:
    """Middle surface of a sheet between two faces: where the sum of the two distances changes its sign, within the sheet."""
    si, so = F.col("u") + 30 - 128, F.col("u") - 40 - 128
    inside = coded_voxels(spark, folder).where(codec.in_body(si, so)).select(*AXES, "label", (si + so).alias("g"))
    return stencil.zero_crossing(inside, F.col("g") <= 0, F.col("g") > 0).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


#: Outward normals decoded from bytes, cosines of a phase with their slope along the normal, and contrasts in cubes of five.
_COARSE_SQL = f"""{_NORMALS_SQL}, u AS (SELECT z, y, x, u, valid, ry, rx, nz, ny, nx FROM n), {_DECODE_STEPS_SQL},
o AS (SELECT * REPLACE (dz * side AS dz, dy * side AS dy, dx * side AS dx) FROM (SELECT *, CASE WHEN dy * ry + dx * rx < 0 THEN -1.0::DOUBLE
  ELSE 1.0::DOUBLE END AS side FROM decoded)),
f AS (SELECT z, y, x, valid, dz, dy, dx, agreement, abs(dy * ry + dx * rx) AS outward, cos(u / 40.0::DOUBLE) AS v FROM o),
fg AS (SELECT *, {_GRAD_SQL} FROM f {_LINES_SQL}), s0 AS (SELECT z, y, x, v, valid, dz, dy, dx, agreement, outward, gz * dz + gy * dy + gx * dx AS d FROM fg),
p0 AS (SELECT z, y, x, CASE WHEN abs(d) < 0.05 THEN 0 ELSE CAST(sign(d) AS INT) END AS s FROM s0),
p1 AS (SELECT a.z, a.y, a.x, CASE WHEN a.s <> 0 THEN a.s ELSE CAST(sign(sum(b.s)) AS INT) END AS s FROM p0 a JOIN p0 b
  ON b.z BETWEEN a.z - 1 AND a.z + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY a.z, a.y, a.x, a.s),
c AS (SELECT a.z, a.y, a.x, max(b.v) - min(b.v) AS contrast FROM s0 a JOIN s0 b
  ON b.z BETWEEN a.z - 2 AND a.z + 2 AND b.y BETWEEN a.y - 2 AND a.y + 2 AND b.x BETWEEN a.x - 2 AND a.x + 2 GROUP BY 1, 2, 3)"""


def _signed_byte_sql(value: str) -> str:
    return f"CAST(least(255.0::DOUBLE, greatest(0.0::DOUBLE, round_even(127.5::DOUBLE + 127.5::DOUBLE * ({value}), 0))) AS INT)"


@register("coarse_field", f"""WITH {_COARSE_SQL}
SELECT CASE WHEN valid = 0 THEN 0 WHEN agreement < 0.5 OR outward < 0.3 THEN 2 ELSE 1 END AS state, count(*) AS n,
  CAST(sum({_signed_byte_sql("CASE WHEN s < 0 THEN 1 ELSE -1 END * sqrt(greatest(0.0::DOUBLE, 1 - v * v))")}) AS BIGINT) AS sine,
  CAST(sum({_signed_byte_sql("v")}) AS BIGINT) AS cosine,
  CAST(sum({_signed_byte_sql("dz")}) AS BIGINT) AS nz, CAST(sum({_signed_byte_sql("dy")}) AS BIGINT) AS ny,
  CAST(sum(CASE WHEN valid = 0 THEN 0 ELSE CAST(round_even(contrast * 127.5::DOUBLE, 0) AS INT) END) AS BIGINT) AS confidence
FROM s0 JOIN p1 USING (z, y, x) JOIN c USING (z, y, x) GROUP BY 1""")
def coarse_field(spark: SparkSession, folder: str) -> DataFrame:
    """The channels of a coarse field from line channels and cosines: outward normals, sines with propagated signs, confidence by contrast and validity."""
    rows = _normals(spark, folder)
    bytes_ = {c: F.rint(255 * F.col(c)) / 255.0 for c in fields.LINE_CHANNELS}
    rows = materialize(rows.select(*AXES, "u", "valid", "r_z", "r_y", "r_x", *fields.encode_line_field(_named(rows, "n"))).withColumns(bytes_), "line-channels")
    rows = materialize(fields.decode_line_field(rows, "d").select(*AXES, "u", "valid", "r_z", "r_y", "r_x", "d_z", "d_y", "d_x", "agreement"), "normals")
    r = _named(rows, "r")
    rows = rows.withColumns({f"o_{a}": c for a, c in zip(AXES, fields.outward(_named(rows, "d"), r), strict=True)})
    rows = fields.gradient(rows.withColumn("v", F.cos(F.col("u") / 40.0)), "v")
    n = _named(rows, "o")
    rows = rows.withColumns({"slope": vectors.dot(_named(rows, "g"), n), "outward": F.abs(vectors.dot(n, r))})
    rows = materialize(rows.select(*AXES, "v", "valid", "agreement", "outward", "slope", "o_z", "o_y"), "slopes")
    signs = fields.propagated_sign(rows, "slope", 0.05, 1)
    high = stencil.neighbour_extreme(signs, "v", 2, True, "high")
    both = stencil.neighbour_extreme(high, "v", 2, False, "low")
    state = F.when(F.col("valid") == 0, 0).when((F.col("agreement") < 0.5) | (F.col("outward") < 0.3), 2).otherwise(1)
    sine = -F.col("sign") * F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("v") * F.col("v")))
    confidence = F.when(F.col("valid") == 0, 0).otherwise(F.rint((F.col("high") - F.col("low")) * 127.5).cast("int"))
    byte = lambda c, name: F.sum(codec.encode_signed(c)).alias(name)
    return both.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"), byte(sine, "sine"), byte(F.col("v"), "cosine"), byte(F.col("o_z"), "nz"),
        byte(F.col("o_y"), "ny"), F.sum(confidence).alias("confidence"))


#: A turn by forty degrees about a slanting axis after a flip of y and a stretch.
_TURN = vectors.composed(vectors.rotation((1.0, 2.0, -1.0), 40.0), [[1.1, 0.0, 0.0], [0.0, -1.1, 0.0], [0.0, 0.0, 1.1]])


@register("turned_vectors", f"""WITH {_TRIPLES_SQL} SELECT label,
  {", ".join(f"round(avg({r[0]!r}::DOUBLE * a + {r[1]!r}::DOUBLE * b + {r[2]!r}::DOUBLE * c), 6) AS t{n}" for n, r in zip("zyx", _TURN, strict=True))},
  round(avg(1.21::DOUBLE * (a*a + b*b + c*c)), 5) AS square FROM tri GROUP BY label""")
def turned_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors under a rotation, a flip and a stretch composed into one matrix, and their squared lengths."""
    t = vectors.affine([[*r, 0.0] for r in _TURN], (F.col("a"), F.col("b"), F.col("c")))
    return triples(spark, folder).groupBy("label").agg(*[F.round(F.avg(c), 6).alias(f"t{n}") for n, c in zip("zyx", t, strict=True)],
        F.round(F.avg(vectors.dot(t, t)), 5).alias("square"))
