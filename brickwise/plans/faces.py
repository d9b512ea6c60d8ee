"""Queries on the faces of sheets: marches along each voxel's own normal, closings along it, and labels of both faces from intensity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickwise.functions import vectors
from brickwise.operators import faces, fields, grid, stencil
from brickwise.plans.catalog import register
from brickwise.plans.stencils import _smoothed_sql
from brickwise.runtime import materialize
from brickwise.sources.voxels import VOXELS_SQL, coded_voxels

AXES = list(grid.AXES)
#: The middle of a layer, from which normals point away.
CENTRE = 15.5
#: Rules at the size of the test tables' bricks.
RULES = faces.FaceRules(body_above=146.0, body_sigma=1.0, close_reach=2, least_component=3, thickness=(2.0, 3.5), side_reach=2, contact_reach=1, clip=4.0,
    doubtful=(150, 170), sure_near=1.0)
STEEP = 4.0


def radial() -> vectors.Vec:
    ry, rx = vectors.radial(F.col("y"), F.col("x"), F.lit(CENTRE), F.lit(CENTRE))
    return F.lit(0.0), ry, rx


def face_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Voxels with ``ct``, ``recto``, ``data``, and the gradient ``g_*`` of the smoothed intensity."""
    rows = coded_voxels(spark, folder).select(*AXES, F.col("u").cast("double").alias("ct"), F.col("u").alias("recto"), (F.col("valid") > 0).alias("data"))
    return materialize(fields.gradient(stencil.gaussian(rows, "ct", 1.0, "smooth"), "smooth"), "gradients")


def gradient_sql() -> str:
    """``f``: voxels with the smoothed intensity s and the outward unit normal n_*, n_ok where the gradient is steep."""
    sides = " ".join(f"LEFT JOIN sx {n}{a} ON {' AND '.join(f'{n}{a}.{b} = a.{b}' + (step if a == b else '') for b in AXES)}" for a in AXES for n, step in
        (("p", " + 1"), ("m", " - 1")))
    part = lambda a: f"coalesce((p{a}.s - m{a}.s) / 2, p{a}.s - a.s, a.s - m{a}.s, 0.0::DOUBLE) AS g_{a}"
    away = lambda a: f"CASE WHEN hyp > 0 THEN ({a} - {CENTRE}::DOUBLE) / hyp ELSE 0.0::DOUBLE END"
    return f"""sz AS ({_smoothed_sql("coded", "z", "u")}), sy AS ({_smoothed_sql("sz", "y", "s")}), sx AS ({_smoothed_sql("sy", "x", "s")}),
g AS (SELECT a.z, a.y, a.x, a.s, {", ".join(map(part, AXES))} FROM sx a {sides}),
l AS (SELECT *, sqrt(g_z * g_z + g_y * g_y + g_x * g_x) AS len, sqrt((y - {CENTRE}::DOUBLE)**2 + (x - {CENTRE}::DOUBLE)**2) AS hyp FROM g),
o AS (SELECT *, len >= {STEEP} AS n_ok, 0.0::DOUBLE AS r_z, {away("y")} AS r_y, {away("x")} AS r_x FROM l),
n AS (SELECT *, {", ".join(f"CASE WHEN n_ok THEN g_{a} / len ELSE r_{a} END AS w_{a}" for a in AXES)} FROM o),
f AS (SELECT z, y, x, s, n_ok, {", ".join(f"CASE WHEN w_z * r_z + w_y * r_y + w_x * r_x < 0 THEN -w_{a} ELSE w_{a} END AS n_{a}" for a in AXES)} FROM n)"""


def _stepped_sql(rows: str, reach: int) -> str:
    return f"""SELECT a.z, a.y, a.x, k.t, {", ".join(f"CAST(round_even(a.{a} + k.t * a.n_{a}, 0) AS INT) AS q{a}" for a in AXES)}
  FROM {rows} a, (SELECT unnest(range(-{reach}, {reach + 1})) AS t) k WHERE k.t <> 0"""


_AT = "q.qz = b.z AND q.qy = b.y AND q.qx = b.x"
_BODY_SQL = f"""m AS (SELECT z, y, x FROM f WHERE s > {RULES.body_above}), lines AS ({_stepped_sql("f", RULES.close_reach)}),
grown AS (SELECT z, y, x FROM m UNION SELECT q.z, q.y, q.x FROM lines q JOIN m b ON {_AT}),
rest0 AS (SELECT z, y, x FROM f EXCEPT SELECT * FROM grown),
closed AS (SELECT * FROM grown EXCEPT SELECT q.z, q.y, q.x FROM lines q JOIN rest0 b ON {_AT})"""


def _closed(rows: DataFrame) -> DataFrame:
    out = faces.outward_normal(rows, vectors.scale(tuple(F.col(f"g_{a}") for a in AXES), 1 / STEEP), radial(), 1.0)
    return materialize(out, "normals")


@register("closed_along_normals", f"""WITH {VOXELS_SQL}, {gradient_sql()}, {_BODY_SQL}
SELECT z, count(*) AS n, count(*) FILTER (WHERE NOT was) AS n_joined FROM (SELECT c.*, m.z IS NOT NULL AS was FROM closed c LEFT JOIN m USING (z, y, x))
  GROUP BY z""")
def closed_along_normals(spark: SparkSession, folder: str) -> DataFrame:
    """A body closed by a line of two steps along each voxel's own normal, by layer, and what joined it."""
    rows = _closed(face_rows(spark, folder))
    mask = rows.where(F.col("smooth") > RULES.body_above).select(*AXES)
    closed = faces.close_along(rows, mask, tuple(map(F.col, faces.NORMAL)), RULES.close_reach)
    both = closed.join(mask.withColumn("was", F.lit(1)), AXES, "left")
    return both.groupBy("z").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("was").isNull(), 1)).alias("n_joined"))


@register("first_and_last_contacts", f"""WITH {VOXELS_SQL}, {gradient_sql()}, b AS (SELECT z, y, x FROM f WHERE s > {RULES.body_above}),
q AS ({_stepped_sql("f", 4)}), h AS (SELECT q.z, q.y, q.x, min(t) FILTER (WHERE t > 0) AS first_ahead, max(t) FILTER (WHERE t > 0) AS last_ahead,
  min(-t) FILTER (WHERE t < 0) AS first_behind, max(-t) FILTER (WHERE t < 0) AS last_behind FROM q JOIN b ON {_AT} GROUP BY 1, 2, 3)
SELECT CAST(first_ahead AS INT) AS first_ahead, CAST(last_ahead AS INT) AS last_ahead, CAST(first_behind AS INT) AS first_behind,
  CAST(last_behind AS INT) AS last_behind, count(*) AS n FROM f LEFT JOIN h USING (z, y, x) GROUP BY 1, 2, 3, 4""")
def first_and_last_contacts(spark: SparkSession, folder: str) -> DataFrame:
    """How far ahead and behind along its own normal each voxel first and last meets a body, within four steps."""
    rows = _closed(face_rows(spark, folder))
    met = faces.contacts(rows, rows.where(F.col("smooth") > RULES.body_above), tuple(map(F.col, faces.NORMAL)), 4)
    return met.groupBy("first_ahead", "last_ahead", "first_behind", "last_behind").agg(F.count(F.lit(1)).alias("n"))


def _number(c: str) -> str:
    return f"CAST({c}.z AS BIGINT) * 1099511627776 + CAST({c}.y AS BIGINT) * 1048576 + {c}.x"


def _near(a: str, b: str, r: int) -> str:
    return " AND ".join(f"{b}.{c} BETWEEN {a}.{c} - {r} AND {a}.{c} + {r}" for c in AXES)


def _d2(a: str, b: str) -> str:
    return "(" + " + ".join(f"CAST(({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c}) AS BIGINT)" for c in AXES) + ")"


def _nearest_sql(targets: str, columns: str) -> str:
    """Each voxel of f with the nearest of all targets, of equals the lowest place."""
    key = f"{_d2('a', 't')} * 1073741824 + t.z * 1048576 + t.y * 1024 + t.x"
    return f"""SELECT k.z, k.y, k.x, k.k // 1073741824 AS d2, {columns} FROM (SELECT a.z, a.y, a.x, min({key}) AS k FROM f a, {targets} t GROUP BY 1, 2, 3) k
  JOIN {targets} t ON t.z = k.k // 1048576 % 1024 AND t.y = k.k // 1024 % 1024 AND t.x = k.k % 1024"""


def _side_sql(face: str) -> str:
    dot = " + ".join(f"({c} - t{c}) * tn{c}" for c in AXES)
    return f"CASE WHEN {dot} < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END * least(sqrt(d2), {RULES.clip}::DOUBLE) AS {face}"


def _code_sql(value: str) -> str:
    return f"CAST(least(255.0, greatest(1.0, round_even(128 + greatest(-{RULES.clip}::DOUBLE, least({RULES.clip}::DOUBLE, {value})) * (127.0::DOUBLE / {RULES.clip}::DOUBLE), 0))) AS INT)"


_FACE_COLUMNS = ", ".join([*(f"t.{c} AS t{c}" for c in AXES), *(f"t.n_{c} AS tn{c}" for c in AXES), "t.touches"])
_FACE_SQL = f"""WITH RECURSIVE {VOXELS_SQL}, {gradient_sql()}, {_BODY_SQL},
idd AS (SELECT z, y, x, {_number("c")} AS id FROM closed c), e AS (SELECT a.id AS a, b.id AS b FROM idd a JOIN idd b ON {_near("a", "b", 1)}),
reach AS (SELECT id AS node, id AS other FROM idd UNION SELECT r.node, e.b FROM reach r JOIN e ON e.a = r.other),
comp AS (SELECT node AS id, min(other) AS component FROM reach GROUP BY node),
sizes AS (SELECT component FROM comp GROUP BY component HAVING count(*) >= {RULES.least_component}),
sheet AS (SELECT z, y, x, component FROM idd JOIN comp USING (id) JOIN sizes USING (component)),
rest AS (SELECT z, y, x FROM f EXCEPT SELECT z, y, x FROM sheet),
deep AS (SELECT s.z, s.y, s.x, s.component, sqrt(min({_d2("s", "r")})) AS depth FROM sheet s JOIN rest r ON {_near("s", "r", 5)} GROUP BY 1, 2, 3, 4),
middle AS (SELECT a.z, a.y, a.x, a.component, 2 * a.depth AS thick FROM deep a JOIN deep b ON {_near("a", "b", 1)} GROUP BY a.z, a.y, a.x, a.component, a.depth
  HAVING a.depth >= max(b.depth) - 0.5),
apt AS (SELECT component, quantile_cont(thick, 0.5) BETWEEN {RULES.thickness[0]} AND {RULES.thickness[1]} AS apt FROM middle GROUP BY component),
mid AS (SELECT * FROM middle JOIN apt USING (component)), nm AS ({_nearest_sql("mid", "t.thick, t.apt")}),
edge AS (SELECT DISTINCT f.* FROM f JOIN sheet USING (z, y, x) JOIN rest r ON abs(r.z - f.z) + abs(r.y - f.y) + abs(r.x - f.x) = 1 AND {_near("f", "r", 1)}),
q AS ({_stepped_sql("edge", RULES.side_reach)}), h AS (SELECT q.z, q.y, q.x, bool_or(t > 0) AS ahead, bool_or(t < 0) AS behind, bool_or(t BETWEEN 1 AND
  {RULES.contact_reach}) AS touches FROM q JOIN sheet b ON {_AT} GROUP BY 1, 2, 3),
edges AS (SELECT e.*, coalesce(h.ahead, false) AS ahead, coalesce(h.behind, false) AS behind, coalesce(h.touches, false) AS touches FROM edge e LEFT JOIN h
  USING (z, y, x)),
inner_ AS (SELECT * FROM edges WHERE ahead AND NOT behind), outer_ AS (SELECT * FROM edges WHERE behind AND NOT ahead),
unknown AS (SELECT * FROM edges WHERE ahead = behind),
ni AS (SELECT z, y, x, {_side_sql("d_in")} FROM ({_nearest_sql("inner_", _FACE_COLUMNS)})),
no_ AS (SELECT z, y, x, touches, {_side_sql("d_out")} FROM ({_nearest_sql("outer_", _FACE_COLUMNS)})),
nu AS (SELECT f.z, f.y, f.x, min({_d2("f", "u")}) AS du FROM f JOIN unknown u ON {_near("f", "u", RULES.side_reach)}
  WHERE {_d2("f", "u")} <= {RULES.side_reach**2}
  GROUP BY 1, 2, 3),
j AS (SELECT f.z, f.y, f.x, f.n_ok, c.u, c.valid, nm.thick, nm.apt, coalesce(ni.d_in, {RULES.clip}::DOUBLE) AS d_in,
  coalesce(no_.d_out, CASE WHEN nm.thick IS NULL THEN {RULES.clip}::DOUBLE ELSE -{RULES.clip}::DOUBLE END) AS d_out, coalesce(no_.touches, false) AS touches,
  nu.du
  FROM f JOIN coded c USING (z, y, x) LEFT JOIN nm USING (z, y, x) LEFT JOIN ni USING (z, y, x) LEFT JOIN no_ USING (z, y, x) LEFT JOIN nu USING (z, y, x)),
v AS (SELECT *, least(abs(d_in), abs(d_out)) AS near FROM j)
SELECT CASE WHEN valid = 0 THEN 0 ELSE {_code_sql("d_in")} END AS sdf_in, CASE WHEN valid = 0 THEN 0 ELSE {_code_sql("d_out")} END AS sdf_out,
  CASE WHEN valid = 0 THEN 0 ELSE CAST(least(255, round_even(coalesce(thick, 0), 0)) AS INT) END AS thickness,
  CASE WHEN valid = 0 THEN 0 WHEN thick IS NULL OR NOT apt OR coalesce(sqrt(du) <= near, false) OR touches AND abs(d_out) < {RULES.clip}
    OR u BETWEEN {RULES.doubtful[0]} AND {RULES.doubtful[1]} AND near > {RULES.sure_near} OR NOT n_ok THEN 2 ELSE 1 END AS faces_valid, count(*) AS n
FROM v GROUP BY 1, 2, 3, 4"""


@register("face_labels", _FACE_SQL)
def face_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of both faces of the bodies that the smoothed intensity leaves, with thickness and the rules of validity, counted by their codes."""
    normal = vectors.scale(tuple(F.col(f"g_{a}") for a in AXES), 1 / STEEP)
    built = faces.face_labels(face_rows(spark, folder), radial(), RULES, normal, 1.0)
    return built.groupBy("sdf_in", "sdf_out", "thickness", "faces_valid").agg(F.count(F.lit(1)).alias("n"))


#: Bands of the smoothed intensity: inner, outer, and both.
BANDS = faces.BandRules(least_component=3, window=2, least_count=5, planarity=0.7, clip=4.0)
_BAND_SQL = "CASE WHEN s > 150 THEN 3 WHEN s > 144 THEN 1 WHEN s < 112 THEN 2 ELSE 0 END"


def crest_of_sql(name: str, codes: tuple[int, ...]) -> str:
    """``t_name``: the crest of the large components of some bands of ``w``."""
    n = name
    return f"""i_{n} AS (SELECT z, y, x, {_number("w")} AS id FROM w WHERE band IN {codes}), e_{n} AS (SELECT a.id AS a, b.id AS b FROM i_{n} a
  JOIN i_{n} b ON {_near("a", "b", 1)}),
h_{n} AS (SELECT id AS node, id AS other FROM i_{n} UNION SELECT h.node, e.b FROM h_{n} h JOIN e_{n} e ON e.a = h.other),
l_{n} AS (SELECT node AS id, min(other) AS component FROM h_{n} GROUP BY node),
m_{n} AS (SELECT z, y, x FROM i_{n} JOIN l_{n} USING (id) WHERE component IN (SELECT component FROM l_{n}
  GROUP BY component HAVING count(*) >= {BANDS.least_component})),
r_{n} AS (SELECT z, y, x FROM w EXCEPT SELECT * FROM m_{n}),
d_{n} AS (SELECT m.z, m.y, m.x, sqrt(min({_d2("m", "r")})) AS depth FROM m_{n} m JOIN r_{n} r ON {_near("m", "r", 5)} GROUP BY 1, 2, 3),
t_{n} AS (SELECT a.z, a.y, a.x FROM d_{n} a JOIN d_{n} b ON {_near("a", "b", 1)} GROUP BY a.z, a.y, a.x, a.depth HAVING a.depth >= max(b.depth) - 0.5)"""


def _band_normal_sql() -> str:
    pairs = [(a, b) for i, a in enumerate(AXES) for b in AXES[i:]]
    spread = ", ".join(f"CAST(n * s{a}{b} - s{a} * s{b} AS DOUBLE) / CAST(n * n AS DOUBLE) AS {a}{b}" for a, b in pairs)
    rows = (("(zz - low)", "zy", "zx"), ("zy", "(yy - low)", "yx"), ("zx", "yx", "(xx - low)"))
    cross = [[f"({a[1]} * {b[2]} - {a[2]} * {b[1]})", f"({a[2]} * {b[0]} - {a[0]} * {b[2]})", f"({a[0]} * {b[1]} - {a[1]} * {b[0]})"] for a, b in ((rows[0],
        rows[1]),
        (rows[0], rows[2]), (rows[1], rows[2]))]
    parts = ", ".join(f"{c} AS k{i}{a}" for i, three in enumerate(cross) for a, c in zip(AXES, three, strict=True))
    size = lambda i: f"(k{i}z * k{i}z + k{i}y * k{i}y + k{i}x * k{i}x)"
    return f"""pts AS (SELECT * FROM t_in UNION SELECT * FROM t_out),
mo AS (SELECT p.z, p.y, p.x, count(*) AS n, {", ".join(f"CAST(sum(b.{a}) AS BIGINT) AS s{a}" for a in AXES)},
  {", ".join(f"CAST(sum(b.{a} * b.{b}) AS BIGINT) AS s{a}{b}" for a, b in pairs)}
  FROM pts p JOIN w b ON b.band > 0 AND {_near("p", "b", BANDS.window)} GROUP BY 1, 2, 3),
c0 AS (SELECT z, y, x, n, {spread} FROM mo), c1 AS (SELECT *, (zz + yy + xx) / 3 AS q, zy * zy + zx * zx + yx * yx AS off FROM c0),
c2 AS (SELECT *, sqrt((pow(zz - q, 2) + pow(yy - q, 2) + pow(xx - q, 2) + 2 * off) / 6) AS p FROM c1),
c3 AS (SELECT *, acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE,
  ((zz - q) / p * ((yy - q) / p * ((xx - q) / p) - yx / p * (yx / p)) - zy / p * (zy / p * ((xx - q) / p) - yx / p * (zx / p))
  + zx / p * (zy / p * (yx / p) - (yy - q) / p * (zx / p))) / 2))) / 3 AS phi FROM c2),
c4 AS (SELECT *, CASE WHEN p < 1e-12 THEN q ELSE q + 2 * p * cos(phi + 2.0943951023931953::DOUBLE) END AS low, CASE WHEN p < 1e-12 THEN q
  ELSE q + 2 * p * cos(phi) END AS high FROM c3),
c5 AS (SELECT *, 3 * q - low - high AS mid, {parts} FROM c4),
c6 AS (SELECT *, {", ".join(f"CASE WHEN {size(0)} >= {size(1)} AND {size(0)} >= {size(2)} THEN k0{a} WHEN {size(1)} >= {size(2)} THEN k1{a} ELSE k2{a} END AS v{a}" for a in AXES)} FROM c5),
c7 AS (SELECT *, sqrt(vz * vz + vy * vy + vx * vx) AS vl FROM c6),
nv AS (SELECT c7.z, c7.y, c7.x, coalesce(n >= {BANDS.least_count} AND mid > 1e-9 AND low <= {BANDS.planarity} * mid AND vl > 1e-9, false) AS ok, r_z, r_y, r_x,
  {", ".join(f"v{a} / vl * CASE WHEN vz / vl * r_z + vy / vl * r_y + vx / vl * r_x < 0 THEN -1 ELSE 1 END AS o{a}" for a in AXES)} FROM c7
  JOIN o ON o.z = c7.z AND o.y = c7.y AND o.x = c7.x),
nb AS (SELECT z, y, x, false AS touches, ok, {", ".join(f"CASE WHEN ok THEN o{a} ELSE r_{a} END AS n_{a}" for a in AXES)} FROM nv)"""


@register("band_face_labels", f"""WITH RECURSIVE {VOXELS_SQL}, {gradient_sql()}, w AS (SELECT f.z, f.y, f.x, {_BAND_SQL} AS band, c.valid FROM f
  JOIN coded c USING (z, y, x)),
{crest_of_sql("in", BANDS.inner)}, {crest_of_sql("out", BANDS.outer)}, {_band_normal_sql()},
fin AS (SELECT nb.* FROM nb JOIN t_in USING (z, y, x)), fout AS (SELECT nb.* FROM nb JOIN t_out USING (z, y, x)),
ni AS (SELECT z, y, x, CASE WHEN (z - tz) * tnz + (y - ty) * tny + (x - tx) * tnx < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END * sqrt(d2) AS d_in
  FROM ({_nearest_sql("fin", _FACE_COLUMNS)})),
no_ AS (SELECT z, y, x, CASE WHEN (z - tz) * tnz + (y - ty) * tny + (x - tx) * tnx < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END * sqrt(d2) AS d_out
  FROM ({_nearest_sql("fout", _FACE_COLUMNS)})),
j AS (SELECT w.*, d_in, d_out, d_in IS NOT NULL AND d_out IS NOT NULL AS found FROM w LEFT JOIN ni USING (z, y, x) LEFT JOIN no_ USING (z, y, x))
SELECT CASE WHEN valid = 0 THEN 0 ELSE {_code_sql(f"CASE WHEN found THEN d_in ELSE {BANDS.clip} END")} END AS sdf_in, CASE WHEN valid = 0 THEN 0
  ELSE {_code_sql(f"CASE WHEN found THEN d_out ELSE {BANDS.clip} END")} END AS sdf_out, CASE WHEN valid > 0 AND found AND d_in >= 0 AND d_out <= 0
  THEN CAST(least(255, round_even(d_in - d_out, 0)) AS INT) ELSE 0 END AS thickness, CASE WHEN valid = 0 THEN 0 WHEN found AND abs(d_in) <= {BANDS.clip}
  AND abs(d_out) <= {BANDS.clip}
  THEN 1 ELSE 2 END AS faces_valid, count(*) AS n FROM j GROUP BY 1, 2, 3, 4""")
def band_face_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of both faces from bands of the smoothed intensity, with normals from the bands' places, counted by their codes."""
    band = F.when(F.col("smooth") > 150, 3).when(F.col("smooth") > 144, 1).when(F.col("smooth") < 112, 2).otherwise(0)
    rows = face_rows(spark, folder).select(*AXES, band.alias("band"), "data")
    return faces.band_faces(rows, radial(), BANDS).groupBy("sdf_in", "sdf_out", "thickness", "faces_valid").agg(F.count(F.lit(1)).alias("n"))
