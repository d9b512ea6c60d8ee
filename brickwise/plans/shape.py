"""Queries on local shape: targets, and their losses against a prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickwise.operators import fields, grid, losses, shape, stencil
from brickwise.plans.catalog import register
from brickwise.plans.faces import gradient_sql
from brickwise.sources.voxels import VOXELS_SQL, coded_voxels

AXES = list(grid.AXES)
SIGMA, FACTOR, CLIP = 3.0, 2, 6.0
_RADIUS = max(1, int(shape.TRUNCATE * SIGMA / FACTOR + 0.5))


def shape_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Voxels with distances to two faces, drawn from their values, and the unit gradient of the smoothed code as normal."""
    rows = coded_voxels(spark, folder).withColumn("ct", F.col("u").cast("double"))
    sloped = fields.gradient(stencil.gaussian(rows, "ct", 1.0, "smooth"), "smooth")
    length = F.sqrt(sum((F.col(f"g_{a}") * F.col(f"g_{a}") for a in AXES), F.lit(0.0)))
    inner = 16 * F.col("v") + 1
    return sloped.select(*AXES, "valid", inner.alias("inner"), (inner - 3 - F.col("label") % 3).alias("outer"),
        *[(F.col(f"g_{a}") / F.greatest(length, F.lit(8.0))).alias(f"n_{a}") for a in AXES])


def shape_targets_of(rows: DataFrame) -> DataFrame:
    return shape.shape_targets(rows, F.col("inner"), F.col("outer"), F.col("valid"), tuple(F.col(f"n_{a}") for a in AXES), SIGMA, CLIP, FACTOR)


_WINDOWED = ["share", "thick", *shape._SCATTER]


def _window_sql(source: str, axis: str) -> str:
    same = " AND ".join(f"b.{a} = a.{a}" for a in AXES if a != axis)
    weight = f"exp(-0.5::DOUBLE * pow((b.{axis} - a.{axis}) / {SIGMA / FACTOR!r}::DOUBLE, 2))"
    return (f"SELECT a.z, a.y, a.x, {', '.join(f'sum({weight} * b.{v}) AS {v}' for v in _WINDOWED)} FROM {source} a JOIN {source} b "
        f"ON {same} AND b.{axis} BETWEEN a.{axis} - {_RADIUS} AND a.{axis} + {_RADIUS} GROUP BY 1, 2, 3")


def _eigen_sql() -> str:
    """Largest eigenvalue of the scatter over its trace, in closed form."""
    zz, yy, xx, zy, zx, yx = (f"({k} / tr)" for k in shape._SCATTER)
    return f"""e0 AS (SELECT *, zz + yy + xx AS tr FROM wx), e1 AS (SELECT *, ({zz} + {yy} + {xx}) / 3 AS q, {zy} * {zy} + {zx} * {zx} + {yx} * {yx} AS off
  FROM e0 WHERE tr > 0),
e2 AS (SELECT *, sqrt((pow({zz} - q, 2) + pow({yy} - q, 2) + pow({xx} - q, 2) + 2 * off) / 6) AS p FROM e1),
e3 AS (SELECT *, (({zz} - q) / p * (({yy} - q) / p * (({xx} - q) / p) - {yx} / p * ({yx} / p)) - {zy} / p * ({zy} / p * (({xx} - q) / p) - {yx} / p * ({zx} / p))
  + {zx} / p * ({zy} / p * ({yx} / p) - ({yy} - q) / p * ({zx} / p))) / 2 AS hd FROM e2),
known AS (SELECT e0.z, e0.y, e0.x, CASE WHEN e0.share > 0 THEN e0.thick / e0.share END AS windowed,
  greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - CASE WHEN p < 1e-12 THEN q ELSE q + 2 * p * cos(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE,
  hd))) / 3) END)) AS inco
  FROM e0 LEFT JOIN e3 USING (z, y, x))"""


_SHAPE_SQL = f"""{VOXELS_SQL}, {gradient_sql()},
r0 AS (SELECT c.z, c.y, c.x, c.label, c.valid, 16 * c.v + 1 AS i, 16 * c.v + 1 - 3 - c.label % 3 AS o,
  {", ".join(f"l.g_{a} / greatest(l.len, 8.0::DOUBLE) AS n{a}" for a in AXES)}
  FROM coded c JOIN l USING (z, y, x)),
r1 AS (SELECT *, i > 0 AND o < 0 AND valid = 1 AND sqrt(nz * nz + ny * ny + nx * nx) > 0.5 AS body FROM r0),
b0 AS (SELECT z // {FACTOR} AS z, y // {FACTOR} AS y, x // {FACTOR} AS x, avg(CASE WHEN body THEN 1.0::DOUBLE ELSE 0 END) AS share,
  avg(CASE WHEN body THEN greatest(0, least({2 * CLIP}::DOUBLE, abs(i) + abs(o))) ELSE 0 END) AS thick,
  {", ".join(f"sum(CASE WHEN body THEN n{a} ELSE 0 END) AS s{a}" for a in AXES)} FROM r1 GROUP BY 1, 2, 3),
b1 AS (SELECT *, sqrt(sz * sz + sy * sy + sx * sx) AS len FROM b0),
b2 AS (SELECT z, y, x, share, thick, {", ".join(f"CASE WHEN len > 1e-6 THEN s{a} / len ELSE 0 END AS m{a}" for a in AXES)} FROM b1),
b3 AS (SELECT z, y, x, share, thick, {", ".join(f"m{AXES[i]} * m{AXES[j]} * share AS {k}" for k, (i, j) in shape._SCATTER.items())} FROM b2),
wz AS ({_window_sql("b3", "z")}), wy AS ({_window_sql("wz", "y")}), wx AS ({_window_sql("wy", "x")}), {_eigen_sql()},
t AS (SELECT r.z, r.y, r.x, CAST(body AS INT) AS valid, {", ".join(f"CASE WHEN body THEN n{a} * (abs(o) - abs(i)) * 0.5 ELSE 0 END AS off_{a}" for a in AXES)},
  CASE WHEN body THEN coalesce(windowed, 0) ELSE 0 END AS thick, CASE WHEN body THEN coalesce(inco, 0) ELSE 0 END AS incoherence
  FROM r1 r LEFT JOIN known k ON k.z = r.z // {FACTOR} AND k.y = r.y // {FACTOR} AND k.x = r.x // {FACTOR})"""


@register("local_shape_targets", f"""WITH {_SHAPE_SQL} SELECT z, CAST(sum(valid) AS BIGINT) AS n, round(sum(off_z), 6) AS off_z, round(sum(off_y), 6) AS off_y,
  round(sum(off_x), 6) AS off_x, round(sum(thick), 6) AS thick, round(sum(incoherence), 6) AS incoherence, round(max(incoherence), 6) AS most FROM t GROUP BY
  z""")
def local_shape_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Offsets to the centre plane, windowed thickness and incoherence of normals, summed by layer."""
    total = lambda c: F.round(F.sum(c), 6).alias(c)
    found = shape_targets_of(shape_rows(spark, folder))
    return found.groupBy("z").agg(F.sum("valid").alias("n"), *map(total, ["off_z", "off_y", "off_x", "thick", "incoherence"]),
        F.round(F.max("incoherence"), 6).alias("most"))


@register("local_shape_losses", f"""WITH {_SHAPE_SQL}, p AS (SELECT z, y, x, (u - 128) / 64.0::DOUBLE AS p FROM coded),
w AS (SELECT t.*, p, CASE WHEN t.valid = 1 THEN 1.0::DOUBLE ELSE 0 END AS m FROM t JOIN p USING (z, y, x))
SELECT z, round(sum((abs(p - off_z) + abs(p - off_y) + abs(-p - off_x)) / 3 / {CLIP} * m) / greatest(sum(m), 1), 5) AS off_l1,
  round(sum(abs(3 * p - thick) / {CLIP} * m) / greatest(sum(m), 1), 5) AS thick_l1,
  round(sum(abs(1 / (1 + exp(-p)) - incoherence) * m) / greatest(sum(m), 1), 5) AS ncov_l1 FROM w GROUP BY z""")
def local_shape_losses(spark: SparkSession, folder: str) -> DataFrame:
    """Losses of a prediction, drawn from the codes, against the targets of local shape, by layer."""
    guess = coded_voxels(spark, folder).select(*AXES, ((F.col("u") - 128) / 64.0).alias("p"))
    both = shape_targets_of(shape_rows(spark, folder)).join(guess, AXES)
    p = F.col("p")
    terms = losses.descriptor_terms([(p, F.col("off_z")), (p, F.col("off_y")), (-p, F.col("off_x"))], (3 * p, F.col("thick")), p, F.col("incoherence"),
        F.col("valid"), CLIP)
    return both.groupBy("z").agg(*[F.round(t, 5).alias(n) for n, t in terms.items()])
