"""Queries on spatial augmentation: every embedding's brick drawn anew through a linear map and an elastic field."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickwise.functions import vectors
from brickwise.operators import grid, warp
from brickwise.plans.catalog import register
from brickwise.sources.tables import table

AXES = list(grid.AXES)
SIZE, CLIP = (4, 4, 4), 4.0
TURN = vectors.rotation((1.0, 0.5, 0.25), 40.0)
WARP = warp.Warp([[0.8 * c for c in row[:3]] for row in TURN[:3]], 0.4, 3, "bricks")
_ROWS_SQL = """vox AS (SELECT vec_id AS box, label, pos // 16 AS z, pos // 4 % 4 AS y, pos % 4 AS x, CAST(value AS DOUBLE) AS v, pos FROM (SELECT vec_id, label,
  unnest(embedding) AS value, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)),
r AS (SELECT *, 32 * v AS d, 3 * v AS n_z, 1.0::DOUBLE AS n_y, v * v AS n_x, CASE WHEN pos % 11 = label THEN 0 WHEN pos % 13 = 5 THEN 2 ELSE 1 END AS valid
  FROM vox)"""


def bricks(spark: SparkSession, folder: str) -> DataFrame:
    """(box, z, y, x, v, d, n_*, valid): each embedding as a box of 4^3 voxels with an intensity, a distance and a vector drawn from its values."""
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("box"), "label", F.posexplode("embedding").alias("pos", "value"))
    v, pos = F.col("value").cast("double"), F.col("pos")
    valid = F.when(pos % 11 == F.col("label"), 0).when(pos % 13 == 5, 2).otherwise(1)
    return rows.select("box", F.floor(pos / 16).cast("int").alias("z"), (F.floor(pos / 4) % 4).cast("int").alias("y"), (pos % 4).alias("x"), v.alias("v"),
        (32 * v).alias("d"),
        (3 * v).alias("n_z"), F.lit(1.0).alias("n_y"), (v * v).alias("n_x"), valid.alias("valid"))


def _warp_sql(w: warp.Warp) -> str:
    """``p``: places with their origins p0..p2 and the pull-back's slopes j.."""
    n, back = w.grid, w.inverse()
    lit = lambda v: f"({float(v)!r}::DOUBLE)"
    step = lit((n - 1) / 3)
    uniform = lambda a, start: f"((('0x' || substr(md5('{w.seed}:' || box || ':{a}:' || i), {start}, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE)"
    normal = lambda a: f"sqrt(-2 * ln({uniform(a, 1)})) * cos(6.283185307179586::DOUBLE * {uniform(a, 9)}) * {lit(w.magnitude)} AS {a}"
    cell = lambda a: f"least(CAST(floor({a} * {step}) AS INT), {n - 2})"
    part = lambda a: f"({a} * {step} - c{a})"
    weight = lambda bits, along: " * ".join((f"({1 if b else -1} * {step})" if k == along else part(a) if b else f"(1 - {part(a)})") for k, (a,
        b) in enumerate(zip(AXES,
        bits, strict=True)))
    at = lambda bits: f"f[((cz + {bits[0]}) * {n} + cy + {bits[1]}) * {n} + cx + {bits[2]} + 1]"
    moved = lambda a, along: "(" + " + ".join(f"{weight(bits, along)} * {at(bits)}.{a}" for bits in itertools.product((0, 1), repeat=3)) + ")"
    linear = lambda r: " + ".join(f"{lit(back[r][c])} * ({a} - 1.5)" for c, a in enumerate(AXES))
    origin = ", ".join(f"{linear(r)} + {moved(a, None)} + 1.5 AS p{r}" for r, a in enumerate(AXES))
    slopes = ", ".join(f"{lit(back[r][c])} + {moved(a, c)} AS j{r}{c}" for r, a in enumerate(AXES) for c in range(3))
    return f"""ct AS (SELECT box, i, {", ".join(map(normal, AXES))} FROM (SELECT DISTINCT box FROM r), range({n**3}) g(i)),
fd AS (SELECT box, list({{'z': z, 'y': y, 'x': x}} ORDER BY i) AS f FROM ct GROUP BY box),
c0 AS (SELECT r.box, r.z, r.y, r.x, fd.f, {", ".join(f"{cell(a)} AS c{a}" for a in AXES)} FROM r JOIN fd USING (box)),
p AS (SELECT box, z, y, x, {origin}, {slopes} FROM c0)"""


def _drawn_sql(w: warp.Warp) -> str:
    corner = lambda k: f"CASE k{k}.b WHEN 1 THEN p{k} - floor(p{k}) ELSE 1 - (p{k} - floor(p{k})) END"
    j = [[f"j{r}{c}" for c in range(3)] for r in range(3)]
    minor = lambda r, c: f"({j[(r + 1) % 3][(c + 1) % 3]} * {j[(r + 2) % 3][(c + 2) % 3]} - {j[(r + 1) % 3][(c + 2) % 3]} * {j[(r + 2) % 3][(c + 1) % 3]})"
    det = f"(j00 * {minor(0, 0)} + j01 * {minor(0, 1)} + j02 * {minor(0, 2)})"
    mean = lambda c: f"CASE WHEN part > 1e-6 THEN s_{c} / part ELSE 0 END"
    tangent = [f"CASE WHEN {det} < 0 THEN -1 ELSE 1 END * ({' + '.join(f'{minor(c, r)} * m{a}' for c, a in enumerate(AXES))})" for r in range(3)]
    covector = [" + ".join(f"j{c}{r} * m{a}" for c, a in enumerate(AXES)) for r in range(3)]
    shrunk = "false" if w.scale() >= 1 - 1e-6 else f"abs(grown) >= {CLIP * w.scale() * (1 - 1e-3)!r}::DOUBLE"
    return f"""o(b) AS (VALUES (0), (1)),
k AS (SELECT p.*, ({corner(0)}) * ({corner(1)}) * ({corner(2)}) AS w, {", ".join(f"CAST(floor(p{i}) AS INT) + k{i}.b AS q{i}" for i in range(3))} FROM p,
  o k0, o k1, o k2),
h AS (SELECT *, {", ".join(f"greatest(0, least(3, q{i})) AS h{i}" for i in range(3))} FROM k WHERE w > 0),
s AS (SELECT h.box, h.z, h.y, h.x, sum(w) AS w, sum(CASE WHEN ok THEN w ELSE 0 END) AS part, sum(w * v) AS s_v,
  {", ".join(f"sum(CASE WHEN ok THEN w * {c} ELSE 0 END) AS s_{c}" for c in
  ("d", "n_z", "n_y", "n_x"))} FROM (SELECT h.*, r.v, r.d, r.n_z, r.n_y, r.n_x, r.valid = 1 AND q0 = h0 AND q1 = h1 AND q2 = h2 AS ok FROM h
  JOIN r ON r.box = h.box AND r.z = h0
  AND r.y = h1 AND r.x = h2) h GROUP BY 1, 2, 3, 4),
m AS (SELECT p.*, s_v / w AS v, {mean("d")} * {w.scale()!r}::DOUBLE AS grown, {", ".join(f"{mean(f'n_{a}')} AS m{a}" for a in AXES)},
  abs(p0 - 1.5) > 1.5001 OR abs(p1 - 1.5) > 1.5001 OR abs(p2 - 1.5) > 1.5001 AS outside, r.valid AS state FROM p LEFT JOIN s USING (box, z, y, x)
  LEFT JOIN r ON r.box = p.box AND r.z = CAST(round_even(p0, 0) AS INT) AND r.y = CAST(round_even(p1, 0) AS INT) AND r.x = CAST(round_even(p2, 0) AS INT)),
u AS (SELECT *, {", ".join(f"{t} AS t{a}" for t, a in zip(tangent, AXES, strict=True))},
  {", ".join(f"{t} AS c{a}" for t, a in zip(covector, AXES, strict=True))},
  CASE WHEN outside THEN 0 ELSE coalesce(state, 0) END AS st FROM m),
x AS (SELECT *, sqrt(tz * tz + ty * ty + tx * tx) AS tl, sqrt(cz * cz + cy * cy + cx * cx) AS cl, CASE WHEN st = 1 AND {shrunk} THEN 2 ELSE st END AS valid
  FROM u)
SELECT box, valid, count(*) AS n, round(sum(v), 4) AS v, round(sum(greatest(-{CLIP}, least({CLIP}, grown))), 4) AS d,
  {", ".join(f"round(sum(CASE WHEN tl > 1e-6 THEN t{a} / tl ELSE 0 END), 4) AS t_{a}, round(sum(CASE WHEN cl > 1e-6 THEN c{a} / cl ELSE 0 END), 4) AS n_{a}" for a in AXES)}
FROM x GROUP BY 1, 2"""


@register("elastic_bricks", f"WITH {_ROWS_SQL}, {_warp_sql(WARP)}, {_drawn_sql(WARP)}")
def elastic_bricks(spark: SparkSession, folder: str) -> DataFrame:
    """Bricks turned, shrunk and bent by a hashed field: intensities, a distance, a tangent and a normal under the local Jacobian, and validity, by brick."""
    rows = bricks(spark, folder).withColumns({f"t_{a}": F.col(f"n_{a}") for a in AXES})
    found = warp.warped(rows, SIZE, WARP, ["v"], [], ["d"], ["t"], ["n"], clip=CLIP)
    sums = [F.round(F.sum(c), 4).alias(c) for c in ("v", "d", *(f"{p}_{a}" for p in "tn" for a in AXES))]
    return found.groupBy("box", "valid").agg(F.count(F.lit(1)).alias("n"), *sums)
