"""Queries on the fine winding between two faces and its coarse prior."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickwise.functions import vectors
from brickwise.operators import grid, winding
from brickwise.plans.catalog import register
from brickwise.runtime import materialize
from brickwise.sources.voxels import VOXELS_SQL, coded_voxels

AXES = list(grid.AXES)
CENTRE, FACTOR = 15.5, 2
RULES = winding.WindingRules(clip=4.0, period=(6.0, 15.2), saturated=0.2, slope=(0.5, 4.0), least=7.0, offset=0.125, snap=0.4)


def winding_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Voxels with codes of two faces, drawn from their values, with the coarse field of blocks of two voxels as prior."""
    voxels = materialize(coded_voxels(spark, folder).select(*AXES, "u", "valid", "label"), "winding-voxels")
    fine = voxels.select(*AXES, F.col("u").alias("sdf_in"), (F.col("u") * 7 + F.col("z") * 3 + F.col("x")).alias("o"), F.col("valid").alias("faces_valid"))
    fine = fine.select(*AXES, "sdf_in", (F.col("o") % 256).alias("sdf_out"), "faces_valid")
    blocks = voxels.groupBy(*[F.floor(F.col(a) / FACTOR).cast("int").alias(a) for a in AXES]).agg(F.avg(F.sin("u")).alias("sine"),
        F.avg(F.cos("u")).alias("cosine"),
        F.max(F.when(F.col("label") % 3 == 0, 0).otherwise(1)).alias("v"))
    return winding.masked_upsample(fine, blocks, ["sine", "cosine"], "v", FACTOR)


def radial() -> vectors.Vec:
    ry, rx = vectors.radial(F.col("y"), F.col("x"), F.lit(CENTRE), F.lit(CENTRE))
    return F.lit(0.0), ry, rx


_AT = {a: f"((a.{a} + 0.5::DOUBLE) / {FACTOR} - 0.5::DOUBLE)" for a in AXES}
_CORNER = {a: f"CASE k{a}.n WHEN 1 THEN {p} - floor({p}) ELSE 1 - ({p} - floor({p})) END" for a, p in _AT.items()}
PRIOR_SQL = f"""fine AS (SELECT z, y, x, u AS sdf_in, (u * 7 + z * 3 + x) % 256 AS sdf_out, valid AS faces_valid FROM coded),
blk AS (SELECT z // {FACTOR} AS z, y // {FACTOR} AS y, x // {FACTOR} AS x, avg(sin(u)) AS sine, avg(cos(u)) AS cosine, max(CASE WHEN label % 3 = 0 THEN 0
  ELSE 1 END) AS v
  FROM coded GROUP BY 1, 2, 3),
o(n) AS (VALUES (0), (1)),
met AS (SELECT a.z, a.y, a.x, ({_CORNER["z"]}) * ({_CORNER["y"]}) * ({_CORNER["x"]}) AS w, b.v, b.sine, b.cosine FROM fine a, o kz, o ky, o kx, blk b
  WHERE {" AND ".join(f"b.{a} = CAST(floor({_AT[a]}) AS INT) + k{a}.n" for a in AXES)}),
su AS (SELECT z, y, x, sum(w) AS w, sum(CASE WHEN v = 1 THEN w ELSE 0 END) AS part, sum(CASE WHEN v = 1 THEN w * sine ELSE 0 END) AS s,
  sum(CASE WHEN v = 1 THEN w * cosine ELSE 0 END) AS c FROM met GROUP BY 1, 2, 3),
pr AS (SELECT f.*, coalesce(part >= 0.5 * w, false) AS known, coalesce(CASE WHEN part >= 0.5 * w THEN s / part END, 0) AS p_s,
  coalesce(CASE WHEN part >= 0.5 * w THEN c / part END, 0) AS p_c, CASE WHEN part >= 0.5 * w THEN b.v ELSE 0 END AS pv
  FROM fine f LEFT JOIN su USING (z, y, x) LEFT JOIN blk b ON b.z = f.z // {FACTOR} AND b.y = f.y // {FACTOR} AND b.x = f.x // {FACTOR})"""


@register("coarse_prior_on_fine", f"""WITH {VOXELS_SQL}, {PRIOR_SQL}
SELECT pv AS prior_valid, z, count(*) AS n, round(sum(p_s), 5) AS sine, round(sum(p_c), 5) AS cosine FROM pr GROUP BY 1, 2""")
def coarse_prior_on_fine(spark: SparkSession, folder: str) -> DataFrame:
    """Sine and cosine of a coarse phase on fine voxels, between valid coarse ones only, by layer and validity."""
    rows = winding_rows(spark, folder)
    return rows.groupBy("prior_valid", "z").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("prior_sine"), 5).alias("sine"), F.round(F.sum("prior_cosine"),
        5).alias("cosine"))


def _fill_sql(name: str, condition: str, sign: str) -> str:
    d2 = " + ".join(f"CAST((a.{c} - t.{c}) * (a.{c} - t.{c}) AS BIGINT)" for c in AXES)
    return f"""{name}_at AS (SELECT z, y, x, {sign}(i - o) AS v FROM us WHERE {condition}), {name}_n AS (SELECT a.z, a.y, a.x,
  min(({d2}) * 1073741824 + t.z * 1048576 + t.y * 1024 + t.x) AS k
  FROM pr a, {name}_at t GROUP BY 1, 2, 3), {name} AS (SELECT n.z, n.y, n.x, t.v FROM {name}_n n JOIN {name}_at t ON t.z = k // 1048576 % 1024 AND
  t.y = k // 1024 % 1024 AND t.x = k % 1024)"""


def _slope_sql(c: str) -> str:
    sides = " ".join(f"LEFT JOIN de {n}{a} ON {' AND '.join(f'{n}{a}.{b} = a.{b}' + (step if a == b else '') for b in AXES)}" for a in AXES for n,
        step in (("p",
        " + 1"), ("m", " - 1")))
    parts = ", ".join(f"coalesce((p{a}.{c} - m{a}.{c}) / 2, p{a}.{c} - a.{c}, a.{c} - m{a}.{c}, 0.0::DOUBLE) AS g{c}{a}" for a in AXES)
    return f"g{c} AS (SELECT a.z, a.y, a.x, {parts} FROM de a {sides})"


def _vote_sql(c: str) -> str:
    return f"(sqrt(g{c}z * g{c}z + g{c}y * g{c}y + g{c}x * g{c}x) BETWEEN {RULES.slope[0]} AND {RULES.slope[1]} AND data AND NOT full_{c})"


_SIGNED = "CAST(least(255.0, greatest(0.0, round_even(127.5 + 127.5 * ({}), 0))) AS INT)"
_MOD = "CASE WHEN ({0}) % 1 < 0 THEN (({0}) % 1 + 1) % 1 ELSE ({0}) % 1 END"
_WINDING_SQL = f"""de AS (SELECT *, (sdf_in - 128) * ({RULES.clip}::DOUBLE / 127.0::DOUBLE) AS i, (sdf_out - 128) * ({RULES.clip}::DOUBLE / 127.0::DOUBLE) AS o,
  sdf_in > 0 AND sdf_out > 0 AND faces_valid > 0 AS data FROM pr),
us AS (SELECT * FROM de WHERE data AND abs(i) < {RULES.clip - RULES.saturated} AND abs(o) < {RULES.clip - RULES.saturated}),
{_fill_sql("th", f"i - o > {RULES.least}", "")}, {_fill_sql("ga", f"i - o < -{RULES.least}", "-")}, {_slope_sql("i")}, {_slope_sql("o")},
al AS (SELECT d.*, abs(i) >= {RULES.clip - RULES.saturated} AS full_i, abs(o) >= {RULES.clip - RULES.saturated} AS full_o, th.v + ga.v AS raw,
  gi.* EXCLUDE (z, y, x), go.* EXCLUDE (z, y, x)
  FROM de d LEFT JOIN th USING (z, y, x) LEFT JOIN ga USING (z, y, x) JOIN gi USING (z, y, x) JOIN go USING (z, y, x)),
vo AS (SELECT *, {", ".join(f"CASE WHEN {_vote_sql('i')} THEN gi{a} ELSE 0 END + CASE WHEN {_vote_sql('o')} THEN go{a} ELSE 0 END AS n{a}" for a in AXES)},
  CASE WHEN {_vote_sql("i")} THEN sqrt(giz * giz + giy * giy + gix * gix) ELSE 0 END + CASE WHEN {_vote_sql("o")}
  THEN sqrt(goz * goz + goy * goy + gox * gox) ELSE 0 END AS lens
  FROM al),
le AS (SELECT *, sqrt(nz * nz + ny * ny + nx * nx) AS len, sqrt((y - {CENTRE})**2 + (x - {CENTRE})**2) AS hyp, greatest({RULES.period[0]}::DOUBLE,
  least({RULES.period[1]}::DOUBLE, raw)) AS period
  FROM vo),
ph AS (SELECT *, {_MOD.format(f"i / period + {RULES.offset}")} AS phase, {_MOD.format("atan2(p_s, p_c) / 6.283185307179586::DOUBLE")} AS prior,
  len > 1e-3 AS has,
  nz / len AS uz, ny / len AS uy, nx / len AS ux, (y - {CENTRE}) / hyp AS ry, (x - {CENTRE}) / hyp AS rx FROM le),
sn AS (SELECT *, abs(prior - phase - round_even(prior - phase, 0)) AS off FROM ph),
fi AS (SELECT *, data AND faces_valid = 1 AND NOT full_i AND raw BETWEEN {RULES.period[0]} AND {RULES.period[1]} AND has AND pv = 1
  AND off < {RULES.snap} AS ok,
  least(1.0::DOUBLE, len / greatest(lens, 1e-6)) * greatest(0.0::DOUBLE, 1 - off / {RULES.snap}) AS conf,
  CASE WHEN uy * ry + ux * rx < 0 THEN -1 ELSE 1 END AS side FROM sn)"""


@register("fine_winding", f"""WITH {VOXELS_SQL}, {PRIOR_SQL}, {_WINDING_SQL}
SELECT CAST(ok AS INT) AS valid, z, count(*) AS n, CAST(sum(CASE WHEN ok THEN {_SIGNED.format("sin(phase * 6.283185307179586::DOUBLE)")}
  ELSE 128 END) AS BIGINT) AS sine,
  CAST(sum(CASE WHEN ok THEN {_SIGNED.format("cos(phase * 6.283185307179586::DOUBLE)")} ELSE 128 END) AS BIGINT) AS cosine,
  CAST(sum(CASE WHEN ok THEN least(255, round_even(1 / period * 1000, 0)) ELSE 0 END) AS BIGINT) AS density,
  {", ".join(f"CAST(sum(CASE WHEN ok THEN {_SIGNED.format(f'side * u{a}')} ELSE 128 END) AS BIGINT) AS n_{a}" for a in AXES)},
  CAST(sum(CASE WHEN ok THEN round_even(conf * 255, 0) ELSE 0 END) AS BIGINT) AS conf FROM (SELECT * REPLACE (coalesce(ok, false) AS ok) FROM fi) GROUP BY 1,
  2""")
def fine_winding(spark: SparkSession, folder: str) -> DataFrame:
    """The fine winding field of codes of two faces, gated by the coarse prior, summed by layer and validity."""
    phase = winding.phase_of(F.col("prior_sine"), F.col("prior_cosine"))
    found = winding.fine_winding(winding_rows(spark, folder), radial(), RULES, None, phase, F.col("prior_valid"))
    sums = [F.sum(c).alias(c) for c in ("sine", "cosine", "density", "n_z", "n_y", "n_x", "conf")]
    return found.groupBy("valid", "z").agg(F.count(F.lit(1)).alias("n"), *sums)
