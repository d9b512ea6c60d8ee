"""Queries on resumable builds of whole stores, on audits that compare two of them, and on caches and compressed arrays."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickwise.functions import codec
from brickwise.operators import audit, grid, joins, stencil
from brickwise.plans.catalog import register
from brickwise.runtime import materialize, scratch_root
from brickwise.sources import cache, chunks
from brickwise.sources.tables import table
from brickwise.sources.voxels import VOXELS_SQL, coded_voxels
from brickwise.streaming import builds, incremental

AXES = list(grid.AXES)
#: Bricks and halo of the build, in voxels; blocks of the coarse stage; how far distances go.
EDGE, HALO, BLOCK, REACH = 8, 4, 2, 3


def _d2(a: str, b: str) -> str:
    return f"(({a}.z - {b}.z)**2 + ({a}.y - {b}.y)**2 + ({a}.x - {b}.x)**2)"


def _near(a: str, b: str, r: int) -> str:
    return " AND ".join(f"{b}.{c} BETWEEN {a}.{c} - {r} AND {a}.{c} + {r}" for c in AXES)


def coarse_stage(rows: DataFrame) -> DataFrame:
    """Mean codes of blocks, at the block's first voxel."""
    keys = [(F.floor(F.col(a) / BLOCK) * BLOCK).cast("int").alias(a) for a in AXES]
    return rows.groupBy(*keys).agg(F.round(F.avg("u"), 6).alias("mean"))


def fine_stage(rows: DataFrame, coarse: DataFrame) -> DataFrame:
    """Distances to the bright surface as bytes, and validity, which ignores what the coarse stage finds too even."""
    surface = materialize(stencil.zero_crossing(rows, F.col("u") > 215, F.col("u") <= 215).select(*AXES), "surface")
    near = stencil.distance_within(rows.select(*AXES, "u", "valid"), surface, REACH)
    blocks = coarse.select(*[F.floor(F.col(a) / BLOCK).cast("int").alias(a) for a in AXES], "mean")
    both = joins.coarse_join(near, blocks, BLOCK)
    far = F.coalesce(F.sqrt("d2"), F.lit(float(REACH)))
    code = codec.encode_sdf(F.when(F.col("u") > 215, -far).otherwise(far), float(REACH))
    state = F.when(F.col("valid") == 0, 0).when((F.col("valid") == 2) | F.abs(F.col("mean") - 128).between(0, 6), 2).otherwise(1)
    return both.select(*AXES, F.when(F.col("valid") == 0, 0).otherwise(code).alias("code"), state.alias("state"))


@register("resumable_labels", f"""WITH {VOXELS_SQL}, c AS (SELECT z // {BLOCK} AS cz, y // {BLOCK} AS cy, x // {BLOCK} AS cx, round(avg(u), 6) AS mean
  FROM coded GROUP BY 1, 2, 3),
s AS (SELECT DISTINCT a.z, a.y, a.x FROM coded a JOIN coded b ON abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) = 1 AND {_near("a", "b", 1)}
  WHERE a.u > 215 AND b.u <= 215),
d AS (SELECT a.z, a.y, a.x, min({_d2("a", "s")}) AS d2 FROM coded a JOIN s ON {_near("a", "s", REACH)} WHERE {_d2("a", "s")} <= {REACH**2} GROUP BY 1, 2, 3),
j AS (SELECT v.*, coalesce(sqrt(d.d2), {REACH}) * CASE WHEN u > 215 THEN -1 ELSE 1 END AS sd, abs(c.mean - 128) AS off FROM coded v LEFT JOIN d USING (z, y, x)
  JOIN c ON cz = v.z // {BLOCK} AND cy = v.y // {BLOCK} AND cx = v.x // {BLOCK})
SELECT z // {EDGE} AS slab, CASE WHEN valid = 0 THEN 0 WHEN valid = 2 OR off <= 6 THEN 2 ELSE 1 END AS state,
  CASE WHEN valid = 0 THEN 0 ELSE CAST(least(255.0, greatest(1.0, round_even(128 + sd * (127.0::DOUBLE / {REACH}.0::DOUBLE), 0))) AS INT) END AS code,
  count(*) AS n
FROM j GROUP BY 1, 2, 3""")
def resumable_labels(spark: SparkSession, folder: str) -> DataFrame:
    """A coarse and a fine stage, built brick by brick into stores: the fine one stops after a wave and another call goes on from its marks."""
    rows = materialize(coded_voxels(spark, folder).select(*AXES, "u", "valid"), "source")
    path = f"{scratch_root(spark)}/labels-{uuid.uuid4().hex}"
    coarse = builds.BrickStore(spark, f"{path}/coarse", incremental.fingerprint("coarse", str(BLOCK)))
    builds.build(coarse, rows, coarse_stage, EDGE, 0, 100_000)
    fine = builds.BrickStore(spark, f"{path}/fine", incremental.fingerprint("fine", str(REACH), coarse.identity))
    make = lambda part: fine_stage(part, coarse.read())
    half = max(1, builds.planned_bricks(rows, EDGE).count() // 2)
    builds.build(fine, rows, make, EDGE, HALO, half, waves=1)
    builds.build(fine, rows, make, EDGE, HALO, 100_000)
    return fine.read().groupBy(F.floor(F.col("z") / EDGE).alias("slab"), "state", "code").agg(F.count(F.lit(1)).alias("n"))


RULES = {"dice": (0.55, 1.0), "share_a": (0.001, 0.2), "components_a": (1, 1e9), "largest_b": (3, 1e9), "thickness_a": (1.5, 3.0), "crest_b_near": (0.9, 1.0),
    "surface_b": (1, 1e9), "no_such_measure": (0, 1)}
NEAR, LEAST = 2, 3


def _mask_sql(c: str, o: str) -> str:
    return f"""s{c} AS (SELECT DISTINCT m.z, m.y, m.x FROM m{c} m JOIN r{c} r ON abs(r.z - m.z) + abs(r.y - m.y) + abs(r.x - m.x) = 1 AND {_near("m", "r", 1)}),
e{c} AS (SELECT p.id AS a, q.id AS b FROM m{c} p JOIN m{c} q ON {_near("p", "q", 1)}),
h{c} AS (SELECT id AS node, id AS other FROM m{c} UNION SELECT h.node, e.b FROM h{c} h JOIN e{c} e ON e.a = h.other),
k{c} AS (SELECT root, count(*) AS n FROM (SELECT node, min(other) AS root FROM h{c} GROUP BY node) GROUP BY root HAVING count(*) >= {LEAST}),
p{c} AS (SELECT m.z, m.y, m.x, sqrt(min({_d2("m", "r")})) AS depth FROM m{c} m JOIN r{c} r ON {_near("m", "r", 5)} GROUP BY 1, 2, 3),
c{c} AS (SELECT p.z, p.y, p.x, p.depth FROM p{c} p JOIN p{c} q ON {_near("p", "q", 1)} GROUP BY 1, 2, 3, 4 HAVING p.depth >= max(q.depth) - 0.5),
n{c} AS (SELECT count(DISTINCT (c.z, c.y, c.x)) AS n FROM c{c} c JOIN m{o} t ON {_near("c", "t", NEAR)} WHERE {_d2("c", "t")} <= {NEAR**2}),
f{c} AS (SELECT (SELECT count(*) FROM s{c}) AS surface_{c}, (SELECT count(*) FROM k{c}) AS components_{c}, coalesce((SELECT max(n) FROM k{c}),
  0) AS largest_{c},
  (SELECT median(2 * depth) FROM c{c}) AS thickness_{c}, (SELECT n FROM n{c}) / nullif((SELECT count(*) FROM c{c}), 0) AS crest_{c}_near)"""


def _audit_sql(edit: str) -> str:
    """``w``: one row of all measures."""
    split = ", ".join(f"m{c} AS (SELECT z, y, x, CAST(z AS BIGINT) * 1099511627776 + CAST(y AS BIGINT) * 1048576 + x AS id FROM ab WHERE {c}), "
        f"r{c} AS (SELECT z, y, x FROM ab WHERE NOT {c})" for c in "ab")
    return f"""ab AS (SELECT z, y, x, u > 225 AS a, (u > 230 OR u > 215 AND label % 3 = 0) AND NOT ({edit}) AS b FROM coded), {split}, {_mask_sql("a", "b")},
  {_mask_sql("b", "a")},
t AS (SELECT count(*) AS n, count(*) FILTER (WHERE a) AS na, count(*) FILTER (WHERE b) AS nb, count(*) FILTER (WHERE a AND b) AS nab FROM ab),
w AS (SELECT na / n AS share_a, nb / n AS share_b, 2 * nab / nullif(na + nb, 0) AS dice, nab / nullif(na + nb - nab, 0) AS iou, nab / nullif(na,
  0) AS a_inside_b,
  nab / nullif(nb, 0) AS b_inside_a, fa.*, fb.* FROM t, fa, fb)"""


def audited(spark: SparkSession, folder: str, edited: bool) -> DataFrame:
    rows = coded_voxels(spark, folder)
    gone = (F.col("label") % 4 == 1) if edited else F.lit(False)
    b = ((F.col("u") > 230) | ((F.col("u") > 215) & (F.col("label") % 3 == 0))) & ~gone
    return audit.measures(rows.select(*AXES, (F.col("u") > 225).alias("a"), b.alias("b")), NEAR, LEAST)


@register("store_audit", f"""WITH RECURSIVE {VOXELS_SQL}, {_audit_sql("false")}
SELECT measure, round(value, 9) AS value FROM (SELECT CAST(COLUMNS(*) AS DOUBLE) FROM w) UNPIVOT INCLUDE NULLS (value FOR measure IN (*))""")
def store_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Shares, overlaps, surfaces, components, thickness and distances of two masks of one volume, a row for each measure."""
    return audited(spark, folder, False).select("measure", F.round("value", 9).alias("value"))


@register("audit_verdict", f"""WITH RECURSIVE {VOXELS_SQL}, {_audit_sql("label % 4 = 1")},
m AS (SELECT measure, value FROM (SELECT CAST(COLUMNS(*) AS DOUBLE) FROM w) UNPIVOT INCLUDE NULLS (value FOR measure IN (*))),
r(rule, low, high) AS (VALUES {", ".join(f"('{k}', {low}::DOUBLE, {high}::DOUBLE)" for k, (low, high) in RULES.items())})
SELECT rule, round(value, 9) AS value, low, high, coalesce(value BETWEEN low AND high, false) AS passed FROM r LEFT JOIN m ON m.measure = r.rule""")
def audit_verdict(spark: SparkSession, folder: str) -> DataFrame:
    """The rules of an audit on a store of which some bricks were erased: which of them fail."""
    return audit.verdict(audited(spark, folder, True), RULES).withColumn("value", F.round("value", 9))


#: Boxes (low, size) of caches: the second one's copy is stopped, the others are complete.
BOXES = (((0, 0, 0), (16, 32, 32)), ((0, 0, 0), (8, 16, 32)), ((0, 0, 0), (8, 24, 32)))


@register("cached_reads", f"""WITH {VOXELS_SQL}, q AS (SELECT p_partkey AS request, p_size % 14 AS z, p_partkey % 25 AS y, p_partkey * 7 % 27 AS x,
  p_partkey % 5 AS level FROM part),
c AS (SELECT *, CASE WHEN level > 0 THEN NULL WHEN z + 3 <= 8 AND y + 7 <= 24 THEN 2 WHEN z + 3 <= 16 THEN 0 END AS cache FROM q)
SELECT CASE WHEN cache IS NULL THEN -1 ELSE cache END AS cache, count(DISTINCT request) AS requests, count(*) AS n, CAST(sum(u) AS BIGINT) AS total
FROM c JOIN coded d ON d.z >= c.z AND d.z < c.z + 3 AND d.y >= c.y AND d.y < c.y + 7 AND d.x >= c.x AND d.x < c.x + 5 GROUP BY 1""")
def cached_reads(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes that many requests ask for, each from the smallest complete cache that holds it; a copy that was stopped is missed, and so is another level."""
    rows = materialize(coded_voxels(spark, folder).select(*AXES, "u"), "cache-source")
    path = f"{scratch_root(spark)}/caches-{uuid.uuid4().hex}"
    caches = [cache.Cache(builds.BrickStore(spark, f"{path}/{i}", incremental.fingerprint("copy", str(i))), 0, box, EDGE) for i, box in enumerate(BOXES)]
    for i, c in enumerate(caches):
        cache.copy_box(c, rows, *((3, 1) if i == 1 else ()))
    key = F.col("p_partkey")
    asked = table(spark, folder, "part").select(key.alias("request"), (key % 5).cast("int").alias("level"), (F.col("p_size") % 14).cast("int").alias("low_z"),
        (key % 25).cast("int").alias("low_y"), (key * 7 % 27).cast("int").alias("low_x"), *[F.lit(n).alias(f"size_{a}") for a, n in zip(AXES, (3, 7, 5),
            strict=True)])
    read = cache.read_through(caches, asked, rows, EDGE)
    return read.groupBy(F.coalesce("cache", F.lit(-1)).alias("cache")).agg(F.countDistinct("request").alias("requests"), F.count(F.lit(1)).alias("n"),
        F.sum("u").alias("total"))


@register("compressed_array_read", f"""WITH {VOXELS_SQL} SELECT z, count(*) AS n, CAST(sum(u) AS BIGINT) AS total, CAST(sum(u * (x + 1)) AS BIGINT) AS moment
  FROM coded
  WHERE y BETWEEN 3 AND 28 AND x BETWEEN 2 AND 30 AND z < (SELECT max(vec_id) // 64 * 4 FROM embeddings) GROUP BY z""")
def compressed_array_read(spark: SparkSession, folder: str) -> DataFrame:
    """Whole layers written as chunk files packed by zlib, and a box of them read back."""
    last = (table(spark, folder, "embeddings").agg(F.max("vec_id").alias("v")).first()["v"] or 0) // 64 * 4
    packed = chunks.pack(coded_voxels(spark, folder).where(F.col("z") < last).withColumns({"store": F.lit("s"), "channel": F.lit("u")}), 16)
    path = f"{scratch_root(spark)}/packed-{uuid.uuid4().hex}"
    chunks.write_array(packed, path, (last, 32, 32), 16, "zlib", 6)
    found = chunks.read_array(spark, path, (0, 3, 2), (last, 26, 29))
    return found.groupBy("z").agg(F.count(F.lit(1)).alias("n"), F.sum("u").alias("total"), F.sum(F.col("u") * (F.col("x") + 1)).alias("moment"))
