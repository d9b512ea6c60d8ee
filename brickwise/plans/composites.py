"""Queries on distances without a limit, closings, crests, tiles, rotations, and labels built from several of these."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickwise.functions import codec, vectors
from brickwise.operators import grid, joins, morphology, stencil
from brickwise.plans.catalog import register
from brickwise.runtime import materialize
from brickwise.sources.tables import table
from brickwise.sources.voxels import VOXELS_SQL, coded_voxels, voxels

AXES = list(grid.AXES)


def _layers(spark: SparkSession, folder: str) -> int:
    return (voxels(spark, folder).agg(F.max("z").alias("z")).first()["z"] or 0) + 1


def _near_sql(a: str, b: str, r: int) -> str:
    return f"{b}.z BETWEEN {a}.z - {r} AND {a}.z + {r} AND {b}.y BETWEEN {a}.y - {r} AND {a}.y + {r} AND {b}.x BETWEEN {a}.x - {r} AND {a}.x + {r}"


def _d2_sql(a: str, b: str) -> str:
    return f"(({a}.z - {b}.z)**2 + ({a}.y - {b}.y)**2 + ({a}.x - {b}.x)**2)"


@register("distance_unlimited", f"""WITH {VOXELS_SQL}, t AS (SELECT z, y, x FROM coded WHERE u > 254 AND (x + y + z) % 5 = 0)
SELECT CAST(d2 AS BIGINT) AS d2, count(*) AS n FROM (SELECT a.z, a.y, a.x, min({_d2_sql("a", "t")}) AS d2 FROM coded a, t GROUP BY 1, 2, 3) GROUP BY 1""")
def distance_unlimited(spark: SparkSession, folder: str) -> DataFrame:
    """How many voxels are how far from the nearest of some scattered ones, whatever the distance."""
    rows = coded_voxels(spark, folder).select(*AXES, "u")
    targets = rows.where("u > 254").where((F.col("x") + F.col("y") + F.col("z")) % 5 == 0)
    return morphology.squared_distance(rows, targets).groupBy("d2").agg(F.count(F.lit(1)).alias("n"))


@register("close_ball", f"""WITH {VOXELS_SQL}, m AS (SELECT z, y, x FROM coded WHERE u > 200), g AS (SELECT DISTINCT c.z, c.y, c.x FROM coded c JOIN m
  ON {_near_sql("c", "m", 1)} AND {_d2_sql("c", "m")} <= 2.25),
o AS (SELECT z, y, x FROM coded EXCEPT SELECT * FROM g), k AS (SELECT c.z, c.y, c.x FROM coded c WHERE NOT EXISTS (SELECT 1 FROM o
  WHERE {_near_sql("c", "o", 1)} AND {_d2_sql("c", "o")} <= 2.25))
SELECT z, count(*) AS n FROM k GROUP BY z""")
def close_ball(spark: SparkSession, folder: str) -> DataFrame:
    """A mask closed by a ball of one and a half voxels, by layer."""
    rows = coded_voxels(spark, folder).select(*AXES, "u")
    return morphology.close_ball(rows, rows.where("u > 200"), 1.5).groupBy("z").agg(F.count(F.lit(1)).alias("n"))


def _crest_sql(mask: str) -> str:
    """The crest of a mask of ``coded``, depths beyond four voxels not told apart (the masks here aren't that deep)."""
    return f"""k AS (SELECT z, y, x FROM coded WHERE {mask}), r AS (SELECT z, y, x FROM coded WHERE NOT ({mask})),
deep AS (SELECT k.z, k.y, k.x, sqrt(min({_d2_sql("k", "r")})) AS depth FROM k JOIN r ON {_near_sql("k", "r", 4)} GROUP BY 1, 2, 3),
crest AS (SELECT a.z, a.y, a.x FROM deep a JOIN deep b ON {_near_sql("a", "b", 1)} GROUP BY a.z, a.y, a.x, a.depth HAVING a.depth >= max(b.depth) - 0.5)"""


@register("thin_band", f"""WITH {VOXELS_SQL}, {_crest_sql("u > 120")} SELECT z, count(*) AS n FROM crest GROUP BY z""")
def thin_band(spark: SparkSession, folder: str) -> DataFrame:
    """A thick band thinned to the places that are deepest around, by layer."""
    rows = coded_voxels(spark, folder).select(*AXES, "u")
    return morphology.crest(rows, rows.where("u > 120")).groupBy("z").agg(F.count(F.lit(1)).alias("n"))


@register("gap_borders", f"""WITH {VOXELS_SQL}, b AS (SELECT z, y, x FROM coded WHERE u > 170), g AS (SELECT DISTINCT c.z, c.y, c.x FROM coded c JOIN b
  ON {_near_sql("c", "b", 1)}), o AS (SELECT z, y, x FROM coded EXCEPT SELECT * FROM g),
gap AS (SELECT z, y, x FROM coded c WHERE u <= 170 AND valid = 1 AND EXISTS (SELECT 1 FROM g WHERE g.z = c.z AND g.y = c.y AND g.x = c.x)
  AND NOT EXISTS (SELECT 1 FROM o WHERE {_near_sql("c", "o", 1)})),
w AS (SELECT DISTINCT c.z, c.y, c.x FROM coded c JOIN gap ON {_near_sql("c", "gap", 1)} WHERE c.u <= 170 AND c.valid = 1), e AS (SELECT DISTINCT w.z, w.y, w.x
  FROM w JOIN b ON {_near_sql("w", "b", 2)})
SELECT (SELECT count(*) FROM gap) AS n_gap, (SELECT count(*) FROM w) AS n_wide, (SELECT count(*) FROM e) AS n_border""")
def gap_borders(spark: SparkSession, folder: str) -> DataFrame:
    """Thin gaps between bodies where supervised, the same widened by a voxel, and what of that is within two voxels of a body."""
    rows = coded_voxels(spark, folder).select(*AXES, "u", "valid")
    body = rows.where("u > 170").select(*AXES)
    air = rows.where("u <= 170 and valid = 1").select(*AXES)
    gap = materialize(stencil.close(body, 1, rows).join(air, AXES, "left_semi"), "gap")
    wide = materialize(stencil.dilate(gap, 1, air), "wide-gap")
    border = stencil.dilate(body, 2, wide)
    count = lambda part, name: part.agg(F.count(F.lit(1)).alias(name))
    return count(gap, "n_gap").crossJoin(count(wide, "n_wide")).crossJoin(count(border, "n_border"))  # one row each


@register("sheet_period", f"""WITH {VOXELS_SQL}, d AS (SELECT z, y, x, u - 128 AS d FROM coded), t AS (SELECT * FROM d WHERE d > 60), g AS (SELECT z, y, x,
  -d AS d FROM d WHERE d < -60),
ft AS (SELECT c.z, c.y, c.x, first(t.d ORDER BY {_d2_sql("c", "t")}, t.z, t.y, t.x) AS v FROM coded c JOIN t ON {_near_sql("c", "t", 2)}
  AND {_d2_sql("c", "t")} <= 4 GROUP BY 1, 2, 3),
fg AS (SELECT c.z, c.y, c.x, first(g.d ORDER BY {_d2_sql("c", "g")}, g.z, g.y, g.x) AS v FROM coded c JOIN g ON {_near_sql("c", "g", 2)}
  AND {_d2_sql("c", "g")} <= 4 GROUP BY 1, 2, 3)
SELECT ft.z, count(*) AS n, CAST(sum(ft.v) AS BIGINT) AS thickness, CAST(sum(fg.v) AS BIGINT) AS gap FROM ft JOIN fg USING (z, y, x) GROUP BY ft.z""")
def sheet_period(spark: SparkSession, folder: str) -> DataFrame:
    """Thickness of sheets and of the gaps between them, each from its nearest measurement within two voxels."""
    rows = coded_voxels(spark, folder).select(*AXES, (F.col("u") - 128).alias("d"))
    thick = joins.nearest(rows, rows.where("d > 60"), 2, [], ["d"]).where("d2 is not null").select(*AXES, F.col("near_d").alias("t"))
    thin = joins.nearest(rows, rows.where("d < -60").withColumn("d", -F.col("d")), 2, [], ["d"]).where("d2 is not null").select(*AXES,
        F.col("near_d").alias("g"))
    return thick.join(thin, AXES).groupBy("z").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("thickness"), F.sum("g").alias("gap"))


@register("window_maxima", f"""WITH {VOXELS_SQL}, s(start) AS (VALUES (0), (5), (10), (15), (20)) SELECT z, CAST(start AS INT) AS start, max(u) AS top
  FROM coded, s WHERE x >= start AND x < start + 12 GROUP BY z, start""")
def window_maxima(spark: SparkSession, folder: str) -> DataFrame:
    """The largest code of each layer in evenly spaced windows along x: windows without signal can be left out."""
    starts = F.explode(F.array(*map(F.lit, grid.even_window_starts(32, 12, 6))))
    return coded_voxels(spark, folder).withColumn("start", starts).where("x >= start and x < start + 12").groupBy("z", "start").agg(F.max("u").alias("top"))


@register("best_window_start", f"""WITH {VOXELS_SQL}, c AS (SELECT z // 4 AS slab, y // 4 AS cy, x // 4 AS cx, count(*) FILTER (WHERE u > 140) AS n FROM coded
  GROUP BY 1, 2, 3),
w AS (SELECT a.slab, a.cy, a.cx, sum(b.n) AS total FROM c a JOIN c b ON b.slab = a.slab AND b.cy BETWEEN a.cy AND a.cy + 2 AND b.cx BETWEEN a.cx AND a.cx + 2
  WHERE a.cy <= 5 AND a.cx <= 5 GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY slab ORDER BY total DESC, abs(cy - 2) + abs(cx - 2), cy, cx) AS r FROM w WHERE abs(cy - 2) <= 2
  AND abs(cx - 2) <= 2)
SELECT slab, CAST(cy * 4 AS INT) AS y, CAST(cx * 4 AS INT) AS x, CAST(total AS BIGINT) AS total FROM r WHERE r = 1""")
def best_window_start(spark: SparkSession, folder: str) -> DataFrame:
    """For each slab the window of three cells that covers most, not too far from the middle; of equals the nearest to it."""
    cells = coded_voxels(spark, folder).groupBy(F.floor(F.col("z") / 4).cast("int").alias("slab"), F.floor(F.col("y") / 4).cast("int").alias("cy"),
        F.floor(F.col("x") / 4).cast("int").alias("cx"))
    counts = cells.agg(F.count(F.when(F.col("u") > 140, 1)).alias("n"))
    reach = lambda c: F.explode(F.sequence(F.greatest(F.lit(0), F.col(c) - 2), F.least(F.lit(5), F.col(c))))
    windows = counts.withColumn("wy", reach("cy")).withColumn("wx", reach("cx")).groupBy("slab", "wy", "wx").agg(F.sum("n").alias("total"))
    near = windows.where((F.abs(F.col("wy") - 2) <= 2) & (F.abs(F.col("wx") - 2) <= 2))
    off = F.abs(F.col("wy") - 2) + F.abs(F.col("wx") - 2)
    best = near.groupBy("slab").agg(F.min(F.struct((-F.col("total")).alias("less"), off.alias("off"), "wy", "wx")).alias("b"))
    return best.select("slab", (F.col("b.wy") * 4).alias("y"), (F.col("b.wx") * 4).alias("x"), (-F.col("b.less")).alias("total"))


def _edges_sql(axis: str, size: str) -> str:
    n = f"ceil({size} / 12.0)"
    return f"e{axis} AS (SELECT CAST(i AS INT) AS i{axis}, CAST(round_even(i * {size} / {n}, 0) AS INT) AS lo, CAST(round_even((i + 1) * {size} / {n}, 0) AS INT) AS hi FROM range(1000000) r(i) WHERE i < {n})"


@register("tile_plan", f"""WITH {VOXELS_SQL}, ext AS (SELECT max(z) + 1 AS nz FROM coded), {_edges_sql("z", "(SELECT nz FROM ext)")}, {_edges_sql("y", "32")},
  {_edges_sql("x", "32")}
SELECT iz, iy, ix, count(*) AS n, min(ez.lo) AS core_z, min(ez.hi - ez.lo) AS core_n, min(ez.lo - 3 - CASE
  WHEN ez.hi - ez.lo + 6 < 20 THEN (20 - (ez.hi - ez.lo + 6)) // 2 ELSE 0 END) AS box_z, min(greatest(20, ez.hi - ez.lo + 6)) AS box_n
FROM coded JOIN ez ON z >= ez.lo AND z < ez.hi JOIN ey ON y >= ey.lo AND y < ey.hi JOIN ex ON x >= ex.lo AND x < ex.hi GROUP BY iz, iy, ix""")
def tile_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Nearly equal tiles of twelve voxels at most: their voxels, and along z the core and the box with a halo of three, widened to a patch of twenty."""
    rows = coded_voxels(spark, folder).select(*AXES)
    found = {a: grid.even_tile(F.col(a), n, 12) for a, n in zip(AXES, (_layers(spark, folder), 32, 32), strict=True)}
    keyed = rows.withColumns({**{f"i{a}": t[0] for a, t in found.items()}, "low": found["z"][1], "high": found["z"][2]})
    tiles = keyed.groupBy("iz", "iy", "ix").agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("low"), F.min("high").alias("high"))
    core = F.col("high") - F.col("low")
    extra = F.greatest(F.lit(0), 20 - (core + 6))
    return tiles.select("iz", "iy", "ix", "n", F.col("low").alias("core_z"), core.alias("core_n"),
        (F.col("low") - 3 - F.floor(extra / 2).cast("int")).alias("box_z"),
        F.greatest(F.lit(20), core + 6).alias("box_n"))


@register("field_tiles", f"""WITH {VOXELS_SQL}, n AS (SELECT max(z) + 1 AS nz, ceil((max(z) + 1) / 8.0) AS kz FROM coded), e AS (SELECT i,
  round_even(i * nz / kz, 0) AS low,
  round_even((i + 1) * nz / kz, 0) AS high FROM n, range(10000) r(i) WHERE i < kz)
SELECT CAST(i AS INT) AS iz, CAST(y // 8 AS INT) AS iy, CAST(x // 8 AS INT) AS ix, count(*) AS n, CAST(sum(u) AS BIGINT) AS total
FROM coded JOIN e ON z >= low AND z < high GROUP BY 1, 2, 3""")
def field_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """Voxels by the tiles of windows of twelve whose model sees two voxels around, as large as 12 KB of sums for two channels allow."""
    layers = _layers(spark, folder)
    halo, step = grid.field_tiling(12, 1, 1)
    tile = grid.fitted_tile((layers, 32, 32), 2 * step, halo, 12, 2, 12_000, 4, 4)
    rows = coded_voxels(spark, folder).withColumns({f"i{a}": grid.even_tile(F.col(a), n, tile)[0] for a, n in zip(AXES, (layers, 32, 32), strict=True)})
    return rows.groupBy("iz", "iy", "ix").agg(F.count(F.lit(1)).alias("n"), F.sum("u").alias("total"))


#: An affine map of places in z, y, x order.
_MAP = [[0.5, 0.1, 0.0, 2.0], [0.0, 0.8, -0.3, 5.0], [0.2, 0.0, 0.9, -1.0]]


@register("mapped_box_bounds", f"""WITH o AS (SELECT p_partkey, p_partkey % 40 AS z, p_size AS y, p_partkey % 17 AS x FROM part), b AS (SELECT i.i AS bz,
  j.i AS by_, k.i AS bx FROM range(2) i(i), range(2) j(i), range(2) k(i)),
c AS (SELECT p_partkey, {", ".join(f"{r[0]} * (z + 7 * bz) + {r[1]} * (y + 5 * by_) + {r[2]} * (x + 3 * bx) + {r[3]} AS m{a}" for r, a in zip(_MAP, AXES, strict=True))} FROM o, b)
SELECT p_partkey, {", ".join(f"CAST(greatest(0, least(30, floor(round(min(m{a})::DOUBLE, 9)) - 1)) AS INT) AS lo_{a}, CAST(greatest(0, least(30, ceil(round(max(m{a})::DOUBLE, 9)) + 2)) AS INT) AS hi_{a}" for a in AXES)} FROM c GROUP BY p_partkey""")
def mapped_box_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """The bounds, with a margin of one and clipped to thirty voxels, of boxes of 8 x 6 x 4 under an affine map."""
    boxes = table(spark, folder, "part").select("p_partkey", (F.col("p_partkey") % 40).alias("z"), F.col("p_size").alias("y"),
        (F.col("p_partkey") % 17).alias("x"))
    corners = F.array(*[F.struct(*[(F.col(a) + b).cast("double").alias(a) for a, b in zip(AXES, bits, strict=True)]) for bits in [(7 * (i >> 2 & 1),
        5 * (i >> 1 & 1), 3 * (i & 1)) for i in range(8)]])
    spread = boxes.select("p_partkey", F.explode(corners).alias("c"))
    mapped = vectors.affine(_MAP, tuple(F.col(f"c.{a}") for a in AXES))
    ends = spread.select("p_partkey", *[m.alias(f"m{a}") for m, a in zip(mapped, AXES,
        strict=True)]).groupBy("p_partkey").agg(*[f(f"m{a}").alias(f"{n}{a}") for a in AXES for f, n in ((F.min, "l"), (F.max, "h"))])
    held = lambda c: F.greatest(F.lit(0), F.least(F.lit(30), c)).cast("int")
    bounds = [b for a in AXES for b in (held(F.floor(F.round(f"l{a}", 9)) - 1).alias(f"lo_{a}"), held(F.ceil(F.round(f"h{a}", 9)) + 2).alias(f"hi_{a}"))]
    return ends.select("p_partkey", *bounds)


_COS, _SIN = math.cos(math.radians(30)), math.sin(math.radians(30))


@register("rotated_layers", f"""WITH {VOXELS_SQL}, p AS (SELECT z, y AS gy, x AS gx,
  15.5 + {_COS!r}::DOUBLE * (y - 15.5) + {_SIN!r}::DOUBLE * (x - 15.5) AS py, 15.5 - {_SIN!r}::DOUBLE * (y - 15.5) + {_COS!r}::DOUBLE * (x - 15.5) AS px
  FROM coded), o(n) AS (VALUES (0), (1)),
w AS (SELECT z, gy, gx, CAST(floor(py) AS INT) + b.n AS y, CAST(floor(px) AS INT) + c.n AS x, (CASE b.n WHEN 1 THEN py - floor(py)
  ELSE 1 - (py - floor(py)) END) * (CASE c.n WHEN 1 THEN px - floor(px) ELSE 1 - (px - floor(px)) END) AS w FROM p, o b, o c),
s AS (SELECT w.z, gy, gx, sum(w * coalesce(v, 0)) AS v, sum(CASE WHEN v IS NULL THEN 0 ELSE w END) AS part FROM w LEFT JOIN coded USING (z, y, x) GROUP BY 1,
  2, 3)
SELECT z, round(sum(v), 4) AS total, count(*) FILTER (WHERE part > 0.999) AS n_whole FROM s GROUP BY z""")
def rotated_layers(spark: SparkSession, folder: str) -> DataFrame:
    """Layers turned by thirty degrees about their middle, sampled between voxels with zero outside; and how many samples lie wholly inside."""
    rows = coded_voxels(spark, folder).select(*AXES, "v").withColumn("one", F.lit(1.0))
    dy, dx = F.col("y") - 15.5, F.col("x") - 15.5
    points = rows.select(F.struct(*AXES).alias("id"), F.col("z").cast("double").alias("pz"), (15.5 + _COS * dy + _SIN * dx).alias("py"),
        (15.5 - _SIN * dy + _COS * dx).alias("px"))
    value, part = joins.trilinear(points, rows, "v"), joins.trilinear(points, rows, "one")
    both = value.join(part, "id")
    return both.groupBy(F.col("id.z").alias("z")).agg(F.round(F.sum("v"), 4).alias("total"), F.count(F.when(F.col("one") > 0.999, 1)).alias("n_whole"))


@register("fine_labels", f"""WITH {VOXELS_SQL},
  {_crest_sql("u >= 190")}, n AS (SELECT c.z, c.y, c.x, c.u, c.valid,
  min({{'d2': CAST({_d2_sql("c", "crest")} AS BIGINT), 'z': crest.z, 'y': crest.y, 'x': crest.x}}) FILTER (WHERE {_d2_sql("c", "crest")} <= 9) AS m
  FROM coded c LEFT JOIN crest ON {_near_sql("c", "crest", 3)} GROUP BY 1, 2, 3, 4, 5),
s AS (SELECT *, coalesce(sqrt(m.d2), 3) AS dist, CASE WHEN (y - m.y) * (m.y - 15.5) + (x - m.x) * (m.x - 15.5) < 0 THEN -1.0::DOUBLE
  ELSE 1.0::DOUBLE END AS side FROM n)
SELECT CASE WHEN valid = 0 THEN 0 WHEN u BETWEEN 150 AND 180 AND dist > 1 THEN 2 ELSE 1 END AS state, CASE WHEN valid = 0 THEN 0 ELSE CAST(least(255.0,
  greatest(1.0, round_even(128 + side * dist * (127.0::DOUBLE / 3.0::DOUBLE), 0))) AS INT) END AS code, count(*) AS n FROM s GROUP BY 1, 2""")
def fine_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of a surface from its probability: the crest of the mask, the signed distance to it (positive away from the middle of the layers,
    saturating at three voxels) as bytes, and the three-valued validity, which ignores doubtful places off the crest. Written for later readers."""
    rows = coded_voxels(spark, folder).select(*AXES, "u", "valid")
    ridge = materialize(morphology.crest(rows, rows.where("u >= 190")), "crest")
    place = F.struct(*[F.col(a).alias(f"m{a}") for a in AXES])
    near = joins.nearest(rows, ridge.withColumn("at", place), 3, ["u", "valid"], ["at"])
    out = (F.col("y") - F.col("near_at.my")) * (F.col("near_at.my") - 15.5) + (F.col("x") - F.col("near_at.mx")) * (F.col("near_at.mx") - 15.5)
    dist = F.coalesce(F.sqrt("d2"), F.lit(3.0))
    signed = F.when(out < 0, -dist).otherwise(dist)
    state = F.when(F.col("valid") == 0, 0).when(F.col("u").between(150, 180) & (dist > 1), 2).otherwise(1)
    code = F.when(F.col("valid") == 0, 0).otherwise(codec.encode_sdf(signed, 3.0))
    built = materialize(near.select(*AXES, state.alias("state"), code.alias("code")), "fine-labels")
    return built.groupBy("state", "code").agg(F.count(F.lit(1)).alias("n"))


@register("fibre_block", f"""WITH {VOXELS_SQL} SELECT label, CAST(sum(CAST(round_even(255 * abs(sin(u)), 0) AS INT)) AS BIGINT) AS along,
  CAST(sum(CAST(round_even(255 * abs(cos(u)), 0) AS INT)) AS BIGINT) AS across, count(*) FILTER (WHERE valid > 0) AS n_valid FROM coded GROUP BY label""")
def fibre_block(spark: SparkSession, folder: str) -> DataFrame:
    """The channels of a fibre block: both class probabilities as bytes, and where there is data."""
    byte = lambda c: F.sum(codec.encode_prob(F.abs(c)))
    return coded_voxels(spark, folder).groupBy("label").agg(byte(F.sin("u")).alias("along"), byte(F.cos("u")).alias("across"),
        F.count(F.when(F.col("valid") > 0, 1)).alias("n_valid"))
