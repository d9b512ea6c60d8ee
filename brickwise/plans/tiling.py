"""Queries on cores and windows, tokens, gates, deterministic samples, hand edits, appended channels and chunk files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickwise.functions import codec, vectors
from brickwise.operators import embeddings, grid, losses, sampling, stencil
from brickwise.operators.components import connected_components
from brickwise.operators.prefix import running_sums
from brickwise.plans.catalog import register
from brickwise.plans.encoding import _TRIPLES_SQL, triples
from brickwise.runtime import materialize, scratch_root
from brickwise.sources import chunks
from brickwise.sources.tables import table
from brickwise.sources.voxels import EDGE, GRID, VOXELS_SQL, coded_voxels, voxels
from brickwise.streaming import builds, incremental

AXES = list(grid.AXES)


@register("core_partition", f"""WITH {VOXELS_SQL}, c(start, lo, hi) AS (VALUES (0, 0, 9), (6, 9, 15), (12, 15, 21), (18, 21, 27), (20, 27, 32))
SELECT CAST(start AS INT) AS start, count(*) AS n_window, count(*) FILTER (WHERE x >= lo AND x < hi) AS n_core, CAST(sum(u) FILTER (WHERE x >= lo
  AND x < hi) AS BIGINT) AS total FROM coded, c WHERE x >= start AND x < start + 12 GROUP BY start""")
def core_partition(spark: SparkSession, folder: str) -> DataFrame:
    """Voxels of windows along x whose cores partition the extent, and of the cores."""
    cores = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(c._fields, c, strict=True)]) for c in grid.partition_by_cores(32, 12, 3)]))
    rows = coded_voxels(spark, folder).withColumn("c", cores).where("x >= c.start and x < c.start + 12")
    core = F.expr("x >= c.low and x < c.high")
    return rows.groupBy(F.col("c.start").alias("start")).agg(F.count(F.lit(1)).alias("n_window"), F.count(F.when(core, 1)).alias("n_core"), F.sum(F.when(core,
        F.col("u"))).alias("total"))


@register("core_coverage", f"""WITH {VOXELS_SQL}, w AS (SELECT z, y, x, sum(CASE WHEN x - s >= 2 AND x - s < 10 THEN 1 ELSE 0 END) AS n FROM coded,
  (VALUES (0), (7), (13), (20)) s(s) WHERE x >= s AND x < s + 12 GROUP BY 1, 2, 3)
SELECT x, count(*) AS n_voxels, CAST(max(n) AS BIGINT) AS most, count(*) FILTER (WHERE n = 0) AS n_uncovered FROM w GROUP BY x""")
def core_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """How many windows hold each place in their core, two voxels from their ends, and the places that none does."""
    starts = F.explode(F.array(*map(F.lit, grid.even_window_starts(32, 12, 7))))
    rows = coded_voxels(spark, folder).select(*AXES).withColumn("s", starts).where("x >= s and x < s + 12")
    inner = (F.col("x") - F.col("s")).between(2, 9).cast("int")
    n = rows.groupBy(*AXES).agg(F.sum(inner).alias("n"))
    return n.groupBy("x").agg(F.count(F.lit(1)).alias("n_voxels"), F.max("n").alias("most"), F.count(F.when(F.col("n") == 0, 1)).alias("n_uncovered"))


@register("gaussian_blend", f"""WITH {VOXELS_SQL}, w AS (SELECT z, y, x, v + 0.01::DOUBLE * s AS out,
  greatest(exp(-0.5::DOUBLE * ((x - s - 5.5::DOUBLE) / 1.5::DOUBLE)**2), 1e-3::DOUBLE) AS w FROM vox, (VALUES (0), (5), (10), (15), (20)) s(s) WHERE x >= s
  AND x < s + 12),
b AS (SELECT z, y, x, sum(w * out) / sum(w) AS out FROM w GROUP BY 1, 2, 3) SELECT z, round(sum(out), 4) AS total, round(max(out), 5) AS top FROM b
  GROUP BY z""")
def gaussian_blend(spark: SparkSession, folder: str) -> DataFrame:
    """Window results, here the value and a hundredth of the window's start, blended by gaussian weights."""
    starts = F.explode(F.array(*map(F.lit, grid.even_window_starts(32, 12, 6))))
    rows = voxels(spark, folder).select(*AXES, "v").withColumn("s", starts).where("x >= s and x < s + 12")
    w = grid.gaussian_weight(F.col("x") - F.col("s"), 12)
    scored = rows.withColumns({"w": w, "out": F.col("v") + 0.01 * F.col("s")})
    blended = scored.groupBy(*AXES).agg((F.sum(F.col("w") * F.col("out")) / F.sum("w")).alias("out"))
    return blended.groupBy("z").agg(F.round(F.sum("out"), 4).alias("total"), F.round(F.max("out"), 5).alias("top"))


@register("token_blend", """WITH e AS (SELECT vec_id, vec_id // 8 AS line, vec_id % 8 AS place, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding,
  1) AS i, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM embeddings),
w AS (SELECT line, s, place, i, v / norm * (1 + 0.1::DOUBLE * s) AS t, least(least(place - s + 1, 4 - (place - s)) / 3.0::DOUBLE, 1.0::DOUBLE) AS w FROM e,
  (VALUES (0), (2), (4)) s(s) WHERE place >= s AND place < s + 4),
b AS (SELECT line, place, i, sum(w * t) / sum(w) AS t FROM w GROUP BY 1, 2, 3), n AS (SELECT line, place, sqrt(sum(t * t)) AS norm, sum(t) AS total FROM b
  GROUP BY 1, 2)
SELECT CAST(place AS BIGINT) AS place, count(*) AS n, round(avg(norm), 5) AS mean_norm, round(sum(total / norm), 4) AS total FROM n GROUP BY place""")
def token_blend(spark: SparkSession, folder: str) -> DataFrame:
    """Unit tokens of overlapping windows of four places along each line of eight, blended by ramps and made unit again."""
    rows = table(spark, folder, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("line"), (F.col("vec_id") % 8).alias("place"),
        embeddings.unit("embedding").alias("t"))
    spread = rows.withColumn("s", F.explode(F.array(F.lit(0), F.lit(2), F.lit(4)))).where("place >= s and place < s + 4")
    weight = grid.ramp_weight(F.col("place") - F.col("s"), 4, 2)
    parts = spread.select("line", "place", weight.alias("w"), (1 + 0.1 * F.col("s")).alias("k"), F.posexplode("t").alias("i", "v"))
    blended = parts.groupBy("line", "place", "i").agg((F.sum(F.col("w") * F.col("v") * F.col("k")) / F.sum("w")).alias("t"))
    tokens = blended.groupBy("line", "place").agg(F.sqrt(F.sum(F.col("t") * F.col("t"))).alias("norm"), F.sum("t").alias("total"))
    return tokens.groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("norm"), 5).alias("mean_norm"),
        F.round(F.sum(F.col("total") / F.col("norm")), 4).alias("total"))


@register("feature_losses", """WITH p AS (SELECT a.label, a.embedding AS s, b.embedding AS t FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
d AS (SELECT label, list_sum(list_transform(list_zip(s, t), lambda q: q[1]::DOUBLE * q[2]::DOUBLE)) AS st, list_sum(list_transform(s,
  lambda x: x::DOUBLE * x::DOUBLE)) AS ss, list_sum(list_transform(t, lambda x: x::DOUBLE * x::DOUBLE)) AS tt, len(s) AS n FROM p)
SELECT label, round(avg(1 - st / greatest(sqrt(ss) * sqrt(tt), 1e-6::DOUBLE)), 5) AS cosine_loss, round(avg((ss - 2 * st + tt) / n), 5) AS squared_loss FROM d
  GROUP BY label""")
def feature_losses(spark: SparkSession, folder: str) -> DataFrame:
    """Cosine and squared distances between each feature and the one that it should become."""
    rows = table(spark, folder, "embeddings").select("vec_id", "label", "embedding")
    target = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("target"))
    pair = rows.join(target, "vec_id").withColumns({"st": embeddings.dot("embedding", "target"), "ss": embeddings.dot("embedding", "embedding"),
        "tt": embeddings.dot("target", "target")})
    cosine = 1 - F.col("st") / F.greatest(F.sqrt("ss") * F.sqrt("tt"), F.lit(1e-6))
    squared = (F.col("ss") - 2 * F.col("st") + F.col("tt")) / F.size("embedding")
    return pair.groupBy("label").agg(F.round(F.avg(cosine), 5).alias("cosine_loss"), F.round(F.avg(squared), 5).alias("squared_loss"))


@register("axial_loss", f"""WITH {_TRIPLES_SQL}, u AS (SELECT label, (a * b + b * c + c * a) / (a*a + b*b + c*c) AS d, abs(a) AS w FROM tri) SELECT label,
  round(sum((1 - d * d) * w) / greatest(sum(w), 1), 5) AS loss FROM u GROUP BY label""")
def axial_loss(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted mean of 1 - cos^2 between lines and the lines they should be."""
    n = vectors.unit((F.col("a"), F.col("b"), F.col("c")))
    inner = vectors.dot(n, (n[1], n[2], n[0]))
    return triples(spark, folder).select("label", inner.alias("d"), F.abs("a").alias("w")).groupBy("label").agg(F.round(losses.axial(F.col("d"), F.col("w")),
        5).alias("loss"))


@register("prediction_bytes", f"""WITH {VOXELS_SQL}, p AS (SELECT label, CAST(round_even(255 * greatest(0.0::DOUBLE, least(1.0::DOUBLE,
  (128 + greatest(-20.0::DOUBLE, least(20.0::DOUBLE, v * 60)) * 127 / 20.0::DOUBLE) / 255)), 0) AS INT) AS sdf,
  CAST(round_even(255 * greatest(0.0::DOUBLE, least(1.0::DOUBLE, (sin(v * 9) + 1) * 0.5)), 0) AS INT) AS s, CAST(round_even(255 * greatest(0.0::DOUBLE,
  least(1.0::DOUBLE, abs(v) * 1000 / 255)), 0) AS INT) AS d, v FROM vox)
SELECT label, CAST(sum(sdf) AS BIGINT) AS sdf, CAST(sum(s) AS BIGINT) AS sine, CAST(sum(d) AS BIGINT) AS density, round(avg((sdf - 128) * 20 / 127.0::DOUBLE),
  5) AS back_sdf, round(avg((s - 127.5::DOUBLE) / 127.5::DOUBLE), 5) AS back_sine, round(avg(d / 1000.0::DOUBLE), 6) AS back_density, count(*)
  FILTER (WHERE sdf <> 0) AS n_data FROM p GROUP BY label""")
def prediction_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """Physical heads scaled to shares of a byte and stored, and read back as fields."""
    v = F.col("v")
    share = lambda c: F.rint(255 * codec.clip(c, 0.0, 1.0)).cast("int")
    stored = voxels(spark, folder).select("label", share((128 + codec.clip(v * 60, -20.0, 20.0) * 127 / 20.0) / 255).alias("sdf"),
        share((F.sin(v * 9) + 1) * 0.5).alias("s"), share(F.abs(v) * 1000 / 255).alias("d"))
    back = lambda c, n, k=5: F.round(F.avg(c), k).alias(n)
    return stored.groupBy("label").agg(
        F.sum("sdf").alias("sdf"), F.sum("s").alias("sine"), F.sum("d").alias("density"), back(codec.decode_sdf(F.col("sdf"), 20.0), "back_sdf"),
        back(codec.decode_signed(F.col("s")), "back_sine"), back(codec.decode_density(F.col("d")), "back_density", 6), F.count(F.when(F.col("sdf") != 0,
            1)).alias("n_data"),
    )


def _blurred_sql(source: str, axis: str, value: str) -> str:
    same = " AND ".join(f"b.{a} = a.{a}" for a in AXES if a != axis)
    return f"SELECT a.z, a.y, a.x, sum(exp(-0.5::DOUBLE * (b.{axis} - a.{axis})**2) * b.{value}) / sum(exp(-0.5::DOUBLE * (b.{axis} - a.{axis})**2)) AS s FROM {source} a JOIN {source} b ON {same} AND b.{axis} BETWEEN a.{axis} - 3 AND a.{axis} + 3 GROUP BY 1, 2, 3"


@register("gated_validity", f"""WITH {VOXELS_SQL}, sz AS ({_blurred_sql("coded", "z", "u")}), sy AS ({_blurred_sql("sz", "y", "s")}),
  sx AS ({_blurred_sql("sy", "x", "s")})
SELECT CASE WHEN v > 0 AND s < 125 AND valid > 0 THEN 2 ELSE valid END AS state, count(*) AS n, count(*) FILTER (WHERE valid = 1) AS n_supervised FROM sx
  JOIN coded USING (z, y, x) GROUP BY 1""")
def gated_validity(spark: SparkSession, folder: str) -> DataFrame:
    """Validity with bodies ignored where the smoothed intensity is dark."""
    rows = coded_voxels(spark, folder).select(*AXES, "v", "valid", F.col("u").cast("double").alias("u"))
    smooth = stencil.gaussian(rows, "u", 1.0, "smooth")
    state = F.when((F.col("v") > 0) & (F.col("smooth") < 125) & (F.col("valid") > 0), 2).otherwise(F.col("valid"))
    return smooth.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("valid") == 1, 1)).alias("n_supervised"))


@register("interior_crops", f"""WITH {VOXELS_SQL} SELECT label, count(*) AS n, CAST(sum(u) AS BIGINT) AS total FROM coded WHERE z % 4 BETWEEN 1 AND 2
  AND y % 4 BETWEEN 1 AND 2 AND x % 4 BETWEEN 1 AND 2 GROUP BY label""")
def interior_crops(spark: SparkSession, folder: str) -> DataFrame:
    """The voxels of each crop that don't lie on its border."""
    inner = grid._all(*[(F.col(a) % 4).between(1, 2) for a in AXES])
    return coded_voxels(spark, folder).where(inner).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("u").alias("total"))


@register("interior_block_sample", f"""WITH {VOXELS_SQL}, b AS (SELECT vec_id, avg(CASE WHEN u > 120 THEN 1.0::DOUBLE ELSE 0 END) AS share FROM coded
  GROUP BY vec_id), r AS (SELECT *, row_number() OVER (ORDER BY CAST(CAST('0x' || substr(md5(CAST(vec_id AS VARCHAR) || '|survey'), 1,
    13) AS UBIGINT) AS DOUBLE), vec_id) AS r FROM b WHERE share > 0.45)
SELECT vec_id, round(share, 5) AS share FROM r WHERE r <= 20""")
def interior_block_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Twenty blocks, by hash, of those that a coarse survey finds filled enough."""
    share = F.avg(F.when(F.col("u") > 120, 1.0).otherwise(0.0))
    filled = coded_voxels(spark, folder).groupBy("vec_id").agg(share.alias("share")).where("share > 0.45")
    return sampling.bottom_k(filled, 20, ["vec_id"], salt="survey").select("vec_id", F.round("share", 5).alias("share"))


@register("evenly_spaced_rows", """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders),
  p AS (SELECT DISTINCT CAST(round_even(k.i * ((SELECT count(*) FROM orders) - 1) / 24.0::DOUBLE, 0) AS BIGINT) AS i FROM range(25) k(i))
SELECT o_orderkey, i AS place FROM r JOIN p USING (i)""")
def evenly_spaced_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Twenty-five rows at evenly spaced, rounded places of the order; the places come from running sums over ranges."""
    rows = table(spark, folder, "orders").select("o_orderkey", F.lit(1).cast("long").alias("one"))
    total = rows.count()
    places = sorted({round(i * (total - 1) / 24) for i in range(25)})
    return running_sums(rows, ["o_orderkey"], {"one": "place"}, "row-places").where(F.col("place").isin(places)).select("o_orderkey", "place")


_FRAME = [[1.2, 0.0, 0.1, 3.0], [0.0, 0.9, 0.0, -2.0], [-0.2, 0.3, 1.0, 1.5]]


@register("level_affine", f"""WITH {VOXELS_SQL}, p AS (SELECT z, z * 4 + 1.5::DOUBLE AS lz, y * 4 + 1.5::DOUBLE AS ly, x * 4 + 1.5::DOUBLE AS lx FROM vox)
SELECT z, {", ".join(f"round(avg({r[0]}::DOUBLE * lz + {r[1]}::DOUBLE * ly + {r[2]}::DOUBLE * lx + {r[3]}::DOUBLE), 5) AS m{a}" for r, a in zip(_FRAME, AXES, strict=True))} FROM p GROUP BY z""")
def level_affine(spark: SparkSession, folder: str) -> DataFrame:
    """Centres of voxels of the second pyramid level in full resolution, under an affine map given in the reversed order of axes."""
    matrix = vectors.swap_axes([[*reversed(r[:3]), r[3]] for r in reversed(_FRAME)])
    centre = tuple(vectors.level_coordinate(F.col(a), 2) for a in AXES)
    mapped = vectors.affine(matrix, centre)
    return voxels(spark, folder).groupBy("z").agg(*[F.round(F.avg(m), 5).alias(f"m{a}") for m, a in zip(mapped, AXES, strict=True)])


@register("hand_edits", f"""WITH {VOXELS_SQL}, stroke AS (SELECT z, y, x, CASE label % 4 WHEN 0 THEN 'erase' WHEN 1 THEN 'ignore' WHEN 2 THEN 'inner'
  ELSE 'outer' END AS edit FROM coded WHERE u > 240),
near AS (SELECT DISTINCT c.z, c.y, c.x FROM coded c JOIN stroke s ON s.z BETWEEN c.z - 1 AND c.z + 1 AND s.y BETWEEN c.y - 1 AND c.y + 1
  AND s.x BETWEEN c.x - 1 AND c.x + 1),
e AS (SELECT c.*, s.edit, near.z IS NOT NULL AS touched FROM coded c LEFT JOIN stroke s USING (z, y, x) LEFT JOIN near USING (z, y, x))
SELECT coalesce(edit, CASE WHEN touched THEN 'near' ELSE 'kept' END) AS edit, CASE edit WHEN 'erase' THEN 0 WHEN 'ignore' THEN 2 ELSE valid END AS state,
  count(*) AS n, CAST(sum(CASE edit WHEN 'inner' THEN 140 WHEN 'outer' THEN 116 ELSE u END) AS BIGINT) AS total FROM e GROUP BY 1, 2""")
def hand_edits(spark: SparkSession, folder: str) -> DataFrame:
    """Strokes drawn by hand merged into labels: erased, ignored or set to a face where drawn; what is near a stroke is marked, the rest is kept."""
    rows = coded_voxels(spark, folder).select(*AXES, "u", "valid", "label")
    kind = F.when(F.col("label") % 4 == 0, "erase").when(F.col("label") % 4 == 1, "ignore").when(F.col("label") % 4 == 2, "inner").otherwise("outer")
    stroke = rows.where("u > 240").select(*AXES, kind.alias("edit"))
    near = stencil.dilate(stroke.select(*AXES), 1, rows).withColumn("touched", F.lit(True))
    merged = rows.join(stroke, AXES, "left").join(near, AXES, "left")
    state = F.when(F.col("edit") == "erase", 0).when(F.col("edit") == "ignore", 2).otherwise(F.col("valid"))
    code = F.when(F.col("edit") == "inner", 140).when(F.col("edit") == "outer", 116).otherwise(F.col("u"))
    name = F.coalesce("edit", F.when(F.col("touched"), "near").otherwise("kept"))
    return merged.groupBy(name.alias("edit"), state.alias("state")).agg(F.count(F.lit(1)).alias("n"), F.sum(code).alias("total"))


_OBJECTS_SQL = f"""WITH RECURSIVE {VOXELS_SQL}, m AS (SELECT z, y, x, CAST(z AS BIGINT) * 1099511627776 + CAST(y AS BIGINT) * 1048576 + x AS id,
  label = 3 AS contact FROM coded WHERE u > 205),
e AS (SELECT a.id AS a, b.id AS b FROM m a JOIN m b ON NOT a.contact AND NOT b.contact AND abs(a.z - b.z) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
reach AS (SELECT id AS node, id AS other FROM m WHERE NOT contact UNION SELECT r.node, e.b FROM reach r JOIN e ON e.a = r.other), comp AS (SELECT node AS id,
  min(other) AS object FROM reach GROUP BY node)"""


@register("objects_split_at_contacts", _OBJECTS_SQL + """, s AS (SELECT object, count(*) AS size FROM comp GROUP BY object)
SELECT count(*) AS n_objects, max(size) AS largest, CAST(sum(size) AS BIGINT) AS voxels, (SELECT count(*) FROM m WHERE contact) AS n_contact FROM s""")
def objects_split_at_contacts(spark: SparkSession, folder: str) -> DataFrame:
    """Components of a band once the contact places are taken out of it, and how many these are."""
    rows = coded_voxels(spark, folder).where("u > 205").select(*AXES, (F.col("label") == 3).alias("contact"))
    place = F.col("z").cast("long") * (1 << 40) + F.col("y").cast("long") * (1 << 20) + F.col("x")
    free = materialize(rows.where("not contact").withColumn("id", place), "free-places")
    half = [o for o in grid.cube(1) if o > (0, 0, 0)]
    edges = grid.around(free.select(*AXES, "id"), half, ("id",)).withColumnRenamed("id", "a").join(free.select(*AXES, F.col("id").alias("b")),
        AXES).select("a", "b")
    roots = connected_components(edges)
    objects = free.join(roots, free["id"] == roots["node"], "left").groupBy(F.coalesce("root", "id").alias("object")).agg(F.count(F.lit(1)).alias("size"))
    sizes = objects.agg(F.count(F.lit(1)).alias("n_objects"), F.max("size").alias("largest"), F.sum("size").alias("voxels"))
    return sizes.crossJoin(F.broadcast(rows.agg(F.count(F.when(F.col("contact"), 1)).alias("n_contact"))))  # one row each


@register("appended_channel", f"""WITH {VOXELS_SQL} SELECT CASE WHEN valid = 1 THEN 255 WHEN valid = 2 THEN 64 ELSE 0 END AS faces_weight, count(*) AS n,
  CAST(sum(u) AS BIGINT) AS total FROM coded GROUP BY 1""")
def appended_channel(spark: SparkSession, folder: str) -> DataFrame:
    """A store that gets one channel more: made from a channel that is there, stopped on the way and gone on with, and read back beside an old one."""
    rows = materialize(coded_voxels(spark, folder).select(*AXES, "u", "valid"), "channels-source")
    store = builds.ChannelStore(spark, f"{scratch_root(spark)}/channels-{uuid.uuid4().hex}", 8)
    old = {name: incremental.fingerprint(name) for name in ("u", "valid")}
    for name, identity in old.items():
        store.add(name, identity, rows, lambda part, name=name: part.select(*AXES, name))
    weight = F.when(F.col("valid") == 1, 255).when(F.col("valid") == 2, 64).otherwise(0)
    own = incremental.fingerprint("faces_weight", "v1")
    made = lambda part: part.select(*AXES, weight.alias("faces_weight"))
    store.add("faces_weight", own, store.read({"valid": old["valid"]}), made, 0, 20, 1)  # stopped after one small wave
    store.add("faces_weight", own, store.read({"valid": old["valid"]}), made)  # then finished, by few large waves however many bricks are left
    found = store.read({"u": old["u"], "faces_weight": own})
    return found.groupBy("faces_weight").agg(F.count(F.lit(1)).alias("n"), F.sum("u").alias("total"))


@register("packet_manifest", f"""WITH {VOXELS_SQL}, l AS (SELECT vec_id, 'ct' AS layer, count(*) AS n, CAST(sum(u) AS BIGINT) AS total FROM coded
  GROUP BY vec_id UNION ALL SELECT vec_id, 'state', count(*), CAST(sum(valid) AS BIGINT) FROM coded GROUP BY vec_id)
SELECT vec_id, string_agg(layer || ':' || CAST(n AS VARCHAR) || ':' || CAST(total AS VARCHAR), ';' ORDER BY layer) AS layers, count(*)
  FILTER (WHERE layer = 'ct') = 1 AS complete FROM l GROUP BY vec_id""")
def packet_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The layers of each exported brick in order, with their sizes and sums as read back; complete with an intensity layer and no damage."""
    rows = materialize(coded_voxels(spark, folder).select(*AXES, F.col("u").alias("ct"), F.col("valid").alias("state")), "packet-source")
    store = builds.ChannelStore(spark, f"{scratch_root(spark)}/packets-{uuid.uuid4().hex}", EDGE)
    layers = {name: incremental.fingerprint("packet", name) for name in ("ct", "state")}
    for name, identity in layers.items():
        store.add(name, identity, rows, lambda part, name=name: part.select(*AXES, name))
    found = builds.packet_layers(store, layers, "ct")
    text = F.transform("layers", lambda x: F.concat_ws(":", x["layer"], x["n"].cast("string"), x["total"].cast("string")))
    number = F.col("bz").cast("long") * (GRID * GRID) + F.col("by") * GRID + F.col("bx")
    return found.select(number.alias("vec_id"), F.array_join(text, ";").alias("layers"), "complete")


@register("writer_identity", """WITH e AS (SELECT CAST(event_id AS BIGINT) AS event_id, event_type, user_id % 16 AS brick,
  substr(sha256(event_type || chr(31) || 'v1'), 1, 16) AS fingerprint FROM events), done AS (SELECT DISTINCT brick FROM e
  WHERE fingerprint = substr(sha256('purchase' || chr(31) || 'v1'), 1, 16) AND event_id % 3 = 0)
SELECT CAST(b.i AS BIGINT) AS brick FROM range(24) b(i) WHERE b.i NOT IN (SELECT brick FROM done)""")
def writer_identity(spark: SparkSession, folder: str) -> DataFrame:
    """Bricks that this writer still has to do: marks of other writers, of another identity, don't count."""
    mark = F.substring(F.sha2(F.concat("event_type", F.lit("\x1fv1")).cast("binary"), 256), 1, 16)
    done = table(spark, folder, "events").where("event_id % 3 = 0").select((F.col("user_id") % 16).alias("brick"), mark.alias("fingerprint"))
    return incremental.pending(spark.range(24).withColumnRenamed("id", "brick"), done, ["brick"], incremental.fingerprint("purchase", "v1"))


@register("chunk_files_box_read", f"""WITH {VOXELS_SQL} SELECT z, count(*) AS n, CAST(sum(u) AS BIGINT) AS total FROM coded WHERE z BETWEEN 2 AND 9
  AND y BETWEEN 5 AND 20 AND x BETWEEN 1 AND 30 AND z < (SELECT max(vec_id) // 64 * 4 FROM embeddings) GROUP BY z""")
def chunk_files_box_read(spark: SparkSession, folder: str) -> DataFrame:
    """A box of a chunked array: the whole layers are written as uncompressed chunk files, and only the box's files are opened."""
    last = (table(spark, folder, "embeddings").agg(F.max("vec_id").alias("v")).first()["v"] or 0) // 64 * 4
    packed = chunks.pack(coded_voxels(spark, folder).where(F.col("z") < last).withColumns({"store": F.lit("s"), "channel": F.lit("u")}), 4)
    path = f"{scratch_root(spark)}/array-{uuid.uuid4().hex}"
    chunks.write_array(packed, path, (last, 32, 32), 4)
    found = chunks.read_array(spark, path, (2, 5, 1), (8, 16, 30))
    return found.groupBy("z").agg(F.count(F.lit(1)).alias("n"), F.sum("u").alias("total"))


@register("octave_levels", """SELECT CAST(l AS INT) AS level, count(*) AS n, round(avg(log2(p / 2.4::DOUBLE)), 5) AS octaves FROM (SELECT p_size % 5 AS l,
  2.4::DOUBLE * pow(2, p_size % 5) * (1 + 0.001::DOUBLE * (p_partkey % 3)) AS p FROM part) GROUP BY l""")
def octave_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Pyramid levels of pitches that are off by up to a fifth of a percent, and the pitches as octaves."""
    pitch = 2.4 * F.pow(F.lit(2.0), F.col("p_size") % 5) * (1 + 0.001 * (F.col("p_partkey") % 3))
    rows = table(spark, folder, "part").select(pitch.alias("p"))
    octaves = codec.scale_value(F.col("p"))
    return rows.groupBy(F.rint(octaves).cast("int").alias("level")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(octaves), 5).alias("octaves"))


@register("radial_power", """WITH v AS (SELECT vec_id, label, i - 1 AS i, e - list_avg(embedding)::DOUBLE AS v FROM (SELECT vec_id, label, embedding,
  unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) AS i FROM embeddings)),
k AS (SELECT a.i AS kz, b.i AS ky, c.i AS kx, CAST(round_even(sqrt(least(a.i, 4 - a.i)**2 + least(b.i, 4 - b.i)**2 + least(c.i, 4 - c.i)**2),
  0) AS INT) AS radius FROM range(4) a(i), range(4) b(i), range(4) c(i)),
f AS (SELECT vec_id, label, radius, kz, ky, kx, sum(v * cos(pi() / 2 * (kz * (i // 16) + ky * (i // 4 % 4) + kx * (i % 4)))) AS re,
  sum(v * sin(pi() / 2 * (kz * (i // 16) + ky * (i // 4 % 4) + kx * (i % 4)))) AS im FROM v, k GROUP BY ALL)
SELECT CAST(f.label AS BIGINT) AS label, radius, round(avg(re * re + im * im), 4) AS power, count(*) AS n FROM f GROUP BY f.label, radius""")
def radial_power(spark: SparkSession, folder: str) -> DataFrame:
    """Power of each block's frequencies, averaged by their distance from zero."""
    return embeddings.radial_power(table(spark, folder, "embeddings"), "label", "embedding", 4)


@register("parsed_corrections", """WITH p AS (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
SELECT event_type, count(k) AS n_read, count(*) - count(k) AS n_refused, CAST(sum(k) FILTER (WHERE k >= 50) AS BIGINT) AS total FROM p GROUP BY event_type""")
def parsed_corrections(spark: SparkSession, folder: str) -> DataFrame:
    """Correction records read from JSON by a schema; what doesn't fit it is counted, not dropped."""
    rows = table(spark, folder, "events").select("event_type", F.from_json("props", "k int").getField("k").alias("k"))
    return rows.groupBy("event_type").agg(F.count("k").alias("n_read"), (F.count(F.lit(1)) - F.count("k")).alias("n_refused"), F.sum(F.when(F.col("k") >= 50,
        F.col("k"))).alias("total"))
