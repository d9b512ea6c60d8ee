"""Queries on ranking metrics, samples, losses, normalisation and embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brickwise.functions import vectors
from brickwise.operators import aggregates, embeddings, grid, losses, sampling
from brickwise.plans.catalog import register
from brickwise.runtime import materialize
from brickwise.sources.tables import table
from brickwise.sources.voxels import VOXELS_SQL, coded_voxels, voxels

AXES = list(grid.AXES)


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    return docs.join(table(spark, folder, "labels"), "doc_id").select("lang", F.col("n_chars").cast("double").alias("score"),
        (F.col("quality") == 1).alias("positive"))


_SCORES_SQL = "s AS (SELECT lang, CAST(n_chars AS DOUBLE) AS score, quality = 1 AS positive FROM documents JOIN labels USING (doc_id))"


@register("average_precision", f"""WITH {_SCORES_SQL}, g AS (SELECT lang, score, count(*) AS n, count(*) FILTER (WHERE positive) AS p FROM s GROUP BY lang,
  score), r AS (SELECT *, sum(n) OVER w AS sn, sum(p) OVER w AS sp FROM g WINDOW w AS (PARTITION BY lang ORDER BY score DESC))
SELECT lang, round(CASE WHEN sum(p) > 0 AND sum(p) < sum(n) THEN sum(p * sp / sn) / sum(p) END, 6) AS average_precision FROM r GROUP BY lang""")
def average_precision(spark: SparkSession, folder: str) -> DataFrame:
    return aggregates.average_precision(_scores(spark, folder), "score", "positive", ["lang"]).select("lang", F.round("average_precision",
        6).alias("average_precision"))


@register("auroc", f"""WITH {_SCORES_SQL}, r AS (SELECT lang, positive, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang,
  score) - 1) / 2 AS rk FROM s)
SELECT lang, round(CASE WHEN count(*) FILTER (WHERE positive) > 0 AND count(*) FILTER (WHERE NOT positive) > 0 THEN (sum(rk)
  FILTER (WHERE positive) - count(*) FILTER (WHERE positive) * (count(*) FILTER (WHERE positive) + 1) / 2) / (count(*) FILTER (WHERE positive) * count(*)
    FILTER (WHERE NOT positive)) END, 6) AS auroc FROM r GROUP BY lang""")
def auroc(spark: SparkSession, folder: str) -> DataFrame:
    return aggregates.auroc(_scores(spark, folder), "score", "positive", ["lang"]).select("lang", F.round("auroc", 6).alias("auroc"))


@register("pairwise_iou", f"""WITH {VOXELS_SQL}, m AS (SELECT z, y, x % 8 AS x, x // 8 AS member FROM coded WHERE u > 140), n AS (SELECT member, count(*) AS n
  FROM m GROUP BY member),
p AS (SELECT a.member AS a, b.member AS b, (SELECT count(*) FROM m p JOIN m q USING (z, y, x) WHERE p.member = a.member AND q.member = b.member) AS common
  FROM n a JOIN n b ON a.member < b.member)
SELECT a, b, round(common / (na.n + nb.n - common), 6) AS iou FROM p JOIN n na ON na.member = a JOIN n nb ON nb.member = b""")
def pairwise_iou(spark: SparkSession, folder: str) -> DataFrame:
    """Overlap of the masks of four members: a row per pair of members, counted in one pass over the voxels."""
    m = coded_voxels(spark, folder).where("u > 140").select("z", "y", (F.col("x") % 8).alias("x"), F.floor(F.col("x") / 8).cast("int").alias("member"))
    members = m.groupBy("z", "y", "x").agg(F.array_sort(F.collect_set("member")).alias("ms"))  # four members at most
    sizes = m.groupBy("member").agg(F.count(F.lit(1)).alias("n"))
    pairs = members.select(F.explode("ms").alias("a"), "ms").select("a", F.explode("ms").alias("b")).where("a < b").groupBy("a",
        "b").agg(F.count(F.lit(1)).alias("both"))
    joined = pairs.join(sizes.select(F.col("member").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("member").alias("b"),
        F.col("n").alias("nb")), "b")
    return joined.select("a", "b", F.round(F.col("both") / (F.col("na") + F.col("nb") - F.col("both")), 6).alias("iou"))


@register("member_deviation", f"""WITH {VOXELS_SQL}, s AS (SELECT z, y, x % 8 AS x, stddev_pop(v) AS sd, sqrt(avg(sin(v * 6))**2 + avg(cos(v * 6))**2) AS r
  FROM vox GROUP BY 1, 2, 3)
SELECT z, round(avg(sd), 6) AS mean_std, round(avg(sqrt(-2 * ln(greatest(r, 1e-12::DOUBLE)))), 6) AS mean_circular_std FROM s GROUP BY z""")
def member_deviation(spark: SparkSession, folder: str) -> DataFrame:
    angle = F.col("v") * 6
    length = F.sqrt(F.avg(F.sin(angle)) ** 2 + F.avg(F.cos(angle)) ** 2)
    s = voxels(spark, folder).groupBy("z", "y", (F.col("x") % 8).alias("x")).agg(F.stddev_pop("v").alias("sd"), length.alias("r"))
    return s.groupBy("z").agg(F.round(F.avg("sd"), 6).alias("mean_std"), F.round(F.avg(F.sqrt(-2 * F.log(F.greatest("r", F.lit(1e-12))))),
        6).alias("mean_circular_std"))


@register("wasserstein1_hist", f"""WITH {VOXELS_SQL}, h AS (SELECT u, count(*) FILTER (WHERE label % 2 = 0) AS a, count(*) FILTER (WHERE label % 2 = 1) AS b
  FROM coded GROUP BY u), c AS (SELECT abs(sum(a / (SELECT sum(a) FROM h) - b / (SELECT sum(b) FROM h)) OVER (ORDER BY u)) AS d FROM h)
SELECT round(sum(d), 6) AS w1 FROM c""")
def wasserstein1_hist(spark: SparkSession, folder: str) -> DataFrame:
    even = F.col("label") % 2 == 0
    hist = coded_voxels(spark, folder).groupBy("u").agg(F.count(F.when(even, 1)).alias("a"), F.count(F.when(~even, 1)).alias("b"))
    return aggregates.wasserstein1(hist, "u", "a", "b", 1.0).select(F.round("w1", 6).alias("w1"))


@register("loglog_slope", """WITH p AS (SELECT CAST(l_quantity AS DOUBLE) AS f, sum(l_extendedprice) AS power FROM lineitem WHERE l_quantity > 2
  GROUP BY l_quantity) SELECT round(regr_slope(ln(power), ln(f)), 6) AS slope FROM p""")
def loglog_slope(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "lineitem").where("l_quantity > 2").groupBy(F.col("l_quantity").alias("f")).agg(F.sum("l_extendedprice").alias("power"))
    return p.agg(F.round(F.regr_slope(F.log("power"), F.log("f")), 6).alias("slope"))


@register("argmax_change", """WITH m AS (SELECT vec_id, label, list_position(embedding[1:32], list_max(embedding[1:32])) AS a, list_position(embedding[33:64],
  list_max(embedding[33:64])) AS b FROM embeddings) SELECT label, count(*) AS n, round(avg(CASE WHEN a <> b THEN 1.0 ELSE 0.0 END), 6) AS changed FROM m
  GROUP BY label""")
def argmax_change(spark: SparkSession, folder: str) -> DataFrame:
    first, second = F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)
    place = lambda a: F.array_position(a, F.array_max(a))
    return table(spark, folder, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"),
        F.round(F.avg((place(first) != place(second)).cast("double")), 6).alias("changed"))


@register("delta_stats", f"""WITH {VOXELS_SQL}, d AS (SELECT a.z, abs(a.v - b.v) AS d FROM vox a JOIN vox b ON b.z = a.z AND b.y = a.y AND b.x = a.x + 1
  WHERE a.x % 2 = 0)
SELECT z, round(avg(d), 6) AS mean, round(quantile_cont(d, 0.9), 6) AS p90, round(quantile_cont(d, 0.99), 6) AS p99, round(max(d), 6) AS worst FROM d
  GROUP BY z""")
def delta_stats(spark: SparkSession, folder: str) -> DataFrame:
    a = voxels(spark, folder).select(*AXES, "v")
    b = a.select("z", "y", (F.col("x") - 1).alias("x"), F.col("v").alias("w"))
    d = a.where("x % 2 = 0").join(b, AXES).select("z", F.abs(F.col("v") - F.col("w")).alias("d"))
    d = materialize(d, "deltas")
    ends = aggregates.percentiles(d, "d", ["z"], {"p90": 0.9, "p99": 0.99}).select("z", F.round("p90", 6).alias("p90"), F.round("p99", 6).alias("p99"))
    return d.groupBy("z").agg(F.round(F.avg("d"), 6).alias("mean"), F.round(F.max("d"), 6).alias("worst")).join(ends, "z")


@register("structure_correlation", """WITH s AS (SELECT l_suppkey, avg(l_discount) AS score, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS swaps,
  avg(l_quantity) AS flips FROM lineitem GROUP BY l_suppkey) SELECT round(corr(score, swaps), 6) AS with_swaps, round(corr(score, flips), 6) AS with_flips,
  count(*) AS n FROM s""")
def structure_correlation(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("score"),
        F.avg((F.col("l_returnflag") == "R").cast("double")).alias("swaps"), F.avg("l_quantity").alias("flips"))
    return s.agg(F.round(F.corr("score", "swaps"), 6).alias("with_swaps"), F.round(F.corr("score", "flips"), 6).alias("with_flips"),
        F.count(F.lit(1)).alias("n"))


_U_SQL = "CAST(CAST('0x' || substr(md5({}), 1, 13) AS UBIGINT) AS DOUBLE) / 4503599627370496.0"


@register("bottomk_sample_md5",
    "WITH u AS (SELECT o_orderkey, o_orderstatus, " + _U_SQL.format("CAST(o_orderkey AS VARCHAR) || '|s1'") + " AS u FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY u, o_orderkey) AS r FROM u) SELECT o_orderkey, o_orderstatus FROM r WHERE r <= 25")
def bottomk_sample_md5(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.bottom_k(table(spark, folder, "orders").select("o_orderkey", "o_orderstatus"), 25, ["o_orderkey"], ["o_orderstatus"], "s1")


@register("weighted_store_pick",
    "WITH u AS (SELECT o_orderkey, " + _U_SQL.format("CAST(o_orderkey AS VARCHAR) || '|w'") + " AS u FROM orders) SELECT CASE WHEN u < 0.5::DOUBLE THEN 'a' WHEN u < 0.8::DOUBLE THEN 'b' ELSE 'c' END AS store, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM u GROUP BY 1")
def weighted_store_pick(spark: SparkSession, folder: str) -> DataFrame:
    picked = sampling.weighted_choice(table(spark, folder, "orders"), ["o_orderkey"], {"a": 5, "b": 3, "c": 2}, "w", "store")
    return picked.groupBy("store").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("key_sum"))


@register("best_start_per_bin", """WITH c AS (SELECT l_suppkey AS start, sum(l_quantity) AS score FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 100),
  b AS (SELECT *, ntile(8) OVER (ORDER BY start) AS bin FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY score DESC, start) AS r
  FROM b) SELECT start, score FROM r WHERE r = 1""")
def best_start_per_bin(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("start")).agg(F.sum("l_quantity").alias("score")).where("score > 100")
    return sampling.best_per_bin(c, 8, "start", "score", "start")


@register("topk_nonoverlap_candidates",
    f"""WITH RECURSIVE {VOXELS_SQL}, b AS (SELECT z // 4 * 4 AS z, y // 4 * 4 AS y, x // 4 * 4 AS x, CAST(sum(u) AS DOUBLE) AS score FROM coded GROUP BY 1,
  2, 3),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, z, y, x) AS r FROM b),
g AS (SELECT 0::BIGINT AS r, []::STRUCT(z INT, y INT, x INT, score DOUBLE)[] AS taken
  UNION ALL SELECT r.r, CASE WHEN len(list_filter(g.taken, lambda t: abs(t.z - r.z) < 8 AND abs(t.y - r.y) < 8 AND abs(t.x - r.x) < 8)) = 0
    THEN list_append(g.taken, {{'z': r.z, 'y': r.y, 'x': r.x, 'score': r.score}}) ELSE g.taken END FROM g JOIN r ON r.r = g.r + 1 WHERE len(g.taken) < 12)
SELECT t.z, t.y, t.x, t.score FROM (SELECT unnest(arg_max(taken, r)) AS t FROM g)""")
def topk_nonoverlap_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """The twelve densest blocks of which no two cubes of eight voxels overlap."""
    blocks = coded_voxels(spark,
        folder).groupBy(*[(F.floor(F.col(a) / 4) * 4).cast("int").alias(a) for a in AXES]).agg(F.sum("u").cast("double").alias("score"))
    return spark.createDataFrame([(r["z"], r["y"], r["x"], r["score"]) for r in sampling.spread_top(blocks, 12, 8, "score", grid.AXES)],
        "z int, y int, x int, score double")


@register("holdout_band_split", """WITH o AS (SELECT p_partkey, CAST(p_partkey % 50 * 4 AS INT) AS z FROM part), h AS (SELECT min(z) AS lo, max(z) + 16 AS hi
  FROM o WHERE z >= 120 AND z < 150)
SELECT CASE WHEN z >= 120 AND z < 150 THEN 'holdout' WHEN z + 16 <= lo OR z >= hi THEN 'train' ELSE 'gap' END AS part, count(*) AS n FROM o, h GROUP BY 1""")
def holdout_band_split(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "part").select("p_partkey", (F.col("p_partkey") % 50 * 4).cast("int").alias("z"))
    return sampling.band_split(o, "z", 16, 120, 150).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@register("bce_dice_loss", f"""WITH {VOXELS_SQL}, t AS (SELECT label, v * 10 AS logit, CASE WHEN x % 2 = 0 THEN 1.0 ELSE 0.0 END AS t, CASE
  WHEN valid = 1 THEN 1.0 ELSE 0.0 END AS m FROM coded), p AS (SELECT *, 1 / (1 + exp(-logit)) AS p FROM t)
SELECT label, round(sum(((1 - t) * logit + ln(1 + exp(-abs(logit))) + greatest(-logit, 0.0::DOUBLE)) * m) / greatest(sum(m), 1.0::DOUBLE), 6) AS bce,
  round(1 - (2 * sum(p * t * m) + 1e-6::DOUBLE) / (sum(p * p * m) + sum(t * t * m) + 1e-6::DOUBLE), 6) AS dice,
  round(greatest(1.0::DOUBLE, least(50.0::DOUBLE, sum((1 - t) * m) / greatest(sum(t * m), 1.0::DOUBLE))), 6) AS weight FROM p GROUP BY label""")
def bce_dice_loss(spark: SparkSession, folder: str) -> DataFrame:
    logit, t, m = F.col("v") * 10, (F.col("x") % 2 == 0).cast("double"), (F.col("valid") == 1).cast("double")
    p = 1 / (1 + F.exp(-logit))
    return coded_voxels(spark, folder).groupBy("label").agg(F.round(losses.bce(logit, t, m), 6).alias("bce"), F.round(losses.soft_dice(p, t, m),
        6).alias("dice"), F.round(losses.positive_weight(t, m), 6).alias("weight"))


@register("surface_band_loss", f"""WITH {VOXELS_SQL}, d AS (SELECT label, v * 40 AS p, v * 40 + x % 3 - 1 AS t, CASE WHEN valid = 1 THEN 1.0 ELSE 0.0 END AS m
  FROM coded), e AS (SELECT *, exp(-abs(p) / 2) AS pa, exp(-abs(t) / 2) AS ta, m * exp(-0.5 * (t / 4) * (t / 4)) AS w FROM d)
SELECT label, round(1 - (2 * sum(pa * ta * m) + 1e-6::DOUBLE) / (sum(pa * pa * m) + sum(ta * ta * m) + 1e-6::DOUBLE), 6) AS band_dice,
  round(sum(w * abs(p - t)) / greatest(sum(w), 1.0::DOUBLE), 6) AS weighted_l1,
  round(sum(m * CASE WHEN abs(p - t) <= 1 THEN 0.5 * (p - t) * (p - t) ELSE abs(p - t) - 0.5 END) / greatest(sum(m), 1.0::DOUBLE), 6) AS huber FROM e
  GROUP BY label""")
def surface_band_loss(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("v") * 40
    t, m = p + F.col("x") % 3 - 1, (F.col("valid") == 1).cast("double")
    return coded_voxels(spark, folder).groupBy("label").agg(F.round(losses.band_dice(p, t, m), 6).alias("band_dice"), F.round(losses.surface_weighted_l1(p, t,
        m), 6).alias("weighted_l1"), F.round(losses.huber(p, t, m), 6).alias("huber"))


@register("zscore_per_window", f"""WITH {VOXELS_SQL}, s AS (SELECT vec_id, avg(v) AS mu, greatest(stddev_pop(v), 1e-8::DOUBLE) AS sd,
  greatest(coalesce(stddev_samp(v), 0), 1e-3::DOUBLE) AS ss FROM vox GROUP BY vec_id) SELECT vec_id, round(max((v - mu) / sd), 6) AS top_population,
  round(max((v - mu) / ss), 6) AS top_sample FROM vox JOIN s USING (vec_id) GROUP BY vec_id""")
def zscore_per_window(spark: SparkSession, folder: str) -> DataFrame:
    rows = voxels(spark, folder)
    both = aggregates.zscore(aggregates.zscore(rows, "v", ["vec_id"], name="p"), "v", ["vec_id"], sample=True, name="s")
    return both.groupBy("vec_id").agg(F.round(F.max("p"), 6).alias("top_population"), F.round(F.max("s"), 6).alias("top_sample"))


@register("percentile_minmax", f"""WITH {VOXELS_SQL}, e AS (SELECT label, quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi FROM vox
  GROUP BY label) SELECT label, round(avg(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (v - lo) / (hi - lo)))), 6) AS mean FROM vox JOIN e USING (label)
    GROUP BY label""")
def percentile_minmax(spark: SparkSession, folder: str) -> DataFrame:
    return aggregates.percentile_minmax(voxels(spark, folder), "v", ["label"], 0.05, 0.95).groupBy("label").agg(F.round(F.avg("normalised"), 6).alias("mean"))


@register("robust_normalise", f"""WITH {VOXELS_SQL}, e AS (SELECT label, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM vox GROUP BY label),
  c AS (SELECT label, greatest(lo, least(hi, v)) AS v FROM vox JOIN e USING (label)), m AS (SELECT label, quantile_cont(v, 0.5) AS mid FROM c GROUP BY label),
d AS (SELECT label, v - mid AS v FROM c JOIN m USING (label)), s AS (SELECT label, 1.4826 * quantile_cont(abs(v), 0.5) AS mad FROM d GROUP BY label)
SELECT label, round(avg(v / mad), 6) AS mean, round(max(v / mad), 6) AS top FROM d JOIN s USING (label) GROUP BY label""")
def robust_normalise(spark: SparkSession, folder: str) -> DataFrame:
    return aggregates.robust_normalise(voxels(spark, folder), "v", ["label"]).groupBy("label").agg(F.round(F.avg("normalised"), 6).alias("mean"),
        F.round(F.max("normalised"), 6).alias("top"))


@register("orientation48_invert", f"""WITH {VOXELS_SQL}, s AS (SELECT count(*) AS n, count(DISTINCT z % 4 * 16 + y % 4 * 4 + x % 4) AS places FROM vox)
SELECT CAST(e.i AS INT) AS element, n AS n_home, n, places AS n_places FROM range(48) e(i), s""")
def orientation48_invert(spark: SparkSession, folder: str) -> DataFrame:
    """For each of the 48 orientations: places within a brick that come back to themselves, and the places they take."""
    cube = voxels(spark, folder).select("v", *[(F.col(a) % 4).alias(a) for a in AXES])
    turns = spark.createDataFrame([(i, list(axes), list(signs)) for i, axes, signs in vectors.orientations()], "element int, axes array<int>, signs array<int>")
    c = [F.col(a) - 1.5 for a in AXES]
    spread = cube.join(F.broadcast(turns))  # 48 rows
    place = F.array(*c)
    turned = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.get(place, F.get("axes", k)) * F.get("signs", k))
    back = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.get(F.col("turned"), F.array_position("axes", k).cast("int") - 1) * F.get("signs",
        F.array_position("axes", k).cast("int") - 1))
    out = spread.withColumn("turned", turned).withColumn("back", back).withColumn("home", F.col("back") == place)
    return out.groupBy("element").agg(F.count(F.when(F.col("home"), 1)).alias("n_home"), F.count(F.lit(1)).alias("n"),
        F.countDistinct("turned").alias("n_places"))


@register("l2_normalise_tokens", """WITH n AS (SELECT vec_id, label, sqrt(list_sum(list_transform(embedding,
  lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS norm, embedding FROM embeddings)
SELECT label, count(*) AS n, round(avg(norm), 5) AS mean_norm, round(sum(CAST(embedding[1] AS DOUBLE) / norm), 6) AS sum_first FROM n GROUP BY label""")
def l2_normalise_tokens(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").withColumn("norm", embeddings.norm("embedding")).withColumn("unit", embeddings.unit("embedding"))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("norm"), 5).alias("mean_norm"), F.round(F.sum(F.get("unit", F.lit(0))),
        6).alias("sum_first"))


@register("reference_similarity", """WITH r AS (SELECT list(m ORDER BY i) AS ref FROM (SELECT i, avg(CAST(v AS DOUBLE)) AS m
  FROM (SELECT unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE label = 0) GROUP BY i)),
s AS (SELECT vec_id, label, list_sum(list_transform(list_zip(embedding, ref),
  lambda p: CAST(p[1] AS DOUBLE) * p[2])) / sqrt(list_sum(list_transform(embedding,
  lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) / sqrt(list_sum(list_transform(ref, lambda x: x * x))) AS c FROM embeddings, r)
SELECT label, round(avg(c), 6) AS mean_cos, round(max(c), 6) AS top_cos FROM s GROUP BY label""")
def reference_similarity(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    mean = embeddings.mean_vector(rows.where("label = 0"), "embedding").withColumnRenamed("embedding", "reference")
    return rows.crossJoin(F.broadcast(mean)).groupBy("label").agg(F.round(F.avg(embeddings.cosine("embedding", "reference")), 6).alias("mean_cos"),
        F.round(F.max(embeddings.cosine("embedding", "reference")), 6).alias("top_cos"))  # mean: one row


@register("pca_projection")
def pca_projection(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector on the eight main components, and how much of it they explain."""
    rows = table(spark, folder, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    model = embeddings.fit_pca(rows, "embedding", 8)
    return rows.select("vec_id", embeddings.apply_pca(model, "embedding").alias("projected")).select("vec_id", F.round(F.sqrt(F.aggregate("projected",
        F.lit(0.0), lambda acc, x: acc + x * x)), 6).alias("length"))


def _logistic_share(x: np.ndarray) -> np.ndarray:
    return (1 / (1 + np.exp(-x)) > 0.5).mean(axis=1)


@register("sliding_score",
    "SELECT vec_id, list_avg(list_transform(embedding, lambda x: CASE WHEN x::DOUBLE > list_avg(embedding)::DOUBLE THEN 1.0::DOUBLE ELSE 0 END)) AS score FROM embeddings")
def sliding_score(spark: SparkSession, folder: str) -> DataFrame:
    """Each brick scored by a model in Arrow batches: the share of the logistic of its normalised values above one half."""
    return embeddings.score(table(spark, folder, "embeddings"), "vec_id", "embedding", _logistic_share)


@register("member_rank_stats", """WITH r AS (SELECT label, vec_id, embedding[1] AS score, percent_rank() OVER (PARTITION BY label
  ORDER BY embedding[1]) AS pr, dense_rank() OVER (PARTITION BY label ORDER BY round(CAST(embedding[1] AS DOUBLE), 1)) AS dr FROM embeddings) SELECT label,
    round(avg(pr), 6) AS mean_rank, max(dr) AS levels FROM r GROUP BY label""")
def member_rank_stats(spark: SparkSession, folder: str) -> DataFrame:
    score = F.get("embedding", F.lit(0))
    r = table(spark, folder, "embeddings").select("label", F.percent_rank().over(Window.partitionBy("label").orderBy(score)).alias("pr"),
        F.dense_rank().over(Window.partitionBy("label").orderBy(F.round(score.cast("double"), 1))).alias("dr"))
    return r.groupBy("label").agg(F.round(F.avg("pr"), 6).alias("mean_rank"), F.max("dr").cast("long").alias("levels"))
