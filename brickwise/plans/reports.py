"""Queries that compare predictions with each other or with labels, and losses of several heads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brickwise.functions import vectors
from brickwise.operators import aggregates, fields, grid, joins, losses, stencil
from brickwise.plans.catalog import register
from brickwise.plans.encoding import _TRIPLES_SQL, triples
from brickwise.plans.fields import _FIBRE_SQL, _channels_sql, _normals
from brickwise.runtime import materialize
from brickwise.sources.voxels import VOXELS_SQL, coded_voxels

AXES = list(grid.AXES)
_STEPS_SQL = "steps(dz, dy, dx) AS (VALUES (1,0,0), (-1,0,0), (0,1,0), (0,-1,0), (0,0,1), (0,0,-1))"

#: Two predictions of the same voxels: probabilities pa and pb, distances ta and tb in voxels, known where the validity isn't 0.
_TWO_SQL = f"""{VOXELS_SQL}, w AS (SELECT *, v * 0.9::DOUBLE + 0.02::DOUBLE * ((x + y) % 3 - 1) AS vb FROM coded),
two AS (SELECT *, 1 / (1 + exp(-10 * v)) AS pa, 1 / (1 + exp(-10 * vb)) AS pb, v * 40 AS ta, vb * 40 AS tb FROM w WHERE valid <> 0)"""


def two_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """(place, label, valid, u, v, vb, pa, pb, ta, tb) of voxels with data: a prediction and another one of the same places."""
    rows = coded_voxels(spark, folder).where("valid <> 0").withColumn("vb", F.col("v") * 0.9 + 0.02 * ((F.col("x") + F.col("y")) % 3 - 1))
    chance = lambda c: 1 / (1 + F.exp(-10 * F.col(c)))
    return rows.withColumns({"pa": chance("v"), "pb": chance("vb"), "ta": F.col("v") * 40, "tb": F.col("vb") * 40})


def _mean(x: Column, where: Column | None = None, digits: int = 5) -> Column:
    return F.round(F.avg(F.when(where, x) if where is not None else x), digits)


def _n(where: Column) -> Column:
    return F.count(F.when(where, 1))


@register("surface_report", f"""WITH {_TWO_SQL}
SELECT label, round(2.0 * count(*) FILTER (WHERE pa >= 0.5 AND pb >= 0.5) / (count(*) FILTER (WHERE pa >= 0.5) + count(*) FILTER (WHERE pb >= 0.5)), 6) AS dice,
  round(avg(abs(pa - pb)), 5) AS mean_abs, round(max(abs(pa - pb)), 5) AS max_abs, count(*) FILTER (WHERE pa >= 0.5) AS n_a, count(*)
  FILTER (WHERE pb >= 0.5) AS n_b FROM two GROUP BY label""")
def surface_report(spark: SparkSession, folder: str) -> DataFrame:
    """Overlap and differences of two surface probabilities."""
    a, b, off = F.col("pa") >= 0.5, F.col("pb") >= 0.5, F.abs(F.col("pa") - F.col("pb"))
    return two_predictions(spark, folder).groupBy("label").agg(
        F.round(aggregates.dice(a, b, 1.0), 6).alias("dice"), _mean(off).alias("mean_abs"), F.round(F.max(off), 5).alias("max_abs"), _n(a).alias("n_a"),
            _n(b).alias("n_b"),
    )


def _precision_sql(score: str, other: str, name: str) -> str:
    return (
        f"{name}g AS (SELECT label, {score} AS score, count(*) AS n, count(*) FILTER (WHERE {other} >= 0.5) AS p FROM two GROUP BY 1, 2), "
        f"{name}r AS (SELECT *, sum(n) OVER w AS sn, sum(p) OVER w AS sp FROM {name}g WINDOW w AS (PARTITION BY label ORDER BY score DESC)), "
        f"{name} AS (SELECT label, CASE WHEN sum(p) > 0 AND sum(p) < sum(n) THEN sum(p * sp / sn) / sum(p) END AS ap FROM {name}r GROUP BY label)"
    )


@register("ink_report", f"""WITH {_TWO_SQL}, {_precision_sql("pb", "pa", "ab")}, {_precision_sql("pa", "pb", "ba")}
SELECT label, round(ab.ap, 6) AS ap_b_vs_a, round(ba.ap, 6) AS ap_a_vs_b, round((ab.ap + ba.ap) / 2, 6) AS auprc FROM ab JOIN ba USING (label)""")
def ink_report(spark: SparkSession, folder: str) -> DataFrame:
    """How well each of two probabilities ranks the other's positives, and the mean of both."""
    rows = two_predictions(spark, folder).select("label", "pa", "pb", (F.col("pa") >= 0.5).alias("a"), (F.col("pb") >= 0.5).alias("b"))
    one = aggregates.average_precision(rows, "pb", "a", ["label"]).withColumnRenamed("average_precision", "ab")
    two = aggregates.average_precision(rows, "pa", "b", ["label"]).withColumnRenamed("average_precision", "ba")
    return one.join(two, "label").select("label", F.round("ab", 6).alias("ap_b_vs_a"), F.round("ba", 6).alias("ap_a_vs_b"),
        F.round((F.col("ab") + F.col("ba")) / 2, 6).alias("auprc"))


_LINES_SQL = f"""{_TRIPLES_SQL}, ab AS (SELECT label, a / sqrt(a*a + b*b + c*c) AS az, b / sqrt(a*a + b*b + c*c) AS ay, c / sqrt(a*a + b*b + c*c) AS ax,
  a / sqrt(a*a + (b + 0.1)**2 + c*c) AS bz, (b + 0.1::DOUBLE) / sqrt(a*a + (b + 0.1)**2 + c*c) AS by_, c / sqrt(a*a + (b + 0.1)**2 + c*c) AS bx,
  abs(cos(20 * a)) AS ca, abs(cos(20 * b)) AS cb FROM tri)"""
_LINE_MAE_SQL = " + ".join(f"abs({p} - {q})" for p, q in zip(_channels_sql("az", "ay", "ax"), _channels_sql("bz", "by_", "bx"), strict=True))


@register("line_report", f"""WITH {_LINES_SQL}
SELECT label, round(avg(abs(ca - cb)), 5) AS cos_mae, round(avg(({_LINE_MAE_SQL}) / 6), 5) AS dir_mae, count(*) FILTER (WHERE ca > 0.7 AND cb > 0.7) AS n,
  round(avg(degrees(acos(least(1.0::DOUBLE, abs(az*bz + ay*by_ + ax*bx))))) FILTER (WHERE ca > 0.7 AND cb > 0.7), 3) AS mean_angle FROM ab GROUP BY label""")
def line_report(spark: SparkSession, folder: str) -> DataFrame:
    """Differences of the channels of two line fields, and the angle between their decoded lines where both are on a crest."""
    abc = (F.col("a"), F.col("b"), F.col("c"))
    moved = (F.col("a"), F.col("b") + 0.1, F.col("c"))
    rows = triples(spark, folder).withColumns({"ca": F.abs(F.cos(20 * F.col("a"))), "cb": F.abs(F.cos(20 * F.col("b")))})
    rows = rows.withColumns({f"{p}_{a}": c for p, v in (("p", vectors.unit(abc)), ("q", vectors.unit(moved))) for a, c in zip(AXES, v, strict=True)})
    for p in "pq":
        rows = rows.select("*", *fields.encode_line_field(tuple(F.col(f"{p}_{a}") for a in AXES)))
        rows = fields.decode_line_field(rows, f"n{p}").withColumnsRenamed({c: f"{p}{c}" for c in fields.LINE_CHANNELS}).drop("agreement", "misfit")
    crest = (F.col("ca") > 0.7) & (F.col("cb") > 0.7)
    angle = vectors.angle_deg(*[tuple(F.col(f"n{p}_{a}") for a in AXES) for p in "pq"], axial=True)
    apart = sum((F.abs(F.col(f"p{c}") - F.col(f"q{c}")) for c in fields.LINE_CHANNELS), F.lit(0.0)) / 6
    return rows.groupBy("label").agg(_mean(F.abs(F.col("ca") - F.col("cb"))).alias("cos_mae"), _mean(apart).alias("dir_mae"), _n(crest).alias("n"),
        _mean(angle, crest, 3).alias("mean_angle"))


@register("head_report", f"""WITH {_TWO_SQL}, h AS (SELECT *, abs(ta) < 10 AND abs(tb) < 10 AS band, abs(ta) < 10 AND abs(tb) < 10 AND valid = 1 AS sure,
  abs(atan2(sin(v * 6 - vb * 6), cos(v * 6 - vb * 6))) AS turn FROM two)
SELECT label, count(*) FILTER (WHERE band) AS n_band, count(*) FILTER (WHERE sure) AS n_valid, round(avg(abs(ta - tb)) FILTER (WHERE band), 5) AS sdf_mae,
  round(avg(abs(pa - pb)), 5) AS valid_mae,
  round(degrees(avg(turn) FILTER (WHERE sure)), 4) AS phase_mean, round(degrees(quantile_cont(turn, 0.5) FILTER (WHERE sure)), 4) AS phase_median FROM h
  GROUP BY label""")
def head_report(spark: SparkSession, folder: str) -> DataFrame:
    """Disagreement of the heads of two predictions: distances in their band, validity, and phases where supervised."""
    band = (F.abs("ta") < 10) & (F.abs("tb") < 10)
    sure = band & (F.col("valid") == 1)
    off = F.col("v") * 6 - F.col("vb") * 6
    rows = two_predictions(spark, folder).withColumn("turn", F.abs(F.atan2(F.sin(off), F.cos(off))))
    return rows.groupBy("label").agg(
        _n(band).alias("n_band"), _n(sure).alias("n_valid"), _mean(F.abs(F.col("ta") - F.col("tb")), band).alias("sdf_mae"),
            _mean(F.abs(F.col("pa") - F.col("pb"))).alias("valid_mae"),
        F.round(F.degrees(F.avg(F.when(sure, F.col("turn")))), 4).alias("phase_mean"), F.round(F.degrees(F.percentile(F.when(sure, F.col("turn")),
            F.lit(0.5))), 4).alias("phase_median"),
    )


@register("headline_by_kind", f"""WITH {_TWO_SQL}, m AS (SELECT label, 1 - 2.0 * count(*) FILTER (WHERE pa >= 0.5 AND pb >= 0.5) / (count(*)
  FILTER (WHERE pa >= 0.5) + count(*) FILTER (WHERE pb >= 0.5)) AS surface,
  avg(abs(ta - tb)) FILTER (WHERE abs(ta) < 10 AND abs(tb) < 10) AS student, avg(CASE WHEN (ta > 0) = (tb > 0) THEN 1.0 ELSE 0.0 END) AS side FROM two
  GROUP BY label), i AS (SELECT side AS own FROM m WHERE label = 1)
SELECT label, '1-dice' AS measure, round(surface, 5) AS value, CASE WHEN side >= 0.9 * own AND side >= 0.6 THEN 'preserving' ELSE 'flipping' END AS side
  FROM m, i
UNION ALL SELECT label, 'sdf_mae_band', round(student, 5), CASE WHEN side >= 0.9 * own AND side >= 0.6 THEN 'preserving' ELSE 'flipping' END FROM m, i""")
def headline_by_kind(spark: SparkSession, folder: str) -> DataFrame:
    """One number per kind of prediction, and whether its side agrees nearly as often as the label 1's."""
    band = (F.abs("ta") < 10) & (F.abs("tb") < 10)
    same = ((F.col("ta") > 0) == (F.col("tb") > 0)).cast("double")
    m = two_predictions(spark, folder).groupBy("label").agg(
        (1 - aggregates.dice(F.col("pa") >= 0.5, F.col("pb") >= 0.5, 1.0)).alias("1-dice"), F.avg(F.when(band,
            F.abs(F.col("ta") - F.col("tb")))).alias("sdf_mae_band"), F.avg(same).alias("side"),
    )
    own = m.where("label = 1").select(F.col("side").alias("own"))
    side = F.when((F.col("side") >= 0.9 * F.col("own")) & (F.col("side") >= 0.6), "preserving").otherwise("flipping")
    every = m.crossJoin(F.broadcast(own)).withColumn("side", side)  # own: one row
    return every.unpivot(["label", "side"], ["1-dice", "sdf_mae_band"], "measure", "value").select("label", "measure", F.round("value", 5).alias("value"),
        "side")


@register("voxel_report", f"""WITH {_TWO_SQL}
SELECT coalesce(CAST(label AS VARCHAR), 'all') AS store, count(*) AS n, round(avg(abs(ta - tb)) FILTER (WHERE abs(ta) <= 8 AND valid = 1), 5) AS sdf_mae,
  round(avg(CASE WHEN (pb >= 0.5) = (valid = 1) THEN 1.0 ELSE 0.0 END), 5) AS valid_accuracy,
  round(2.0 * count(*) FILTER (WHERE ta > 0 AND tb > 0) / (count(*) FILTER (WHERE ta > 0) + count(*) FILTER (WHERE tb > 0)), 6) AS body_dice,
  round(avg(tb - ta) FILTER (WHERE valid = 1), 5) AS bias FROM two GROUP BY ROLLUP (label)""")
def voxel_report(spark: SparkSession, folder: str) -> DataFrame:
    """Measures of all voxels in one pass, for each store and all together."""
    sure, near = F.col("valid") == 1, F.abs("ta") <= 8
    rows = two_predictions(spark, folder).withColumn("store", F.col("label").cast("string"))
    found = rows.rollup("store").agg(
        F.count(F.lit(1)).alias("n"), _mean(F.abs(F.col("ta") - F.col("tb")), near & sure).alias("sdf_mae"),
            _mean(((F.col("pb") >= 0.5) == sure).cast("double")).alias("valid_accuracy"),
        F.round(aggregates.dice(F.col("ta") > 0, F.col("tb") > 0, 1.0), 6).alias("body_dice"), _mean(F.col("tb") - F.col("ta"), sure).alias("bias"),
    )
    return found.withColumn("store", F.coalesce("store", F.lit("all")))


def _crossing_sql(name: str, value: str) -> str:
    return f"{name} AS (SELECT DISTINCT a.z, a.y, a.x FROM two a, steps s, two b WHERE a.{value} <= 0 AND b.{value} > 0 AND b.z = a.z + s.dz AND b.y = a.y + s.dy AND b.x = a.x + s.dx)"


def _way_sql(a: str, b: str) -> str:
    return (
        f"SELECT {a}.z, {a}.y, {a}.x, min(({a}.z-{b}.z)**2 + ({a}.y-{b}.y)**2 + ({a}.x-{b}.x)**2) AS d2 FROM {a} LEFT JOIN {b} ON {b}.z BETWEEN {a}.z-2 AND {a}.z+2 AND {b}.y BETWEEN {a}.y-2 AND {a}.y+2 "
        f"AND {b}.x BETWEEN {a}.x-2 AND {a}.x+2 AND ({a}.z-{b}.z)**2 + ({a}.y-{b}.y)**2 + ({a}.x-{b}.x)**2 <= 4 GROUP BY 1, 2, 3"
    )


@register("faces_report", f"""WITH {_TWO_SQL}, {_STEPS_SQL}, {_crossing_sql("fa", "ta")}, {_crossing_sql("fb", "tb")}, d AS (SELECT 'label' AS way, *
  FROM ({_way_sql("fa", "fb")}) UNION ALL SELECT 'prediction', * FROM ({_way_sql("fb", "fa")})),
m AS (SELECT round(avg(abs(ta - tb)), 5) AS mae FROM two WHERE abs(ta) <= 8)
SELECT way, count(*) AS n, count(*) FILTER (WHERE d2 <= 1) AS n_within1, count(d2) AS n_within2, round(avg(sqrt(d2)), 5) AS mean_distance,
  any_value(mae) AS sdf_mae FROM d, m GROUP BY way""")
def faces_report(spark: SparkSession, folder: str) -> DataFrame:
    """Distances between the zero sets of labels and predictions, either way, censored at two voxels, and the error in the band of eight."""
    rows = two_predictions(spark, folder)
    face = lambda c: stencil.zero_crossing(rows, F.col(c) <= 0, F.col(c) > 0).select(*AXES)
    fa, fb = face("ta"), face("tb")
    both = joins.nearest(fa, fb, 2, [], []).withColumn("way", F.lit("label")).unionByName(joins.nearest(fb, fa, 2, [], []).withColumn("way",
        F.lit("prediction")))
    found = both.groupBy("way").agg(F.count(F.lit(1)).alias("n"), _n(F.col("d2") <= 1).alias("n_within1"), F.count("d2").alias("n_within2"),
        _mean(F.sqrt("d2")).alias("mean_distance"))
    mae = rows.where(F.abs("ta") <= 8).agg(_mean(F.abs(F.col("ta") - F.col("tb"))).alias("sdf_mae"))
    return found.crossJoin(F.broadcast(mae))  # one row


@register("band_accuracy", f"""WITH {_FIBRE_SQL}
SELECT z, count(*) AS n, count(*) FILTER (WHERE (pv > ph) = (band = 2)) AS n_hit, round(avg(degrees(acos(least(1.0::DOUBLE, abs(CASE
  WHEN band = 2 THEN (pv*vz)*vz + (pv*vy + ph*hy)*vy + (pv*vx + ph*hx)*vx ELSE (pv*vy + ph*hy)*hy + (pv*vx + ph*hx)*hx END / ld))))), 3) AS mean_angle
FROM d WHERE band IN (1, 2) AND ok AND valid <> 0 GROUP BY z""")
def band_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """Within drawn bands: how often the likelier class is the drawn one, and the angle from the predicted direction to the drawn class's."""
    rows = materialize(_normals(spark, folder).where("valid <> 0").select(*AXES, "u", *[f"n_{a}" for a in AXES]), "normals")
    rows, along, across = fields.fibre_basis(rows, tuple(F.col(f"n_{a}") for a in AXES), (F.lit(1.0), F.lit(0.0), F.lit(0.0)))
    rows = rows.withColumns({"band": (F.col("x") + F.col("y")) % 4, "pv": F.abs(F.sin("u")),
        "ph": F.abs(F.cos("u"))}).where(F.col("_ok") & F.col("band").isin(1, 2))
    rows = rows.withColumns({f"e_{a}": F.col("pv") * v + F.col("ph") * h for a, v, h in zip(AXES, along, across, strict=True)})
    rows = rows.withColumns({f"t_{a}": F.when(F.col("band") == 2, v).otherwise(h) for a, v, h in zip(AXES, along, across, strict=True)})
    e, t = (tuple(F.col(f"{p}_{a}") for a in AXES) for p in "et")
    rows = rows.withColumn("share", F.abs(vectors.dot(e, t)) / vectors.norm(e))
    angle = F.degrees(F.acos(F.least(F.lit(1.0), "share")))
    return rows.groupBy("z").agg(F.count(F.lit(1)).alias("n"), _n((F.col("pv") > F.col("ph")) == (F.col("band") == 2)).alias("n_hit"), _mean(angle, None,
        3).alias("mean_angle"))


@register("medial_face_distances", f"""WITH {_TWO_SQL}, {_STEPS_SQL}, {_crossing_sql("f", "ta")}, r AS (SELECT a.z, a.y, a.x, a.pb, max(b.pb) AS top
  FROM two a JOIN two b ON b.z BETWEEN a.z-1 AND a.z+1 AND b.y BETWEEN a.y-1 AND a.y+1 AND b.x BETWEEN a.x-1 AND a.x+1 GROUP BY 1, 2, 3, 4),
m AS (SELECT z, y, x FROM r WHERE pb >= 0.5 AND pb = top)
SELECT z, count(*) AS n, count(d2) AS n_near, round(avg(sqrt(d2)), 5) AS mean_distance, round(max(sqrt(d2)), 5) AS most FROM ({_way_sql("m", "f")})
  GROUP BY z""")
def medial_face_distances(spark: SparkSession, folder: str) -> DataFrame:
    """From the crest of a probability to the nearest face of the labels, within two voxels."""
    rows = two_predictions(spark, folder)
    crest = stencil.neighbour_extreme(rows.select(*AXES, "pb"), "pb", 1, True, "top").where("pb >= 0.5 and pb = top").select(*AXES)
    near = joins.nearest(crest, stencil.zero_crossing(rows, F.col("ta") <= 0, F.col("ta") > 0), 2, [], [])
    return near.groupBy("z").agg(F.count(F.lit(1)).alias("n"), F.count("d2").alias("n_near"), _mean(F.sqrt("d2")).alias("mean_distance"),
        F.round(F.max(F.sqrt("d2")), 5).alias("most"))


@register("domain_distances", f"""WITH {VOXELS_SQL}, h AS (SELECT l.label, c.u, count(*) FILTER (WHERE coded.label = l.label) AS n FROM coded,
  (SELECT DISTINCT label FROM coded) l, (SELECT DISTINCT u FROM coded) c WHERE coded.u = c.u GROUP BY 1, 2),
t AS (SELECT label, u, n * 1.0::DOUBLE / sum(n) OVER (PARTITION BY label) AS p FROM h), c AS (SELECT label, u, sum(p) OVER (PARTITION BY label
  ORDER BY u) AS p, lead(u) OVER (PARTITION BY label ORDER BY u) - u AS width FROM t),
s AS (SELECT label, stddev_pop(u) AS sd FROM coded GROUP BY label)
SELECT a.label AS a, b.label AS b, round(sum(abs(a.p - b.p) * a.width), 5) AS w1, round(sum(abs(a.p - b.p) * a.width) / any_value(s.sd), 5) AS w1_over_sd
  FROM c a JOIN c b ON a.u = b.u AND a.label < b.label JOIN s ON s.label = a.label GROUP BY 1, 2""")
def domain_distances(spark: SparkSession, folder: str) -> DataFrame:
    """Distances between the code histograms of every two labels, also over the first one's deviation."""
    hist = coded_voxels(spark, folder).groupBy("label", "u").agg(F.count(F.lit(1)).alias("n"))  # 256 rows a label at most
    labels = hist.select("label").distinct()
    full = labels.crossJoin(F.broadcast(hist.select("u").distinct())).join(hist, ["label", "u"], "left").fillna(0, ["n"])  # 256 codes
    by = Window.partitionBy("label")
    run = full.select("label", "u", (F.sum("n").over(by.orderBy("u")) / F.sum("n").over(by)).alias("p"),
        (F.lead("u").over(by.orderBy("u")) - F.col("u")).alias("width"))
    sums = hist.groupBy("label").agg(F.sum("n").alias("k"), F.sum(F.col("n") * F.col("u")).alias("s"), F.sum(F.col("n") * F.col("u") * F.col("u")).alias("q"))
    sd = sums.select(F.col("label").alias("a"), F.sqrt(F.col("q") / F.col("k") - (F.col("s") / F.col("k")) ** 2).alias("sd"))
    one = run.select(F.col("label").alias("a"), "u", F.col("p").alias("pa"), "width")
    two = run.select(F.col("label").alias("b"), "u", F.col("p").alias("pb"))
    w1 = one.join(two, "u").where("a < b").groupBy("a", "b").agg(F.sum(F.abs(F.col("pa") - F.col("pb")) * F.col("width")).alias("w1"))
    return w1.join(sd, "a").select("a", "b", F.round("w1", 5).alias("w1"), F.round(F.col("w1") / F.col("sd"), 5).alias("w1_over_sd"))


_PEAK = "(1 + 8 * exp(-(t*t) / 32.0::DOUBLE))"
_BAND = "exp(-abs({}) / 2.0::DOUBLE)"
_DICE = "1 - (2 * sum({a} * {b} * m) + 1e-6::DOUBLE) / (sum({a} * {a} * m) + sum({b} * {b} * m) + 1e-6::DOUBLE)"
_BCE = "sum(((1 - {y}) * {l} + ln(1 + exp(-abs({l}))) + greatest(-{l}, 0)) * {m}) / greatest(sum({m}), 1)"


def _dice_sql(a: str, b: str) -> str:
    return _DICE.format(a=a, b=b)


_BODY_SQL = f"""{VOXELS_SQL}, q AS (SELECT *, v * 40 AS t, v * 36 + 1 AS p, v * 10 AS l, CASE WHEN valid = 1 THEN 1.0::DOUBLE ELSE 0 END AS m, CASE
  WHEN valid <> 2 THEN 1.0::DOUBLE ELSE 0 END AS k, CASE WHEN v > 0 THEN 1.0::DOUBLE ELSE 0 END AS b FROM coded)"""


def _body_rows(spark: SparkSession, folder: str) -> DataFrame:
    return coded_voxels(spark, folder).withColumns({"t": F.col("v") * 40, "p": F.col("v") * 36 + 1, "l": F.col("v") * 10})


@register("body_losses", f"""WITH {_BODY_SQL}, z0 AS (SELECT z, y, x FROM q WHERE abs(t) <= 0.5 AND valid = 1), near AS (SELECT DISTINCT q.z, q.y, q.x FROM q
  JOIN z0 ON q.z BETWEEN z0.z-1 AND z0.z+1 AND q.y BETWEEN z0.y-1 AND z0.y+1 AND q.x BETWEEN z0.x-1 AND z0.x+1),
e AS (SELECT q.*, CASE WHEN near.z IS NOT NULL AND NOT (abs(t) <= 0.5 AND valid = 1) THEN 1 ELSE 0 END AS shell FROM q LEFT JOIN near USING (z, y, x))
SELECT label, round(sum({_PEAK} * abs(p - t) * m) / greatest(sum(m), 1), 5) AS sdf_l1, round({_dice_sql(_BAND.format("p"), _BAND.format("t"))},
  5) AS band_dice, round({_BCE.format(y="m", l="l", m="k")}, 5) AS valid_bce,
  round(sum(greatest(0, 2 - abs(p)) * m * shell * (abs(t) >= 2)::INT) / greatest(sum(m * shell * (abs(t) >= 2)::INT), 1), 5) AS shell, round(sum(greatest(0,
  3 - abs(p)) * m * (abs(t) >= 6)::INT) / greatest(sum(m * (abs(t) >= 6)::INT), 1), 5) AS far FROM e GROUP BY label""")
def body_losses(spark: SparkSession, folder: str) -> DataFrame:
    """Terms of a signed body distance with its zero-set terms: in the shell around the label's zero set, and far from it."""
    rows = _body_rows(spark, folder)
    zero = rows.where((F.abs("t") <= 0.5) & (F.col("valid") == 1)).select(*AXES)
    shell = stencil.dilate(zero, 1).join(zero, AXES, "left_anti").withColumn("shell", F.lit(1.0))
    rows = rows.join(shell, AXES, "left").withColumn("shell", F.coalesce("shell", F.lit(0.0)))
    mask = (F.col("valid") == 1).cast("double")
    terms = losses.surface_terms(F.col("p"), F.col("t"), F.col("l"), F.col("valid"))
    terms |= {"shell": losses.shell_term(F.col("p"), F.col("t"), F.col("shell"), mask, 2.0), "far": losses.far_term(F.col("p"), F.col("t"), mask, 6.0)}
    return rows.groupBy("label").agg(*[F.round(c, 5).alias(n) for n, c in terms.items()])


@register("sides_losses", f"""WITH {_BODY_SQL}, s AS (SELECT label, valid, abs(t) AS t, abs(p) AS p, l, m, k, b, 1 / (1 + exp(-l)) AS share FROM q)
SELECT label, round(sum({_PEAK} * abs(p - t) * m) / greatest(sum(m), 1), 5) AS sdf_l1, round({_dice_sql(_BAND.format("p"), _BAND.format("t"))},
  5) AS band_dice, round({_BCE.format(y="b", l="l", m="m")}, 5) AS body_bce,
  round({_dice_sql("share", "b")}, 5) AS body_dice, round({_BCE.format(y="m", l="(l - 1)", m="k")}, 5) AS valid_bce FROM s GROUP BY label""")
def sides_losses(spark: SparkSession, folder: str) -> DataFrame:
    """Terms of an unsigned face distance, the body's side and validity."""
    rows = _body_rows(spark, folder)
    terms = losses.sides_terms(F.abs("p"), F.col("l"), F.col("l") - 1, F.abs("t"), (F.col("v") > 0).cast("double"), F.col("valid"))
    return rows.groupBy("label").agg(*[F.round(c, 5).alias(n) for n, c in terms.items()])


@register("descriptor_losses", f"""WITH {_TRIPLES_SQL}, w AS (SELECT *, CASE WHEN i % 3 = 0 THEN 1.0::DOUBLE ELSE 0 END AS m FROM tri)
SELECT label, round(sum((abs(a * 20 - b * 18) + abs(b * 20 - c * 18) + abs(c * 20 - a * 18)) / 3 / 20 * m) / greatest(sum(m), 1), 5) AS off_l1,
  round(sum(abs(a * 8 - c * 8) / 20 * m) / greatest(sum(m), 1), 5) AS thick_l1,
  round(sum(abs(1 / (1 + exp(-b)) - abs(sin(c))) * m) / greatest(sum(m), 1), 5) AS ncov_l1 FROM w GROUP BY label""")
def descriptor_losses(spark: SparkSession, folder: str) -> DataFrame:
    """Terms of local shape: offsets, thickness and incoherence of normals."""
    a, b, c = (F.col(n) for n in "abc")
    terms = losses.descriptor_terms([(a * 20, b * 18), (b * 20, c * 18), (c * 20, a * 18)], (a * 8, c * 8), b, F.abs(F.sin(c)), F.when(F.col("i") % 3 == 0,
        1).otherwise(0))
    return triples(spark, folder).groupBy("label").agg(*[F.round(t, 5).alias(n) for n, t in terms.items()])


#: Weights of heads in the total.
_HEADS = {"sdf_l1": 1.0, "band_dice": 0.5, "valid_bce": 0.2}


@register("weighted_total_loss", f"""WITH {_BODY_SQL}, e AS (SELECT label, sum({_PEAK} * abs(p - t) * m) / greatest(sum(m), 1) AS sdf_l1,
  {_dice_sql(_BAND.format("p"), _BAND.format("t"))} AS band_dice, {_BCE.format(y="m", l="l", m="k")} AS valid_bce FROM q GROUP BY label)
SELECT label, round(sdf_l1 + 0.5 * band_dice + 0.2 * valid_bce, 5) AS total, round(sdf_l1 / nullif(sdf_l1 + 0.5 * band_dice + 0.2 * valid_bce, 0),
  5) AS sdf_share FROM e""")
def weighted_total_loss(spark: SparkSession, folder: str) -> DataFrame:
    """The weighted sum of a head's terms, and the share of the largest."""
    terms = losses.surface_terms(F.col("p"), F.col("t"), F.col("l"), F.col("valid"))
    found = _body_rows(spark, folder).groupBy("label").agg(*[c.alias(n) for n, c in terms.items()])
    total = sum((w * F.col(n) for n, w in _HEADS.items()), F.lit(0.0))
    return found.select("label", F.round(total, 5).alias("total"), F.round(F.col("sdf_l1") / F.nullif(total, F.lit(0.0)), 5).alias("sdf_share"))


@register("class_contrast", f"""WITH {VOXELS_SQL}, m AS (SELECT label, quantile_cont(u / 255.0::DOUBLE, 0.25) AS low, quantile_cont(u / 255.0::DOUBLE,
  0.75) AS high FROM coded GROUP BY label),
s AS (SELECT label, u / 255.0::DOUBLE AS u, (low + high) / 2 AS mid, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (u / 255.0::DOUBLE - low) / greatest(high - low,
  1e-6::DOUBLE))) AS t FROM coded JOIN m USING (label))
SELECT label, round(sum(u + t * t * (3 - 2 * t) * (1.2::DOUBLE - 1) * (u - mid)), 4) AS total FROM s GROUP BY label""")
def class_contrast(spark: SparkSession, folder: str) -> DataFrame:
    """Codes spread about the middle of two modes, blended in smoothly from the lower mode to the upper."""
    rows = coded_voxels(spark, folder).select("label", (F.col("u") / 255.0).alias("u"))
    modes = rows.groupBy("label").agg(F.percentile("u", F.lit(0.25)).alias("low"), F.percentile("u", F.lit(0.75)).alias("high"))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("u") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-6))))
    out = rows.join(F.broadcast(modes), "label").withColumn("t", t)  # a row per label
    blend = F.col("t") * F.col("t") * (3 - 2 * F.col("t"))
    spread = F.col("u") + blend * (1.2 - 1) * (F.col("u") - (F.col("low") + F.col("high")) / 2)
    return out.groupBy("label").agg(F.round(F.sum(spread), 4).alias("total"))
