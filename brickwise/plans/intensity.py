"""Queries on intensity augmentation of every embedding's brick."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickwise.operators import grid, intensity
from brickwise.plans.catalog import register
from brickwise.sources.tables import table

AXES = list(grid.AXES)
SIZE = (4, 4, 4)
P = intensity.Intensity("scan", 0.5, hole=(0.25, 0.6), ring=0.2, stripe=0.2, streak=0.2)
SIGMAS, AMOUNT, SIGMA = (0.9, 0.4, 0.0), 0.5, 0.6
_BRICK_SQL = """r AS (SELECT vec_id AS box, label, pos // 16 AS z, pos // 4 % 4 AS y, pos % 4 AS x, greatest(0.0::DOUBLE, least(1.0::DOUBLE,
  0.5 + 2 * value::DOUBLE)) AS v
  FROM (SELECT vec_id, label, unnest(embedding) AS value, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings))"""


def bricks(spark: SparkSession, folder: str) -> DataFrame:
    """(box, label, z, y, x, v): each embedding as a box of 4^3 intensities in [0, 1]."""
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("box"), "label", F.posexplode("embedding").alias("pos", "value"))
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + 2 * F.col("value").cast("double")))
    return rows.select("box", "label", F.floor(F.col("pos") / 16).cast("int").alias("z"), (F.floor(F.col("pos") / 4) % 4).cast("int").alias("y"),
        (F.col("pos") % 4).cast("int").alias("x"), value.alias("v"))


def _blur_sql(source: str, axis: str, sigma: float, value: str = "v") -> str:
    radius = max(1, math.ceil(3 * sigma))
    rest = ", ".join(f"a.{a}" for a in AXES)
    same = " AND ".join(f"b.{a} = a.{a}" for a in AXES if a != axis)
    return (f"SELECT a.box, a.label, {rest}, sum(exp(-0.5::DOUBLE * pow(t / {sigma!r}::DOUBLE, 2)) * b.{value}) / sum(exp(-0.5::DOUBLE * pow(t / {sigma!r}::DOUBLE, 2))) AS v "
        f"FROM {source} a, (SELECT unnest(range(-{radius}, {radius + 1})) AS t) k JOIN {source} b ON b.box = a.box AND {same} "
        f"AND b.{axis} = greatest(0, least(3, a.{axis} + t)) GROUP BY a.box, a.label, {rest}")


@register("blurred_bricks", f"""WITH {_BRICK_SQL}, bz AS ({_blur_sql("r", "z", SIGMAS[0])}), s AS ({_blur_sql("bz", "y", SIGMAS[1])}),
cz AS ({_blur_sql("s", "z", SIGMA)}), cy AS ({_blur_sql("cz", "y", SIGMA)}), cx AS ({_blur_sql("cy", "x", SIGMA)})
SELECT s.box, round(sum(s.v), 6) AS soft, round(sum((s.z + 1) * (s.v + {AMOUNT} * (s.v - cx.v))), 5) AS sharp FROM s JOIN cx USING (box, z, y, x)
  GROUP BY s.box""")
def blurred_bricks(spark: SparkSession, folder: str) -> DataFrame:
    """Bricks blurred along two axes, and sharpened again."""
    soft = intensity.blurred(bricks(spark, folder), "v", SIGMAS, SIZE, "soft")
    both = intensity.sharpened(soft.withColumn("sharp", F.col("soft")), "sharp", AMOUNT, SIGMA, SIZE)
    return both.groupBy("box").agg(F.round(F.sum("soft"), 6).alias("soft"), F.round(F.sum((F.col("z") + 1) * F.col("sharp")), 5).alias("sharp"))


def _scan_sql() -> str:
    """The chain of :func:`intensity.scanned` as a chain of common table expressions, s0 to s8."""
    lit = lambda v: f"({float(v)!r}::DOUBLE)"
    key = lambda *parts: "'" + P.seed + ":' || box || " + " || ".join(f"':' || {q}" for q in parts)
    text = lambda s: f"'{s}'"
    even = lambda k, start=1: f"((('0x' || substr(md5({k}), {start}, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE)"
    normal = lambda k: f"(sqrt(-2 * ln({even(k)})) * cos({2 * math.pi!r}::DOUBLE * {even(k, 9)}))"
    draw = lambda name, ends: f"({lit(ends[0])} + {lit(ends[1] - ends[0])} * {even(key(text(name)))})"
    fires = lambda name: f"{even(key(text(name), text('fires')))} < {P.chance}"
    held = lambda c: f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {c}))"
    then = lambda name, c: f"CASE WHEN {fires(name)} THEN {c} ELSE v END"
    far, turn = f"(4 * {draw('ring far', (10.0, 20.0))})", f"({2 * math.pi!r}::DOUBLE * {even(key(text('ring turn')))})"
    ring = f"CAST(floor(sqrt(pow(y - 1.5 - {far} * sin({turn}), 2) + pow(x - 1.5 - {far} * cos({turn}), 2)) / {lit(P.ring_width)}) AS BIGINT)"
    line = f"CASE WHEN {even(key(text('stripe axis')))} < 0.5 THEN y ELSE x END"
    way = [normal(key(text("streak"), text(a))) for a in AXES]
    low, high = draw("window low", P.window_low), draw("window high", P.window_high)
    along = f"(({way[0]}) * z + ({way[1]}) * y + ({way[2]}) * x) / greatest(sqrt(pow({way[0]}, 2) + pow({way[1]}, 2) + pow({way[2]}, 2)), 1e-9)"
    steps = [
        then("gamma", f"pow({held('v')}, {draw('gamma', P.gamma)})"),
        then("contrast", f"(v - m) * {draw('contrast', P.contrast)} + m + {draw('brightness', (-P.brightness, P.brightness))}"),
        then("grain", f"v * (1 + {normal(key(text('grain'), 'z', 'y', 'x'))} * {draw('grain', (0.0, P.grain))})"),
        then("noise", f"v + {normal(key(text('noise'), 'z', 'y', 'x'))} * {draw('noise', (0.0, P.noise))}"),
        then("ring", held(f"v * (1 + {P.ring} * {normal(key(text('ring'), ring))})")), then("stripe",
            held(f"v * (1 + {P.stripe} * {normal(key(text('stripe'), line))})")),
        then("window", held(f"(v - {low}) / greatest({high} - {low}, 1e-6)")),
        then("streak", f"v + {P.streak} * sin({2 * math.pi!r}::DOUBLE * ({along} / {draw('streak pitch', P.pitch)} + {even(key(text('streak phase')))}))"),
    ]
    for i in range(P.holes):
        inside = [fires(f"hole {i}")]
        for a in AXES:
            extent = f"greatest(1, CAST(round_even({draw(f'hole {i} size {a}', P.hole)} * 4, 0) AS INT))"
            first = f"CAST(floor({even(key(text(f'hole {i} low {a}')))} * (5 - {extent})) AS INT)"
            inside.append(f"{a} >= {first} AND {a} < {first} + {extent}")
        steps.append(f"CASE WHEN {' AND '.join(inside)} THEN {even(key(text(f'hole {i} value')))} ELSE v END")
    last, out = "r", []
    for i, step in enumerate(steps):
        source = f"(SELECT *, avg(v) OVER (PARTITION BY box) AS m FROM {last})" if i == 1 else last
        out.append(f"s{i} AS (SELECT box, label, z, y, x, {step} AS v FROM {source})")
        last = f"s{i}"
    return ", ".join(out) + f" SELECT box, round(sum(v), 5) AS total, round(sum(v * (16 * z + 4 * y + x)), 3) AS moment FROM {last} GROUP BY box"


@register("scanned_bricks", f"WITH {_BRICK_SQL}, {_scan_sql()}")
def scanned_bricks(spark: SparkSession, folder: str) -> DataFrame:
    """Bricks as other scans of the same might give them: tone, noise, rings, stripes, window, waves and holes, each brick by its own draws."""
    found = intensity.scanned(bricks(spark, folder), "v", SIZE, P)
    number = 16 * F.col("z") + 4 * F.col("y") + F.col("x")
    return found.groupBy("box").agg(F.round(F.sum("v"), 5).alias("total"), F.round(F.sum(F.col("v") * number), 3).alias("moment"))
