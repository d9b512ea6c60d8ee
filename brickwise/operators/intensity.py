"""Intensity augmentation of boxes of voxels: blurs, tone, noise and the artefacts of scanners, all drawn from hashes of the box."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brickwise.operators.grid import AXES
from brickwise.operators.warp import hashed_normal

Range = tuple[float, float]


class Intensity(NamedTuple):
    """``chance`` of each transform for a box; ranges are drawn from evenly, by the box."""

    seed: str = "0"
    chance: float = 0.3
    gamma: Range = (0.7, 1.4)
    contrast: Range = (0.75, 1.25)
    brightness: float = 0.1
    grain: float = 0.1
    noise: float = 0.1
    ring: float = 0.05
    ring_width: float = 2.0
    stripe: float = 0.05
    window_low: Range = (0.0, 0.1)
    window_high: Range = (0.9, 1.0)
    streak: float = 0.05
    pitch: Range = (4.0, 20.0)
    holes: int = 2
    hole: Range = (0.1, 0.3)


def hashed_even(key: Column) -> Column:
    """A number in (0, 1) drawn evenly from a text, the same wherever it is drawn."""
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") + 0.5) / 2.0**32


def blurred(rows: DataFrame, value: str, sigmas: tuple[float, float, float], size: tuple[int, int, int], name: str) -> DataFrame:
    """``rows`` (box, z, y, x from 0) with a value blurred in each box by a gaussian of a sigma for each axis, 0 for none; the border's values go on beyond it.

    A place meets the 2 radius + 1 others of its line at most; a place that has no row, or a null, inside the box leaves its weight to the others.
    """
    out, last = rows, value
    for axis, sigma, n in zip(AXES, sigmas, size, strict=True):
        if sigma <= 0:
            continue
        radius = max(1, math.ceil(3 * sigma))
        weight = [math.exp(-0.5 * (t / sigma) ** 2) for t in range(-radius, radius + 1)]
        weights = F.array(*map(F.lit, weight))
        beyond = F.array(*[F.lit(sum(weight[:k])) for k in range(radius + 1)])  # of the first k offsets
        near = F.collect_list(F.struct(F.col(axis).alias("at"), F.col(last).alias("v"))).over(Window.partitionBy("box",
            *[a for a in AXES if a != axis]).orderBy(
            axis).rangeBetween(-radius, radius))

        def share(p: Column, axis: str = axis, n: int = n, radius: int = radius, weights: Column = weights, beyond: Column = beyond) -> Column:
            here = F.col(axis)
            low = F.when(p["at"] == 0, F.get(beyond, F.greatest(F.lit(0), radius - here))).otherwise(0.0)
            high = F.when(p["at"] == n - 1, F.get(beyond, F.greatest(F.lit(0), radius - (n - 1 - here)))).otherwise(0.0)
            return F.get(weights, p["at"] - here + radius) + low + high

        known = F.filter("_near", lambda p: p["v"].isNotNull())
        top = F.aggregate(known, F.lit(0.0), lambda acc, p: acc + share(p) * p["v"])  # noqa: B023
        whole = F.aggregate(known, F.lit(0.0), lambda acc, p: acc + share(p))  # noqa: B023
        out = out.withColumn("_near", near).withColumn(name, F.when(whole > 0, top / whole)).drop("_near")
        last = name
    return out if last == name else out.withColumn(name, F.col(value))


def sharpened(rows: DataFrame, value: str, amount: float, sigma: float, size: tuple[int, int, int]) -> DataFrame:
    """``rows`` with a value moved away from its blur by ``amount`` times what it differs."""
    soft = blurred(rows, value, (sigma, sigma, sigma), size, "_soft")
    return soft.withColumn(value, F.col(value) + amount * (F.col(value) - F.col("_soft"))).drop("_soft")


def scanned(rows: DataFrame, value: str, size: tuple[int, int, int], p: Intensity = Intensity()) -> DataFrame:
    """``rows`` (box, z, y, x from 0, ...) with a value in [0, 1] as another scan of the same box might give it.

    In order, each for a box by its own draw: gamma; contrast about the box's mean, and brightness; grain that multiplies, noise that adds; rings about a
    line along z far outside the box; stripes of rows or columns; the window of an export to bytes; plane waves; and holes of one value. Rings, stripes and
    the window leave [0, 1]; what comes after gamma may leave it too, as in a scan. Every number is drawn from the seed, the box, the transform's name and,
    for noise, the place: the same for any partitioning and order. A null value stays null until a hole covers it; a null box draws as one of its own.
    """
    box = F.coalesce(F.col("box").cast("string"), F.lit("-"))
    key = lambda *parts: F.concat_ws(":", F.lit(p.seed), box, *[x if isinstance(x, Column) else F.lit(x) for x in parts])
    draw = lambda name, ends: ends[0] + (ends[1] - ends[0]) * hashed_even(key(name))
    fires = lambda name: hashed_even(key(name, "fires")) < p.chance
    held = lambda c: F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))
    then = lambda name, c: F.when(fires(name), c).otherwise(F.col("_x"))
    place = [F.col(a).cast("string") for a in AXES]
    x = F.col("_x")
    out = rows.withColumn("_x", F.col(value).cast("double"))
    out = out.withColumn("_x", then("gamma", F.pow(held(x), draw("gamma", p.gamma))))
    mean = F.avg("_x").over(Window.partitionBy("box"))  # a box is as large as a crop
    out = out.withColumn("_mean", mean)
    out = out.withColumn("_x", then("contrast", (x - F.col("_mean")) * draw("contrast", p.contrast) + F.col("_mean") + draw("brightness", (-p.brightness,
        p.brightness)))).drop("_mean")
    out = out.withColumn("_x", then("grain", x * (1 + hashed_normal(key("grain", *place)) * draw("grain", (0.0, p.grain)))))
    out = out.withColumn("_x", then("noise", x + hashed_normal(key("noise", *place)) * draw("noise", (0.0, p.noise))))
    far, turn = max(size) * draw("ring far", (10.0, 20.0)), 2 * math.pi * hashed_even(key("ring turn"))
    dy, dx = F.col("y") - (size[1] - 1) / 2 - far * F.sin(turn), F.col("x") - (size[2] - 1) / 2 - far * F.cos(turn)
    ring = F.floor(F.sqrt(dy * dy + dx * dx) / p.ring_width).cast("string")
    out = out.withColumn("_x", then("ring", held(x * (1 + p.ring * hashed_normal(key("ring", ring))))))
    line = F.when(hashed_even(key("stripe axis")) < 0.5, F.col("y")).otherwise(F.col("x")).cast("string")
    out = out.withColumn("_x", then("stripe", held(x * (1 + p.stripe * hashed_normal(key("stripe", line))))))
    low, high = draw("window low", p.window_low), draw("window high", p.window_high)
    out = out.withColumn("_x", then("window", held((x - low) / F.greatest(high - low, F.lit(1e-6)))))
    way = [hashed_normal(key("streak", a)) for a in AXES]
    length = F.sqrt(way[0] * way[0] + way[1] * way[1] + way[2] * way[2])
    along = (way[0] * F.col("z") + way[1] * F.col("y") + way[2] * F.col("x")) / F.greatest(length, F.lit(1e-9))
    wave = F.sin(2 * math.pi * (along / draw("streak pitch", p.pitch) + hashed_even(key("streak phase"))))
    out = out.withColumn("_x", then("streak", x + p.streak * wave))
    for i in range(p.holes):
        inside = fires(f"hole {i}")
        for a, n in zip(AXES, size, strict=True):
            extent = F.greatest(F.lit(1), F.rint(draw(f"hole {i} size {a}", p.hole) * n).cast("int"))
            first = F.floor(hashed_even(key(f"hole {i} low {a}")) * (n - extent + 1)).cast("int")
            inside = inside & (F.col(a) >= first) & (F.col(a) < first + extent)
        out = out.withColumn("_x", F.when(inside, hashed_even(key(f"hole {i} value"))).otherwise(x))
    return out.withColumn(value, x).drop("_x")
