"""Caches of boxes of a volume: copied brick by brick, proven complete by a marker, and read instead of the source where one holds a request."""

from __future__ import annotations

import json
import math
import uuid
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickwise.operators.crops import rows_of_boxes
from brickwise.operators.grid import AXES, inside
from brickwise.streaming.builds import BrickStore, build

Box = tuple[tuple[int, int, int], tuple[int, int, int]]


class Cache(NamedTuple):
    """A store, the level of the volume that it copies, the box (low, size) that it is for and the edge of its bricks."""

    store: BrickStore
    level: int
    box: Box
    edge: int

    def _marker(self) -> str:
        return f"{self.store.path}/complete-{self.store.identity}.json"


def copy_box(cache: Cache, source: DataFrame, wave_bricks: int = 100_000, waves: int | None = None) -> bool:
    """Copy the rows of the cache's box that aren't there yet; whether the cache is complete now.

    Bricks that are done are left alone. Only once none is missing the marker is written, whole or not at all: a copy that was stopped has none, and neither
    has one of another writer's identity.
    """
    rows = source.where(inside(*cache.box))
    ran = build(cache.store, rows, lambda part: part, cache.edge, 0, wave_bricks, waves)
    if waves is not None and ran >= waves:
        return footprint(cache) is not None
    fs, name = cache.store._fs(cache._marker())
    _, beside = cache.store._fs(f"{cache.store.path}/.{uuid.uuid4().hex}")
    out = fs.create(beside, False)
    out.write(bytearray(json.dumps({"level": cache.level, "low": cache.box[0], "size": cache.box[1]}).encode()))
    out.close()
    if not fs.rename(beside, name) and not fs.exists(name):
        raise OSError(f"{cache._marker()} could not be written")
    return True


def footprint(cache: Cache) -> Box | None:
    """The box that a complete cache holds, as its marker says; None without a marker that can be read."""
    fs, name = cache.store._fs(cache._marker())
    if not fs.exists(name):
        return None
    stream = None
    try:
        stream = fs.open(name)
        held = json.loads(cache.store.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        return tuple(held["low"]), tuple(held["size"])
    except (ValueError, KeyError, Py4JJavaError):
        return None  # proves nothing
    finally:
        if stream is not None:
            stream.close()


def smallest_cover(caches: list[Cache], low: tuple[Column, Column, Column], size: tuple[Column, Column, Column], level: Column) -> Column:
    """The place in the list of the smallest complete cache of a level that holds a box as a whole, of equals the first; null if none does.

    The list is what a program has opened: it becomes a condition for each, evaluated where the requests are.
    """
    found = [(math.prod(box[1]), i, c, box) for i, c in enumerate(caches) if (box := footprint(c))]
    out = F.lit(None).cast("int")
    for _, i, cache, (first, extent) in sorted(found, key=lambda f: f[:2], reverse=True):
        holds = level == cache.level
        for lo, n, a, m in zip(low, size, first, extent, strict=True):
            holds = holds & (lo >= a) & (lo + n <= a + m)
        out = F.when(holds, i).otherwise(out)
    return out


def read_through(caches: list[Cache], requests: DataFrame, source: DataFrame, edge: int) -> DataFrame:
    """(request, cache, z, y, x, ...): the source's rows in the box of every request (request, level, low_*, size_*), each box from the smallest complete
    cache that holds it, else from the source (cache null). ``edge``: cells by which requests meet the source's rows.

    A request meets the rows of the bricks that its box touches by an equi-join, whatever the number of either.
    """
    columns = lambda n: tuple(F.col(f"{n}_{a}") for a in AXES)
    asked = requests.withColumn("cache", smallest_cover(caches, columns("low"), columns("size"), F.col("level")))

    def met(rows: DataFrame, wanted: DataFrame, cell: int) -> DataFrame:
        return rows_of_boxes(rows, wanted, cell, ["request", "cache"])

    out = met(source, asked.where("cache is null"), edge)
    for i, cache in enumerate(caches):
        if footprint(cache):
            out = out.unionByName(met(cache.store.read().select(*source.columns), asked.where(F.col("cache") == i), cache.edge))
    return out
