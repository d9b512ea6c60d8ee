"""Connected components of an undirected graph, as alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickwise.operators.grid import AXES, around, cube
from brickwise.runtime import discard, materialize, merged_if_large, shuffled


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root): for every node that has an edge to another node, the smallest node it can reach.

    Alternates two contractions: every node hands its larger neighbours to its smallest neighbour,
    then every node hands its smaller neighbours to the smallest of them. Both keep components as they are
    and end in stars around the smallest node. Work per round is linear in the edges; the number of rounds
    grows with the logarithm of the longest path. Each round is written to the shared folder and
    the one before deleted.

    Self-loops, repeated edges and edges with a null end are ignored; no edges give no rows.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u",
        "v").alias("v")).distinct()
    current = materialize(pairs, "components")
    before = _signature(current)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        last, current = current, materialize(_small_star(_large_star(current, before[0]), before[0]), "components")
        discard(last)
        after = _signature(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _signature(pairs: DataFrame) -> tuple[int, int]:
    row = pairs.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def _large_star(pairs: DataFrame, rows: int) -> DataFrame:
    both = pairs.union(pairs.select("v", "u"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(merged_if_large(low, rows), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(pairs: DataFrame, rows: int) -> DataFrame:
    low = pairs.groupBy("u").agg(F.min("v").alias("m"))
    moved = pairs.join(merged_if_large(low, rows), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def labelled(mask: DataFrame) -> DataFrame:
    """Places of ``mask`` with ``component``: the smallest number, z 2^40 + y 2^20 + x, of a place that 26-neighbours connect each with."""
    number = F.col("z").cast("long") * (1 << 40) + F.col("y").cast("long") * (1 << 20) + F.col("x")
    keyed = mask.select(*AXES, number.alias("id"))
    ahead = [o for o in cube(1) if o > (0, 0, 0)]
    edges = around(keyed, ahead, ("id",)).withColumnRenamed("id", "a").join(shuffled(keyed.withColumnRenamed("id", "b")), list(AXES)).select("a", "b")
    roots = connected_components(edges).withColumnRenamed("node", "id")
    return keyed.join(shuffled(roots), "id", "left").select(*AXES, F.coalesce("root", "id").alias("component"))


def without_small(mask: DataFrame, least: int) -> DataFrame:
    """:func:`labelled` places of components that have ``least`` places or more."""
    rows = materialize(labelled(mask), "labelled")
    large = rows.groupBy("component").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    return rows.join(merged_if_large(large.drop("_n")), "component", "left_semi").select(*AXES, "component")
