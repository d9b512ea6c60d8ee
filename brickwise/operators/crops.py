"""Crops of a volume with their targets: every crop's voxels with intensity, surface, weight, winding and local shape, by joins of all channels at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickwise.functions import codec
from brickwise.operators.grid import AXES
from brickwise.runtime import broadcast_if_small


def rows_of_boxes(rows: DataFrame, boxes: DataFrame, cell: int, keep: list[str]) -> DataFrame:
    """(keep ..., columns of ``rows``): the rows in each box (low_*, size_*), once for every box that holds them.

    Boxes meet rows by the cells of a grid that they touch, an equi-join whatever the number of either.
    """
    keys = [f"_g{a}" for a in AXES]
    cells = boxes.select(*keep, *[f"{p}_{a}" for p in ("low", "size") for a in AXES])
    for a, k in zip(AXES, keys, strict=True):
        ends = (F.floor(c / cell).cast("int") for c in (F.col(f"low_{a}"), F.col(f"low_{a}") + F.col(f"size_{a}") - 1))
        cells = cells.withColumn(k, F.explode(F.sequence(*ends)))
    keyed = rows.withColumns({k: F.floor(F.col(a) / cell).cast("int") for a, k in zip(AXES, keys, strict=True)})
    hit = keyed.join(broadcast_if_small(cells), keys)
    for a in AXES:
        hit = hit.where((F.col(a) >= F.col(f"low_{a}")) & (F.col(a) < F.col(f"low_{a}") + F.col(f"size_{a}")))
    return hit.select(*keep, *rows.columns)


def surface_targets(mode: str, inner: Column, outer: Column, valid: Column) -> dict[str, Column]:
    """The surface targets of a mode from the codes of both faces, zero without data.

    ``faces``: both signed distances. ``body``: one that is positive inside. ``sides``: the distance to the nearer face without a sign, and whether the place is
    inside: nothing of these two changes when the faces are swapped in name and sign.
    """
    a, b = codec.decode_sdf(inner), codec.decode_sdf(outer)
    known = {"faces": {"target_in": a, "target_out": b}, "body": {"target_body": codec.body_sdf(a, b)},
        "sides": {"target_side": codec.face_distance(a, b), "inside": codec.in_body(a, b).cast("double")}}
    if mode not in known:
        raise ValueError(f"no surface mode {mode}: {', '.join(known)}")
    return {n: F.when(F.coalesce(valid > 0, F.lit(False)), c).otherwise(0.0) for n, c in known[mode].items()}


def merged_winding(fine: dict[str, Column], coarse: dict[str, Column], source: str) -> dict[str, Column]:
    """Winding channels of a source, ``valid`` among them: ``coarse``; ``fine``, zero where these aren't valid; or ``merge``, the coarse ones there instead."""
    if source == "coarse":
        return coarse
    if source not in ("fine", "merge"):
        raise ValueError(f"no winding source {source}: coarse, fine, merge")
    return {n: F.when(F.coalesce(fine["valid"] == 1, F.lit(False)), fine[n]).otherwise(coarse[n] if source == "merge" else 0) for n in fine}


def load_crops(crops: DataFrame, rows: DataFrame, patch: int, mode: str, winding: dict[str, Column], core: Column | None = None, cell: int = 64,
    more: list[str] = ()) -> DataFrame:
    """(crop, z, y, x from 0, ct in [0, 1], surface targets, surface_valid, weight, winding_*, more ...) of every crop (crop, low_*).

    ``rows`` holds all channels of a place (z, y, x, ct, sdf_in, sdf_out, faces_valid, faces_weight, ...); what ``winding`` and ``core`` say is evaluated on
    them, once for each place and not for each crop. A weight of 0 was never written and counts as 1. Where ``core`` holds, inside and outside have no
    meaning: the surface is ignored there (2, unless there is no data) and the winding has no data. Places of a crop that have no row give none.
    """
    held = F.lit(False) if core is None else F.coalesce(core, F.lit(False))
    state = F.when(held & (F.col("faces_valid") > 0), 2).otherwise(F.coalesce("faces_valid", F.lit(0)))
    wound = {f"winding_{n}": F.when(held, 0).otherwise(F.coalesce(c, F.lit(0))) if n == "valid" else c for n, c in winding.items()}
    weight = F.when(F.col("faces_weight") > 0, F.col("faces_weight").cast("double")).otherwise(1.0)
    placed = rows.select(*AXES, (F.col("ct") / 255.0).alias("ct"), *[c.alias(n) for n, c in surface_targets(mode, F.col("sdf_in"), F.col("sdf_out"),
        F.col("faces_valid")).items()], state.alias("surface_valid"), weight.alias("weight"), *[c.alias(n) for n, c in wound.items()], *more)
    boxes = crops.select("crop", *[f"low_{a}" for a in AXES], *[F.lit(patch).alias(f"size_{a}") for a in AXES])
    met = rows_of_boxes(placed, boxes, cell, ["crop", *[f"low_{a}" for a in AXES]])
    local = {a: (F.col(a) - F.col(f"low_{a}")).cast("int") for a in AXES}
    return met.withColumns(local).drop(*[f"low_{a}" for a in AXES])
