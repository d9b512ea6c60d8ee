"""Fields of lines, normals and phases on rows: line-field channels, sheet normals, fibre targets, propagated signs."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickwise.functions import vectors
from brickwise.functions.codec import line_angle, line_codes
from brickwise.operators import joins, stencil
from brickwise.operators.grid import AXES

#: The coordinate planes in which a line is coded, by the axes that its angle runs from and to.
PLANES = (("x", "y"), ("x", "z"), ("y", "z"))
EPS = 1e-12
#: Names of the six channels: two for each plane, planes named for the axis they leave out.
LINE_CHANNELS = ("dir0_z", "dir1_z", "dir0_y", "dir1_y", "dir0_x", "dir1_x")


def encode_line_field(normal: vectors.Vec) -> list[Column]:
    """The six channels of a normal in z, y, x order: for each plane the codes of the doubled angle of its part in the plane."""
    at = dict(zip(("z", "y", "x"), normal, strict=True))
    return [code.alias(name) for (a, b), names in zip(PLANES, zip(LINE_CHANNELS[::2], LINE_CHANNELS[1::2], strict=True), strict=True) for code,
        name in zip(line_codes(at[a], at[b]), names, strict=True)]


def _misfit(n: dict[str, Column]) -> Column:
    """How far the channels of a line are from the row's, each plane weighted by the squared length of the line in it."""
    total = F.lit(0.0)
    for k, (a, b) in enumerate(PLANES):
        first, second = line_codes(n[a], n[b])
        off = (first - F.col(LINE_CHANNELS[2 * k])) ** 2 + (second - F.col(LINE_CHANNELS[2 * k + 1])) ** 2
        total = total + (n[a] ** 2 + n[b] ** 2) * off
    return total


def _vector(rows: DataFrame, name: str, parts: dict[str, Column]) -> DataFrame:
    return rows.withColumns({f"{name}_{a}": c for a, c in parts.items()})


def _parts(name: str) -> dict[str, Column]:
    return {a: F.col(f"{name}_{a}") for a in AXES}


def _dot(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def _aligned(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """All vectors turned to the side of the first."""
    for name in names[1:]:
        sign = F.when(_dot(_parts(names[0]), _parts(name)) >= 0, 1.0).otherwise(-1.0)
        rows = _vector(rows, name, {a: c * sign for a, c in _parts(name).items()})
    return rows


def decode_line_field(rows: DataFrame, name: str = "n") -> DataFrame:
    """``rows`` with the six line channels, and the unit normal that they mean (``n_z``, ``n_y``, ``n_x``, of either sign), ``agreement`` of the
    planes (0 to 1) and ``misfit``, the weighted difference of the normal's own channels.

    Any two planes give a candidate, scaled so that their common axis agrees. The candidates are averaged by how well they fit all channels; that
    average says how long the line is in each plane, and the candidates are added again by the lengths in their two planes.
    """
    kept = rows.columns
    out = rows.withColumns({f"_t{k}": line_angle(F.col(LINE_CHANNELS[2 * k]), F.col(LINE_CHANNELS[2 * k + 1])) for k in range(3)})
    part = {(k, axis): (F.cos if axis == a else F.sin)(f"_t{k}") for k, (a, b) in enumerate(PLANES) for axis in (a, b)}
    pairs = [(0, 1), (0, 2), (1, 2)]
    names = [f"_c{i}" for i in range(3)]
    for candidate, (p, q) in zip(names, pairs, strict=True):
        common = next(a for a in PLANES[p] if a in PLANES[q])
        one, two = next(a for a in PLANES[p] if a != common), next(a for a in PLANES[q] if a != common)
        out = _vector(out, candidate, {common: part[p, common] * part[q, common], one: part[p, one] * part[q, common], two: part[q, two] * part[p, common]})
    out = _aligned(out, names)
    out = out.withColumns({f"_w{i}": 1 / (_misfit(_parts(c)) + EPS) for i, c in enumerate(names)})
    out = _vector(out, "_e", {a: sum((F.col(f"_w{i}") * F.col(f"{c}_{a}") for i, c in enumerate(names)), F.lit(0.0)) for a in AXES})
    length = F.sqrt(_dot(_parts("_e"), _parts("_e"))) + EPS
    out = _vector(out, "_e", {a: c / length for a, c in _parts("_e").items()})
    out = out.withColumns({f"_l{k}": F.sqrt(F.col(f"_e_{a}") ** 2 + F.col(f"_e_{b}") ** 2 + EPS) for k, (a, b) in enumerate(PLANES)})
    for candidate, (p, q) in zip(names, pairs, strict=True):
        out = _vector(out, candidate, {a: c * (F.col(f"_l{p}") * F.col(f"_l{q}")) for a, c in _parts(candidate).items()})
    out = _aligned(out, names)
    out = _vector(out, "_s", {a: F.col(f"_c0_{a}") + F.col(f"_c1_{a}") + F.col(f"_c2_{a}") for a in AXES})
    whole = sum((F.sqrt(_dot(_parts(c), _parts(c))) for c in names), F.lit(EPS))
    out = out.withColumn("_m", F.sqrt(_dot(_parts("_s"), _parts("_s")))).withColumn("agreement", F.col("_m") / whole)
    out = _vector(out, name, {a: c / (F.col("_m") + EPS) for a, c in _parts("_s").items()})
    n = _parts(name)
    out = out.withColumn("misfit", F.sqrt(_misfit(n) / (4 * _dot(n, n) + EPS)))
    return out.select(*kept, *[f"{name}_{a}" for a in AXES], "agreement", "misfit")


def permuted(v: vectors.Vec, axes: tuple[int, int, int], signs: tuple[int, int, int]) -> vectors.Vec:
    """A vector under a signed permutation: part i of the result is ``signs[i]`` times part ``axes[i]``."""
    return tuple(v[a] * float(s) for a, s in zip(axes, signs, strict=True))


def gradient(rows: DataFrame, value: str, name: str = "g") -> DataFrame:
    """``rows`` with the gradient of a value: half differences, one-sided where one neighbour is missing, zero where both are."""
    out = rows
    for a in AXES:
        after, before = stencil.at_offset(value, a, 1), stencil.at_offset(value, a, -1)
        here = F.col(value)
        step = F.coalesce((after - before) / 2, after - here, here - before, F.lit(0.0))
        out = out.withColumn(f"{name}_{a}", step)
    return out


def sheet_normal(rows: DataFrame, low: float, high: float, fallback: vectors.Vec | None = None, prefer_fallback: bool = False) -> DataFrame:
    """``rows`` with the unit normal ``n_*`` of the gradient ``g_*`` where its length is within bounds, else of the fallback where that is longer
    than a half (or the fallback first); zero and ``n_ok`` false where neither is."""
    g = tuple(F.col(f"g_{a}") for a in AXES)
    length = vectors.norm(g)
    steep = (length >= low) & (length <= high)
    own = vectors.unit(g)
    if fallback is None:
        use, other = F.lit(False), own
    else:
        good = vectors.norm(fallback) > 0.5
        use, other = (good if prefer_fallback else ~steep & good), vectors.unit(fallback)
    ok = steep | use
    picked = {f"n_{a}": F.when(ok, F.when(use, o).otherwise(c)).otherwise(0.0) for a, c, o in zip(AXES, own, other, strict=True)}
    return rows.withColumns({**picked, "n_ok": ok})


def outward(normal: vectors.Vec, outside: vectors.Vec) -> vectors.Vec:
    """A vector turned to the side of another."""
    away = vectors.dot(normal, outside) < 0
    return tuple(F.when(away, -c).otherwise(c) for c in normal)


#: Codes of a hand-drawn band of fibres: along the axis's normal, along the axis, left out.
BAND_ACROSS, BAND_ALONG, BAND_LEFT_OUT = 1, 2, 3


def swapped_band(band: Column) -> Column:
    return F.when(band == BAND_ACROSS, BAND_ALONG).when(band == BAND_ALONG, BAND_ACROSS).otherwise(band)


def axis_is_swapped(matrix: list[list[float]], axis: tuple[float, float, float] = (1.0, 0.0, 0.0), most: float = 45.0) -> bool:
    """Whether a linear map turns an axis by more than so many degrees, either sense counting as the same axis."""
    image = [sum(m * a for m, a in zip(row[:3], axis, strict=True)) for row in matrix[:3]]
    inner = abs(sum(i * a for i, a in zip(image, axis, strict=True)))
    return inner / max(math.hypot(*image) * math.hypot(*axis), EPS) < math.cos(math.radians(most)) - 1e-9


def classes_of_direction(rows: DataFrame, strength: str, along: vectors.Vec, across: vectors.Vec) -> DataFrame:
    """``rows`` with the two class probabilities of a direction ``d_*``: its strength times its part along each basis vector, whatever the sign."""
    d = _parts("d")
    out = rows.withColumn("_ld", F.sqrt(_dot(d, d)))
    part = lambda v: F.abs(_dot(d, dict(zip(AXES, v, strict=True)))) / F.col("_ld")
    return out.withColumns({n: F.when(F.col("_ld") > 1e-6, F.col(strength) * part(v)).otherwise(0.0) for n, v in (("p_along", along), ("p_across", across))})


def fibre_basis(rows: DataFrame, normal: vectors.Vec, axis: vectors.Vec) -> tuple[DataFrame, vectors.Vec, vectors.Vec]:
    """``rows`` with the basis vectors along and across the axis in the plane of a normal, zero where one is missing (``_ok`` false), and both.

    Computed in steps, each of which the next uses by name: nested, the expressions would grow with every use.
    """
    n = tuple(F.col(f"_n_{a}") for a in AXES)
    out = _vector(rows, "_n", dict(zip(AXES, normal, strict=True))).withColumn("_along", vectors.dot(axis, n))
    out = _vector(out, "_rv", dict(zip(AXES, vectors.minus(axis, vectors.scale(n, F.col("_along"))), strict=True)))
    out = _vector(out, "_rh", dict(zip(AXES, vectors.cross_zyx(n, axis), strict=True)))
    out = out.withColumns({f"_l{k}": F.sqrt(_dot(_parts(f"_r{k}"), _parts(f"_r{k}"))) for k in "vh"})
    out = out.withColumn("_ok", (F.col("_lv") > 1e-3) & (F.col("_lh") > 1e-3))
    for k in "vh":
        out = _vector(out, f"_{k}", {a: F.when(F.col("_ok"), c / F.col(f"_l{k}")).otherwise(0.0) for a, c in _parts(f"_r{k}").items()})
    return out, tuple(F.col(f"_v_{a}") for a in AXES), tuple(F.col(f"_h_{a}") for a in AXES)


def fibre_targets(rows: DataFrame, p_along: Column, p_across: Column, normal: vectors.Vec, valid: Column, band: Column, axis: vectors.Vec,
    band_weight: float = 5.0) -> DataFrame:
    """``rows`` with direction ``d_*``, ``strength``, ``target_valid`` and ``weight``; the band's classes replace the probabilities', and its third leaves a row out."""
    out, v, h = fibre_basis(rows, normal, axis)
    out = out.withColumns({"_band": band, "_pv": p_along, "_ph": p_across})
    out = _vector(out, "_r", {a: F.col("_pv") * c + F.col("_ph") * d for a, c, d in zip(AXES, v, h, strict=True)})
    drawn = F.col("_band").isin(BAND_ACROSS, BAND_ALONG)
    allowed = F.when(F.col("_band") == BAND_LEFT_OUT, F.lit(False)).otherwise(F.col("_ok") & ((valid == 1) | drawn))
    out = out.withColumns({"_lr": F.sqrt(_dot(_parts("_r"), _parts("_r"))), "_drawn": drawn, "_fits": allowed})
    drawn, fits, s = F.col("_drawn"), F.col("_fits"), F.greatest("_pv", "_ph")
    unit = [F.when(F.col("_lr") > 1e-6, F.col(f"_r_{a}") / F.col("_lr")).otherwise(0.0) for a in AXES]
    chosen = [F.when(F.col("_band") == BAND_ALONG, a).when(F.col("_band") == BAND_ACROSS, b).otherwise(c) for a, b, c in zip(v, h, unit, strict=True)]
    facts = {f"d_{a}": F.when(fits, c).otherwise(0.0) for a, c in zip(AXES, chosen, strict=True)}
    facts |= {"strength": F.when(fits, F.when(drawn, 1.0).otherwise(s)).otherwise(0.0), "target_valid": fits.cast("int"), "weight": F.when(drawn,
        band_weight).otherwise(1.0)}
    return out.withColumns(facts).select(*rows.columns, *facts)


def tangents(layers: DataFrame, points: DataFrame, at: str, values: tuple[str, str], reach: float) -> DataFrame:
    """``layers`` (rows with a place ``at``) with the unit tangent ``t_z``, ``t_y``, ``t_x`` of an axis given by control points: the symmetric difference over ``reach`` to either side."""
    both = layers.select(at).distinct().withColumn("_side", F.explode(F.array(F.lit(-1), F.lit(1)))).withColumn("_at",
        F.col(at).cast("double") + F.col("_side") * reach)
    moved = both.withColumnRenamed(at, "_place").withColumnRenamed("_at", at)
    held = joins.as_of_interpolated(moved, points.withColumn(at, F.col(at).cast("double")), at, list(values))
    ends = held.groupBy("_place").agg(*[F.sum(F.col("_side") * F.col(v)).alias(f"_{v}") for v in values])
    run = F.lit(2.0 * reach)
    length = F.sqrt(run * run + F.col(f"_{values[0]}") ** 2 + F.col(f"_{values[1]}") ** 2)
    found = ends.select(F.col("_place").alias(at), (run / length).alias("t_z"), (F.col(f"_{values[0]}") / length).alias("t_y"),
        (F.col(f"_{values[1]}") / length).alias("t_x"))
    return layers.join(found, at)


def propagated_sign(rows: DataFrame, slope: str, least: float, rounds: int = 4) -> DataFrame:
    """``rows`` with ``sign`` of a slope; where it is flatter than ``least``, the sign of the sum of the signs around, round after round; 1 where none is found."""
    out = rows.withColumn("sign", F.when(F.abs(slope) < least, 0).otherwise(F.signum(slope).cast("int")))
    for _ in range(rounds):
        around = stencil.box_mean(out, "sign", 1, "_mean").select(*AXES, F.rint(F.col("_mean") * 27).alias("_sum"))
        out = out.join(around, list(AXES)).withColumn("sign", F.when(F.col("sign") == 0, F.signum("_sum").cast("int")).otherwise(F.col("sign"))).drop("_sum")
    return out.withColumn("sign", F.when(F.col("sign") == 0, 1).otherwise(F.col("sign")))
