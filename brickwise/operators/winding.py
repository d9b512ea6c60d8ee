"""Winding of sheets between two faces: a phase that the nearest measurements of thickness and gap scale, and a coarse field as its prior."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickwise.functions import codec, vectors
from brickwise.operators import fields, joins, morphology
from brickwise.operators.grid import AXES
from brickwise.runtime import materialize, shuffled


class WindingRules(NamedTuple):
    """Lengths are voxels. ``snap``: turns by which phase and prior may differ; None: the prior doesn't gate."""

    clip: float = 20.0
    period: tuple[float, float] = (6.0, 160.0)
    saturated: float = 0.5
    slope: tuple[float, float] = (0.5, 1.5)
    least: float = 0.5
    offset: float = 0.0
    snap: float | None = None
    supervised_only: bool = True


def masked_upsample(fine: DataFrame, coarse: DataFrame, values: list[str], valid: str, factor: int, prefix: str = "prior_") -> DataFrame:
    """``fine`` with each coarse value between the eight coarse voxels around, of which only those with ``valid`` 1 count: ``prior_*``, zero where they have
    less than half of the weight; and ``prior_valid``, that of the coarse voxel which covers the fine one, 0 where the values are zero or there is none.

    Coarse voxel i covers fine ones [i f, (i + 1) f). Beyond the coarse data the nearest voxels take the missing ones' weight.
    """
    corners = []
    at = {a: (F.col(a) + 0.5) / factor - 0.5 for a in AXES}
    for bits in range(8):
        near = dict(zip(AXES, (bits >> k & 1 for k in (2, 1, 0)), strict=True))
        place = [(F.floor(at[a]).cast("int") + near[a]).alias(f"_c{a}") for a in AXES]
        share = [at[a] - F.floor(at[a]) if near[a] else 1 - (at[a] - F.floor(at[a])) for a in AXES]
        corners.append(F.struct(*place, (share[0] * share[1] * share[2]).alias("_w")))
    spread = fine.select(*AXES, F.explode(F.array(*corners)).alias("_k")).select(*AXES, "_k.*").where("_w > 0")
    source = coarse.select(*[F.col(a).alias(f"_c{a}") for a in AXES], (F.col(valid) == 1).alias("_m"), *[F.col(v).alias(f"_v_{v}") for v in values])
    met = spread.join(shuffled(source), [f"_c{a}" for a in AXES])
    counted = F.when(F.col("_m"), F.col("_w")).otherwise(0.0)
    sums = met.groupBy(*AXES).agg(F.sum("_w").alias("_all"), F.sum(counted).alias("_part"),
        *[F.sum(counted * F.col(f"_v_{v}")).alias(f"_v_{v}") for v in values])
    known = F.col("_part") >= 0.5 * F.col("_all")
    found = sums.select(*AXES, known.alias("_known"), *[F.when(known, F.col(f"_v_{v}") / F.col("_part")).otherwise(0.0).alias(prefix + v) for v in values])
    covered = joins.coarse_join(fine, coarse.select(*AXES, F.col(valid).alias("_state")), factor)
    both = covered.join(shuffled(found), list(AXES), "left")
    state = F.when(F.coalesce("_known", F.lit(False)), F.coalesce("_state", F.lit(0))).otherwise(0)
    return both.select(*fine.columns, *[F.coalesce(prefix + v, F.lit(0.0)).alias(prefix + v) for v in values], state.alias(prefix + "valid"))


def phase_of(sine: Column, cosine: Column) -> Column:
    """Turns in [0, 1) of an angle."""
    return F.pmod(F.atan2(sine, cosine) / (2 * math.pi), F.lit(1.0))


def nearest_turn(phase: Column, prior: Column) -> Column:
    """The winding number of a phase in turns whose whole turns are the ones nearest to a prior winding number."""
    return phase + F.rint(prior - phase)


def fine_winding(rows: DataFrame, radial: vectors.Vec, rules: WindingRules = WindingRules(), prior_normal: vectors.Vec | None = None,
    prior_phase: Column | None = None, prior_valid: Column | None = None) -> DataFrame:
    """(z, y, x, sine, cosine, density, n_z, n_y, n_x, conf, valid, phase, period) of rows (z, y, x, sdf_in, sdf_out, faces_valid): bytes as in the stores,
    and the phase and period behind them.

    Where both distances are known, their difference is the thickness inside a sheet and minus the gap between sheets. Each voxel takes both from the
    nearest place that measures them, however far; their sum is its period, and the inner distance over the period its phase, zero at the inner face. The
    normal is the sum of the gradients of the distances whose slopes are plausible, ``conf`` how far these agree; it is turned outward, to the prior's
    normal or the radial direction. Valid are voxels with data, supervised faces, an inner distance that isn't saturated, a period within bounds and a
    normal; with ``snap`` also only those whose phase is that near to the prior's, where that is valid, and ``conf`` falls off with the difference. Invalid
    voxels have codes of zero.
    """
    inner, outer = (codec.decode_sdf(F.col(f"sdf_{s}"), rules.clip) for s in ("in", "out"))
    data = (F.col("sdf_in") > 0) & (F.col("sdf_out") > 0) & (F.col("faces_valid") > 0)
    full = lambda c: F.abs(c) >= rules.clip - rules.saturated
    own = {"_in": inner, "_out": outer, "_data": F.coalesce(data, F.lit(False)), "_full_in": full(inner), "_full_out": full(outer)}
    if prior_normal is not None:
        own |= {f"_p{a}": c for a, c in zip(AXES, prior_normal, strict=True)}
    if prior_phase is not None:
        own |= {"_phase": prior_phase, "_pv": prior_valid}
    base = materialize(rows.withColumns({**own, **{f"_r{a}": c for a, c in zip(AXES, radial, strict=True)}}), "winding-rows")
    gap = F.col("_in") - F.col("_out")
    known = base.where("_data and not _full_in and not _full_out").select(*AXES, gap.alias("apart"))
    thick = morphology.nearest_of_all(base, known.where(F.col("apart") > rules.least), ["apart"], "_d", "_t_").drop("_d")
    thick = materialize(thick, "winding-thickness")  # read twice: for the box around and for the rows
    both = morphology.nearest_of_all(thick, known.where(F.col("apart") < -rules.least), ["apart"], "_d", "_g_").drop("_d")
    raw = F.col("_t_apart") - F.col("_g_apart")
    sloped = both.withColumn("_period", raw)
    for c in ("in", "out"):
        sloped = fields.gradient(sloped, f"_{c}", f"_s{c}")
    votes = {}
    for c in ("in", "out"):
        g = tuple(F.col(f"_s{c}_{a}") for a in AXES)
        length = vectors.norm(g)
        counts = length.between(*rules.slope) & F.col("_data") & ~F.col(f"_full_{c}")
        votes[c] = (tuple(F.when(counts, p).otherwise(0.0) for p in g), F.when(counts, length).otherwise(0.0))
    total = tuple(a + b for a, b in zip(votes["in"][0], votes["out"][0], strict=True))
    voted = sloped.withColumns({**{f"_n{a}": c for a, c in zip(AXES, total, strict=True)}, "_lengths": votes["in"][1] + votes["out"][1]})
    n, away = tuple(F.col(f"_n{a}") for a in AXES), tuple(F.col(f"_r{a}") for a in AXES)
    length = vectors.norm(n)
    has = length > 1e-3
    if prior_normal is not None:
        told = tuple(F.col(f"_p{a}") for a in AXES)
        away = tuple(F.when(vectors.norm(told) >= 0.5, t).otherwise(r) for t, r in zip(told, away, strict=True))
    turned = fields.outward(tuple(F.when(has, c / length).otherwise(r) for c, r in zip(n, away, strict=True)), away)
    held = F.greatest(F.lit(rules.period[0]), F.least(F.lit(rules.period[1]), F.col("_period")))
    phase = F.pmod(F.col("_in") / held + rules.offset, F.lit(1.0))
    conf = F.when(has, F.least(F.lit(1.0), length / F.greatest(F.col("_lengths"), F.lit(1e-6)))).otherwise(0.0)
    face = F.col("faces_valid") == 1 if rules.supervised_only else F.col("faces_valid") > 0
    valid = F.col("_data") & face & ~F.col("_full_in") & F.coalesce(F.col("_period").between(*rules.period), F.lit(False)) & has
    out = voted.withColumns({"phase": phase, "period": held, "_conf": conf, "_valid": valid, **{f"_o{a}": c for a, c in zip(AXES, turned, strict=True)}})
    if rules.snap is not None:
        off = F.abs(F.col("_phase") - F.col("phase") - F.rint(F.col("_phase") - F.col("phase")))
        near = F.coalesce((F.col("_pv") == 1) & (off < rules.snap), F.lit(False))
        out = out.withColumns({"_conf": F.col("_conf") * F.greatest(F.lit(0.0), 1 - off / rules.snap), "_valid": F.col("_valid") & near})
    shown = lambda c, otherwise=0: F.when(F.col("_valid"), c).otherwise(otherwise)
    angle = F.col("phase") * (2 * math.pi)
    signed = lambda c: shown(codec.encode_signed(c), codec.encode_signed(F.lit(0.0)))
    return out.select(*AXES, signed(F.sin(angle)).alias("sine"), signed(F.cos(angle)).alias("cosine"),
        shown(codec.encode_density(1 / F.col("period"))).alias("density"),
        *[signed(F.col(f"_o{a}")).alias(f"n_{a}") for a in AXES], shown(codec.encode_prob(F.col("_conf"))).alias("conf"),
            F.col("_valid").cast("int").alias("valid"),
        "phase", "period")
