"""The two faces of sheets, found from a body and a direction at every voxel: marches along each row's own normal, as equi-joins at stepped places."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickwise.functions import codec, vectors
from brickwise.operators import aggregates, components, fields, morphology, stencil
from brickwise.operators.grid import AXES
from brickwise.runtime import materialize, merged_if_large, shuffled

NORMAL = tuple(f"n_{a}" for a in AXES)


class FaceRules(NamedTuple):
    """Lengths are voxels, intensities those of ``ct``, probabilities bytes."""

    body_above: float = 60.0
    body_sigma: float = 2.0
    close_reach: int = 6
    along_normal: bool = True
    least_component: int = 100
    thickness: tuple[float, float] = (15.0, 90.0)
    side_reach: int = 6
    contact_reach: int = 3
    clip: float = 20.0
    doubtful: tuple[int, int] = (51, 204)
    sure_near: float = 2.0


def stepped(rows: DataFrame, direction: vectors.Vec, first: int, last: int) -> DataFrame:
    """Each row's place (``_z, _y, _x``) with the places z, y, x that ``_t`` = first..last steps along its own direction round to; zero steps left out."""
    t = F.col("_t")
    spread = rows.withColumn("_t", F.explode(F.sequence(F.lit(first), F.lit(last)))).where("_t <> 0")
    places = [F.rint(F.col(a) + t * d).cast("int").alias(a) for a, d in zip(AXES, direction, strict=True)]
    return spread.select(*[F.col(a).alias(f"_{a}") for a in AXES], "_t", *places)


def _own(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"_{a}").alias(a) for a in AXES])


def contacts(rows: DataFrame, body: DataFrame, direction: vectors.Vec, steps: int) -> DataFrame:
    """``rows`` with the steps at which a march along their own direction first and last meets the body: ``first_ahead``, ``last_ahead``, and ``first_behind``,
    ``last_behind`` for the march against it; nulls where it doesn't within ``steps``."""
    hit = stepped(rows, direction, -steps, steps).join(shuffled(body.select(*AXES)), list(AXES), "left_semi")
    ahead, behind = F.when(F.col("_t") > 0, F.col("_t")), F.when(F.col("_t") < 0, -F.col("_t"))
    ends = [f(c).alias(f"{n}_{side}") for c, side in ((ahead, "ahead"), (behind, "behind")) for f, n in ((F.min, "first"), (F.max, "last"))]
    found = hit.groupBy(*[F.col(f"_{a}").alias(a) for a in AXES]).agg(*ends)
    return rows.join(shuffled(found), list(AXES), "left")


def close_along(rows: DataFrame, mask: DataFrame, direction: vectors.Vec, reach: int) -> DataFrame:
    """Places of the closing of ``mask`` by a line of ``reach`` steps either way along each row's own direction.

    A row joins if the mask is met on its line; of what has joined, a row stays if its whole line has. Places without a row neither join nor break a line,
    so that borders and gaps of the data keep what is there. Gaps of a bundle of layers close, those beside it, across the line, stay open.
    """
    if reach < 1:
        return mask.select(*AXES)
    lines = materialize(stepped(rows, direction, -reach, reach), "lines")
    met = _own(lines.join(shuffled(mask.select(*AXES)), list(AXES), "left_semi"))
    grown = materialize(met.union(mask.select(*AXES)).distinct(), "grown")
    rest = rows.select(*AXES).join(shuffled(grown), list(AXES), "left_anti")
    broken = _own(lines.join(shuffled(rest), list(AXES), "left_semi")).distinct()
    return grown.join(shuffled(broken), list(AXES), "left_anti")


def outward_normal(rows: DataFrame, normal: vectors.Vec | None, radial: vectors.Vec, least: float) -> DataFrame:
    """``rows`` with the unit normal ``n_*``: the given one where it is ``least`` long (``n_ok``), else the radial direction, turned to the radial's side."""
    found = F.lit(False) if normal is None else F.coalesce(vectors.norm(normal) >= least, F.lit(False))
    own = radial if normal is None else vectors.unit(normal)
    picked = tuple(F.when(found, c).otherwise(r) for c, r in zip(own, radial, strict=True))
    chosen = rows.withColumns({"n_ok": found, **dict(zip(NORMAL, picked, strict=True))})
    return chosen.withColumns(dict(zip(NORMAL, fields.outward(tuple(map(F.col, NORMAL)), radial), strict=True)))


def _sided(rows: DataFrame, face: DataFrame, clip: float, name: str, absent: Column, values: list[str]) -> DataFrame:
    """``rows`` with the distance to a face, positive on the side its nearest place's normal points to, within ``clip``; ``absent`` where there is no face."""
    place = [F.col(a).alias(f"at_{a}") for a in AXES]
    known = face.select(*AXES, *place, *NORMAL, *values)
    near = morphology.nearest_of_all(rows, known, [*(f"at_{a}" for a in AXES), *NORMAL, *values], "_d2", "_f_")
    off = tuple(F.col(a) - F.col(f"_f_at_{a}") for a in AXES)
    side = F.when(vectors.dot(off, tuple(F.col(f"_f_{n}") for n in NORMAL)) < 0, -1.0).otherwise(1.0)
    signed = F.coalesce(side * F.least(F.sqrt("_d2"), F.lit(clip)), absent)
    return near.withColumn(name, signed).drop("_d2", *[c for c in near.columns if c.startswith("_f_") and c[3:] not in values])


def face_labels(rows: DataFrame, radial: vectors.Vec, rules: FaceRules = FaceRules(), normal: vectors.Vec | None = None,
    least_normal: float = 0.5) -> DataFrame:
    """(z, y, x, sdf_in, sdf_out, thickness, faces_valid) for every row (z, y, x, ct, recto, data) from intensity and normals.

    The body is what the smoothed intensity leaves above a threshold, closed along the normals (or by a ball) and rid of small components. A boundary voxel
    belongs to the inner face if the body lies ahead of it along its outward normal only, to the outer face if behind it only; else its side is unknown.
    Distances to the faces are signed by the normal of the nearest face voxel and held within ``clip``; without a face they are the clip, negative for an
    outer face that is missing beside a body. ``thickness`` is twice the depth of the nearest middle voxel of a body.

    ``faces_valid`` is 0 without data, else 2 (ignored) where the normal is missing although normals are given; where the nearest face voxel is of unknown
    side and within ``side_reach``; where the nearest outer face voxel touches a body within ``contact_reach`` ahead; where the nearest body's median
    thickness is out of bounds; where ``recto`` is doubtful and no face is near; and everywhere if there is no body. Else 1. Byte codes are 0 without data.
    """
    base = materialize(outward_normal(rows, normal, radial, least_normal).select(*AXES, "ct", "recto", "data", "n_ok", *NORMAL), "face-rows")
    n = tuple(map(F.col, NORMAL))
    smooth = stencil.gaussian(base.select(*AXES, "ct"), "ct", rules.body_sigma, "_smooth")
    mask = materialize(smooth.where(F.col("_smooth") > rules.body_above).select(*AXES), "above")
    closed = close_along(base, mask, n, rules.close_reach) if rules.along_normal else morphology.close_ball(base, mask, rules.close_reach)
    sheet = materialize(components.without_small(closed, rules.least_component), "sheet")
    rest = base.select(*AXES).join(shuffled(sheet.select(*AXES)), list(AXES), "left_anti")
    deep = morphology.squared_distance(sheet, rest).withColumn("_depth", F.coalesce(F.sqrt("d2"), F.lit(float(rules.clip))))
    middle = stencil.neighbour_extreme(deep, "_depth", 1, True, "_top").where("_depth >= _top - 0.5")
    middle = materialize(middle.select(*AXES, "component", (2 * F.col("_depth")).alias("thick")), "middle")
    median = aggregates.percentiles(middle, "thick", ["component"], {"median": 0.5})
    apt = median.select("component", F.col("median").between(*rules.thickness).alias("apt"))
    near = morphology.nearest_of_all(base, middle.join(merged_if_large(apt), "component"), ["thick", "apt"], "_to_middle", "")

    edge = stencil.touching(base.join(shuffled(sheet.select(*AXES)), list(AXES), "left_semi"), rest)
    met = contacts(edge, sheet, n, max(rules.side_reach, rules.contact_reach))
    ahead, behind = (F.coalesce(F.col(f"first_{s}") <= rules.side_reach, F.lit(False)) for s in ("ahead", "behind"))
    touches = F.coalesce(F.col("first_ahead") <= rules.contact_reach, F.lit(False))
    face = F.when(ahead & ~behind, "in").when(behind & ~ahead, "out").otherwise("unknown")
    edges = materialize(met.select(*AXES, *NORMAL, face.alias("face"), touches.alias("touches")), "faces")
    inner, outer = edges.where("face = 'in'"), edges.where("face = 'out'")
    clip = F.lit(float(rules.clip))
    both = _sided(near, inner, rules.clip, "d_in", clip, [])
    both = _sided(both, outer, rules.clip, "d_out", F.when(F.col("thick").isNull(), clip).otherwise(-clip), ["touches"])
    both = stencil.distance_within(both, edges.where("face = 'unknown'"), math.ceil(rules.side_reach), "_d2")

    closest = F.least(F.abs("d_in"), F.abs("d_out"))
    unknown = F.coalesce(F.sqrt("_d2") <= closest, F.lit(False))
    touching = F.coalesce("_f_touches", F.lit(False)) & (F.abs("d_out") < rules.clip)
    doubtful = F.col("recto").between(*rules.doubtful) & (closest > rules.sure_near)
    lost = F.lit(False) if normal is None else ~F.col("n_ok")
    ignored = F.col("thick").isNull() | ~F.col("apt") | unknown | touching | doubtful | lost
    held = lambda c: F.when(F.col("data"), c).otherwise(0)
    return both.select(*AXES, held(codec.encode_sdf(F.col("d_in"), rules.clip)).alias("sdf_in"), held(codec.encode_sdf(F.col("d_out"),
        rules.clip)).alias("sdf_out"),
        held(F.least(F.lit(255), F.rint(F.coalesce("thick", F.lit(0.0)))).cast("int")).alias("thickness"),
        held(F.when(ignored, 2).otherwise(1)).alias("faces_valid"))


class BandRules(NamedTuple):
    """Codes of the bands that belong to the inner and to the outer face, one of both to each; lengths are voxels."""

    inner: tuple[int, ...] = (1, 3)
    outer: tuple[int, ...] = (2, 3)
    least_component: int = 32
    window: int = 3
    least_count: int = 6
    planarity: float = 0.5
    clip: float = 20.0


def window_moments(band: DataFrame, radius: int) -> DataFrame:
    """(z, y, x, count, m_*, m_**): number, sums and products of the places of ``band`` in the cube around every place that one reaches, as whole numbers.

    One axis after the other: each pass repeats a row 2 radius + 1 times and adds up before the shuffle.
    """
    pairs = [(a, b) for i, a in enumerate(AXES) for b in AXES[i:]]
    long = {a: F.col(a).cast("long") for a in AXES}
    out = band.select(*AXES, F.lit(1).cast("long").alias("count"), *[long[a].alias(f"m_{a}") for a in AXES], *[(long[a] * long[b]).alias(f"m_{a}{b}") for a,
        b in pairs])
    sums = ["count", *(f"m_{a}" for a in AXES), *(f"m_{a}{b}" for a, b in pairs)]
    for axis in AXES:
        moved = out.withColumn("_step", F.explode(F.sequence(F.lit(-radius), F.lit(radius))))
        places = [(F.col(a) + F.col("_step")).alias(a) if a == axis else F.col(a) for a in AXES]
        out = moved.select(*places, *sums).groupBy(*AXES).agg(*[F.sum(c).alias(c) for c in sums])
    return out


def band_normals(rows: DataFrame, band: DataFrame, radial: vectors.Vec, rules: BandRules = BandRules()) -> DataFrame:
    """``rows`` with the outward unit normal ``n_*`` of the band around each, and ``n_ok`` where it is the band's own.

    The normal is the direction in which the band's places in the window spread least, turned to the radial's side. Where there are less than
    ``least_count`` places, where they spread in no two directions, or where the least spread is over ``planarity`` of the next, it is the radial direction.
    """
    moments = rows.join(shuffled(window_moments(band, rules.window)), list(AXES), "left")
    n = F.col("count")
    spread = [(n * F.col(f"m_{a}{b}") - F.col(f"m_{a}") * F.col(f"m_{b}")) / (n * n) for a, b in (("z", "z"), ("y", "y"), ("x", "x"), ("z", "y"), ("z", "x"),
        ("y", "x"))]
    spreads = [f"_c{i}" for i in range(6)]
    known = moments.withColumns(dict(zip(spreads, spread, strict=True)))
    matrix = [F.col(c) for c in spreads]
    low, middle, _ = vectors.eigenvalues_sym3(*matrix)
    known = known.withColumns({"_low": low, "_middle": middle})
    flat = (n >= rules.least_count) & (F.col("_middle") > 1e-9) & (F.col("_low") <= rules.planarity * F.col("_middle"))
    # step by step in columns: as one expression each part would hold all before it many times, which takes the driver's memory and minutes to plan
    for name, parts in (("_along", vectors.along_eigenvector_sym3(F.col("_low"), *matrix)), ("_own", vectors.unit(tuple(F.col(f"_along_{a}") for a in AXES),
            1e-9))):
        known = known.withColumns({f"{name}_{a}": c for a, c in zip(AXES, parts, strict=True)})
    own = tuple(F.col(f"_own_{a}") for a in AXES)
    known = known.withColumn("_ok", F.coalesce(flat & (vectors.norm(own) > 0.5), F.lit(False)))
    ok, turned = F.col("_ok"), fields.outward(own, radial)
    return known.select(*rows.columns, ok.alias("n_ok"), *[F.when(ok, c).otherwise(r).alias(k) for c, r, k in zip(turned, radial, NORMAL, strict=True)])


def band_faces(rows: DataFrame, radial: vectors.Vec, rules: BandRules = BandRules()) -> DataFrame:
    """(z, y, x, sdf_in, sdf_out, thickness, faces_valid) for every row (z, y, x, band, data) from bands that are drawn along both faces.

    The faces are the crests of the inner and of the outer bands without their small components; a band of both is a part of each. Distances are signed by
    the normal of the nearest face voxel (:func:`band_normals` of all bands together). ``faces_valid`` is 0 without data, 1 within ``clip`` of both faces,
    else 2; everything is ignored, and both distances the clip, if either face is missing. ``thickness`` is the sum of both distances, not held within the
    clip, between the faces, else 0.
    """
    base = materialize(rows.select(*AXES, "band", "data", *[r.alias(f"r_{a}") for r, a in zip(radial, AXES, strict=True)]), "band-rows")
    faces = {}
    for name, codes in (("in", rules.inner), ("out", rules.outer)):
        large = components.without_small(base.where(F.col("band").isin(*codes)).select(*AXES), rules.least_component).select(*AXES)
        faces[name] = materialize(morphology.crest(base.select(*AXES), materialize(large, f"band-{name}")), f"face-{name}")
    points = base.join(shuffled(faces["in"].union(faces["out"]).distinct()), list(AXES), "left_semi")
    points = materialize(band_normals(points, base.where("band > 0"), tuple(F.col(f"r_{a}") for a in AXES), rules), "band-normals")
    both = base.select(*AXES, "data")
    for name, face in faces.items():
        face = materialize(points.join(shuffled(face), list(AXES), "left_semi"), f"normals-{name}")
        both = materialize(_sided(both, face, float("inf"), f"d_{name}", F.lit(None).cast("double"), []), f"sided-{name}")  # the next one reads it twice
    found = F.col("d_in").isNotNull() & F.col("d_out").isNotNull()
    near = found & (F.abs("d_in") <= rules.clip) & (F.abs("d_out") <= rules.clip)
    within = found & (F.col("d_in") >= 0) & (F.col("d_out") <= 0)
    held = lambda c: F.when(F.col("data"), c).otherwise(0)
    code = lambda c: held(codec.encode_sdf(F.when(found, F.col(c)).otherwise(rules.clip), rules.clip))
    thick = F.when(within, F.least(F.lit(255), F.rint(F.col("d_in") - F.col("d_out")).cast("int"))).otherwise(0)
    return both.select(*AXES, code("d_in").alias("sdf_in"), code("d_out").alias("sdf_out"), held(thick).alias("thickness"),
        held(F.when(near, 1).otherwise(2)).alias("faces_valid"))
