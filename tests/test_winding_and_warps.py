"""Fine winding on stacks of sheets, and warps whose result is known."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brickwise.functions import codec
from brickwise.operators import crops, intensity, warp, winding

SIZE = (5, 4, 3)


def boxes(spark, ids=(1, None)):
    draw = np.random.default_rng(2)
    rows = [(b, z, y, x, *[float(v) for v in draw.normal(size=5)], int(draw.integers(0,
        3))) for b in ids for z in range(SIZE[0]) for y in range(SIZE[1]) for x in
        range(SIZE[2])]
    return spark.createDataFrame(rows, "box long, z int, y int, x int, v double, d double, n_z double, n_y double, n_x double, valid int")


def drawn(rows, w, **more):
    rows = rows.withColumns({f"t_{a}": F.col(f"n_{a}") for a in "zyx"}).withColumn("s", F.col("v"))
    found = warp.warped(rows, SIZE, w, ["v"], ["s"], ["d"], ["t"], ["n"], **more)
    return {(r.box, r.z, r.y, r.x): r for r in found.collect()}


def test_the_identity_gives_the_rows_again(spark):
    rows = boxes(spark)
    for w in (warp.Warp(), warp.Warp(magnitude=1e-13)):
        found = drawn(rows, w)
        assert len(found) == rows.count()
        for r in rows.collect():
            got = found[r.box, r.z, r.y, r.x]
            n = np.array([r.n_z, r.n_y, r.n_x]) / np.linalg.norm([r.n_z, r.n_y, r.n_x])
            assert got.valid == r.valid and abs(got.v - r.v) < 1e-9
            if r.valid == 1:
                assert np.allclose([got.s, got.d, got.n_z, got.n_y, got.n_x, got.t_z, got.t_y, got.t_x], [r.v, r.d, *n, *n], atol=1e-6)


def test_a_flip_moves_places_and_turns_vectors(spark):
    rows = boxes(spark)
    found = drawn(rows, warp.Warp([[-1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]))
    for r in rows.collect():
        got = found[r.box, SIZE[0] - 1 - r.z, r.y, r.x]
        assert got.valid == r.valid and abs(got.v - r.v) < 1e-9
        if r.valid == 1:
            n = np.array([-r.n_z, r.n_y, r.n_x]) / np.linalg.norm([r.n_z, r.n_y, r.n_x])
            assert np.allclose([got.t_z, got.t_y, got.t_x, got.n_z, got.n_y, got.n_x], [*n, *n], atol=1e-6)


def test_scale_rules_and_places_outside(spark):
    rows = boxes(spark).withColumns({"valid": F.lit(1), "d": F.lit(2.0)})
    small = drawn(rows, warp.Warp([[0.5, 0.0, 0.0], [0.0, 0.5, 0.0], [0.0, 0.0, 0.5]]), clip=2.0)
    middle = small[1, 2, 1, 1]
    assert abs(middle.d - 1.0) < 1e-9 and middle.valid == 2  # was at the clip
    assert small[1, 0, 0, 0].valid == 0  # its origin is outside
    stretched = drawn(rows.withColumns({"n_z": F.lit(1.0), "n_y": F.lit(1.0), "n_x": F.lit(0.0)}), warp.Warp([[2.0, 0, 0], [0, 1.0, 0], [0, 0, 1.0]]))[1, 2,
        1, 1]
    assert np.allclose([stretched.t_z, stretched.t_y], np.array([2, 1]) / np.sqrt(5)) and np.allclose([stretched.n_z, stretched.n_y], np.array([1,
        2]) / np.sqrt(5))


def test_elastic_fields_are_drawn_by_box_and_bend_normals(spark):
    rows = boxes(spark, (1, 2, None)).withColumn("valid", F.lit(1))
    w = warp.Warp(magnitude=0.6, grid=3, seed="a")
    placed = {(r.box, r.z, r.y, r.x): r for r in warp.origins(rows.select("box", "z", "y", "x"), SIZE, w).collect()}
    again = {(r.box, r.z, r.y, r.x): r.p_z for r in warp.origins(rows.select("box", "z", "y", "x").orderBy(F.desc("x")), SIZE, w).collect()}
    assert again == {k: r.p_z for k, r in placed.items()}
    assert placed[1, 2, 1, 1].p_z != placed[2, 2, 1, 1].p_z
    for k in ((1, 1, 1, 0), (None, 2, 2, 1)):  # the slopes are those of the origins
        b, z, y, x = k
        ahead = placed[b, z, y, x + 1]
        if int(x * 2 / (SIZE[2] - 1)) == int((x + 1) * 2 / (SIZE[2] - 1)) or x == 0:
            here = placed[k]
            assert np.isclose(ahead.p_z - here.p_z, here.j_02, atol=1e-9) and np.isclose(ahead.p_x - here.p_x, here.j_22, atol=1e-9)
    bent = drawn(rows.withColumns({"n_z": F.lit(1.0), "n_y": F.lit(0.0), "n_x": F.lit(0.0)}), w)
    r, j = bent[1, 2, 1, 1], placed[1, 2, 1, 1]
    n = np.array([j.j_00, j.j_01, j.j_02])
    assert np.allclose([r.n_z, r.n_y, r.n_x], n / np.linalg.norm(n), atol=1e-6)
    t = np.linalg.inv([[j[f"j_{a}{b}"] for b in range(3)] for a in range(3)])[:, 0]
    assert np.allclose([r.t_z, r.t_y, r.t_x], t / np.linalg.norm(t), atol=1e-6)
    assert len(drawn(rows.limit(0), w)) == 0


def stack(spark, layers=60, thick=5, gap=7):
    """Sheets of 5 voxels with gaps of 7, along z: distances to the inner and outer face of the nearest sheet."""
    period = thick + gap
    near = lambda z, at: min((z - k * period - at for k in range(-1, layers // period + 2)), key=abs)
    rows = []
    for z in range(layers):
        rows += [(z, y, x, float(near(z, 0)), float(near(z, thick)), 1) for y in range(3) for x in range(3)]
    frame = spark.createDataFrame(rows, "z int, y int, x int, i double, o double, faces_valid int")
    code = lambda c: codec.encode_sdf(F.col(c), 12.7)
    return frame.select("z", "y", "x", code("i").alias("sdf_in"), code("o").alias("sdf_out"), "faces_valid")


RULES = winding.WindingRules(clip=12.7, period=(6.0, 40.0), saturated=0.2)


def test_turns_grow_along_a_ray_and_the_density_is_the_period(spark):
    up = (F.lit(1.0), F.lit(0.0), F.lit(0.0))
    rows = stack(spark)
    found = winding.fine_winding(rows, up, RULES).where("y = 1 and x = 1").orderBy("z").collect()
    turns = spark.createDataFrame([(r.z, r.phase, r.z / 12 + 0.2) for r in found], "z int, phase double, prior double")
    wound = [r.w for r in turns.select("z", winding.nearest_turn(F.col("phase"), F.col("prior")).alias("w")).orderBy("z").collect()]
    assert np.allclose(np.diff(wound), 1 / 12, atol=1e-9) and all(np.diff(wound) > 0)
    inside = [r for r in found if r.valid == 1]
    assert len(inside) > 40 and {r.density for r in inside} == {83} and {(r.n_z, r.n_y, r.n_x) for r in inside} == {(255, 128, 128)}
    down = winding.fine_winding(rows, tuple(-c for c in up), RULES).where("valid = 1").first()
    assert (down.n_z, down.n_y) == (0, 128)


def test_validity_of_the_fine_winding(spark):
    up = (F.lit(1.0), F.lit(0.0), F.lit(0.0))
    rows = stack(spark).withColumn("faces_valid", F.when(F.col("x") == 0, 0).when(F.col("x") == 1, 2).otherwise(1))
    by = lambda frame: {r.x: r.n for r in frame.groupBy("x").agg(F.sum("valid").alias("n")).collect()}
    counted = by(winding.fine_winding(rows, up, RULES))
    assert counted[0] == counted[1] == 0 < counted[2]
    assert by(winding.fine_winding(rows, up, RULES._replace(supervised_only=False)))[1] == counted[2]
    assert set(by(winding.fine_winding(rows, up, RULES._replace(period=(20.0, 40.0)))).values()) == {0}
    gated = winding.fine_winding(rows, up, RULES._replace(snap=0.25), None, F.pmod(F.col("z") / 12.0 + 0.1, F.lit(1.0)), F.when(F.col("y") == 0,
        0).otherwise(1))
    assert {r.y: r.n > 0 for r in gated.groupBy("y").agg(F.sum("valid").alias("n")).collect()} == {0: False, 1: True, 2: True}
    assert gated.where("valid = 1").agg(F.max("conf")).first()[0] == round(255 * 0.6)  # falls off with the difference
    none = winding.fine_winding(rows.where("sdf_in > 128 and sdf_out > 128"), up, RULES)
    assert none.agg(F.max("valid")).first()[0] == 0 and none.where("valid = 0").select("sine", "density", "n_x").distinct().collect() == [(128, 0, 128)]
    assert winding.fine_winding(rows.limit(0), up, RULES).count() == 0


def test_a_coarse_prior_lies_between_valid_voxels_only(spark):
    fine = spark.createDataFrame([(z, 0, 0) for z in range(12)], "z int, y int, x int")
    coarse = spark.createDataFrame([(0, 0, 0, 1.0, 1), (1, 0, 0, 3.0, 1), (2, 0, 0, 9.0, 0)], "z int, y int, x int, v double, ok int")
    found = {r.z: (r.prior_v, r.prior_valid) for r in winding.masked_upsample(fine, coarse, ["v"], "ok", 4).collect()}
    assert found[0] == (1.0, 1) and found[1] == (1.0, 1)  # the border holds
    assert np.isclose(found[2][0], 1 + 2 * 0.125) and found[7] == (3.0, 1)
    assert found[10] == (0.0, 0) and found[11] == (0.0, 0)


def test_crops_hold_their_targets(spark):
    code = lambda d: int(np.rint(128 + d * 127 / 20))
    rows = [(z, y, 0, 51 * z, code(z - 1), code(z - 3), 0 if z == 5 else 1, 0 if y == 0 else 64, z) for z in range(6) for y in range(2)]
    frame = spark.createDataFrame(rows, "z int, y int, x int, ct int, sdf_in int, sdf_out int, faces_valid int, faces_weight int, extra int")
    asked = spark.createDataFrame([(7, 1, 0, 0), (8, 4, 0, 0), (9, 40, 0, 0)], "crop int, low_z int, low_y int, low_x int")
    fine, coarse = {"valid": (F.col("z") % 2).cast("int"), "w": F.lit(1.0)}, {"valid": F.lit(1), "w": F.lit(2.0)}
    found = {}
    for mode, source in (("faces", "merge"), ("body", "fine"), ("sides", "coarse")):
        wound = crops.merged_winding(fine, coarse, source)
        got = crops.load_crops(asked, frame, 3, mode, wound, F.col("z") == 2, 4, ["extra"]).where("y = 0").collect()
        found[mode] = {(r.crop, r.z): r for r in got}
        assert set(found[mode]) == {(7, 0), (7, 1), (7, 2), (8, 0), (8, 1)}  # places of a crop without a row give none
    a, b, c = (found[m][7, 0] for m in ("faces", "body", "sides"))
    assert (a.ct, a.weight, a.extra, a.surface_valid) == (0.2, 1.0, 1, 1)  # a weight that was never written
    assert abs(a.target_in) < 0.1 and abs(a.target_out + 2) < 0.1 and (a.winding_valid, a.winding_w) == (1, 1.0)
    inside = found["sides"][7, 1]
    assert inside.inside == 1.0 and abs(inside.target_side - 1) < 0.1 and inside.surface_valid == 2 and inside.winding_valid == 0  # the core
    assert found["body"][8, 0].winding_valid == 0 and found["body"][8, 0].winding_w == 0 and found["faces"][8, 0].winding_w == 2.0
    assert (found["faces"][8, 1].surface_valid, found["faces"][8, 1].target_in) == (0, 0.0) and abs(b.target_body) < 0.1 and c.winding_w == 2.0
    for bad in (lambda: crops.surface_targets("x", F.lit(1), F.lit(1), F.lit(1)), lambda: crops.merged_winding(fine, coarse, "x")):
        with pytest.raises(ValueError):
            bad()


def test_blur_goes_on_at_borders_and_skips_missing_places(spark):
    draw = np.random.default_rng(9)
    v = draw.random((5, 4, 3))
    rows = [(b, z, y, x, float(v[z, y, x])) for b in (1, None) for z in range(5) for y in range(4) for x in range(3)]
    frame = spark.createDataFrame(rows, "box long, z int, y int, x int, v double")
    expected = v
    for axis, sigma in enumerate((1.0, 0.0, 0.5)):
        if sigma:
            r = int(np.ceil(3 * sigma))
            w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
            padded = np.pad(expected, [(r, r) if a == axis else (0, 0) for a in range(3)], mode="edge")
            expected = np.apply_along_axis(lambda line, w=w: np.convolve(line, w / w.sum(), "valid"), axis, padded)
    found = {(r.box, r.z, r.y, r.x): r.soft for r in intensity.blurred(frame, "v", (1.0, 0.0, 0.5), (5, 4, 3), "soft").collect()}
    assert len(found) == 120 and all(abs(s - expected[k[1:]]) < 1e-12 for k, s in found.items())
    holed = intensity.blurred(frame.withColumn("v", F.when((F.col("z") == 2) & (F.col("box") == 1), None).otherwise(F.col("v"))), "v", (0.5, 0.0, 0.0), (5, 4,
        3), "s")
    assert holed.where("s is null").count() == 0
    same = intensity.blurred(frame, "v", (0.0, 0.0, 0.0), (5, 4, 3), "s")
    assert same.where("s <> v").count() == 0
    flat = intensity.sharpened(frame.withColumn("v", F.lit(0.5)), "v", 2.0, 0.7, (5, 4, 3))
    assert flat.where("abs(v - 0.5) > 1e-12").count() == 0


def test_scans_are_drawn_by_the_box(spark):
    rows = [(b, z, y, x, 0.3 + 0.05 * x) for b in (1, 2, None) for z in range(3) for y in range(3) for x in range(3)]
    frame = spark.createDataFrame(rows, "box long, z int, y int, x int, v double")
    none = intensity.scanned(frame, "v", (3, 3, 3), intensity.Intensity(chance=0.0))
    assert sorted(map(str, none.collect())) == sorted(map(str, frame.collect()))
    every = intensity.Intensity(chance=1.0, holes=1)
    one = {(r.box, r.z, r.y, r.x): r.v for r in intensity.scanned(frame, "v", (3, 3, 3), every).collect()}
    two = {(r.box, r.z, r.y, r.x): r.v for r in intensity.scanned(frame.repartition(7, "x"), "v", (3, 3, 3), every).collect()}
    assert one == pytest.approx(two, abs=1e-12) and len(one) == 81
    assert len({round(one[b, 1, 1, 1], 9) for b in (1, 2, None)}) == 3
    window = intensity.Intensity(chance=1.0, gamma=(1.0, 1.0), contrast=(1.0, 1.0), brightness=0.0, grain=0.0, noise=0.0, ring=0.0, stripe=0.0, streak=0.0,
        window_low=(0.2, 0.2), window_high=(0.7, 0.7), holes=0)
    plain = intensity.scanned(frame, "v", (3, 3, 3), window)
    assert plain.where("abs(v - (0.1 + 0.05 * x) / 0.5) > 1e-9").count() == 0
    assert intensity.scanned(frame.limit(0), "v", (3, 3, 3), every).count() == 0
    lost = intensity.scanned(frame.withColumn("v", F.lit(None).cast("double")), "v", (3, 3, 3), window)
    assert lost.where("v is not null").count() == 0
