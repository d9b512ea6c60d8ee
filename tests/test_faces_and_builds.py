"""Faces of sheets, local shape, resumable builds and audits on volumes that are known."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brickwise.operators import audit, evaluation, faces, morphology, shape
from brickwise.streaming import builds


def volume(spark, size, columns):
    """Rows of a box with columns computed by functions of (z, y, x)."""
    places = [(z, y, x) for z in range(size[0]) for y in range(size[1]) for x in range(size[2])]
    names = ", ".join(["z int", "y int", "x int", *(f"{n} {kind}" for n, (kind, _) in columns.items())])
    return spark.createDataFrame([(*p, *[f(*p) for _, f in columns.values()]) for p in places], names)


def up():
    return F.lit(1.0), F.lit(0.0), F.lit(0.0)


def test_contacts_are_the_first_and_last_on_either_side(spark):
    rows = volume(spark, (9, 1, 1), {})
    body = rows.where("z in (3, 5, 8)")
    found = {r.z: tuple(r)[3:] for r in faces.contacts(rows, body, up(), 3).collect()}
    assert found[4] == (1, 1, 1, 1) and found[6] == (2, 2, 1, 3) and found[0] == (3, 3, None, None) and found[5] == (3, 3, 2, 2)
    assert faces.contacts(rows.limit(0), body, up(), 3).count() == 0


def test_gaps_close_along_the_normal_only(spark):
    rows = volume(spark, (12, 1, 12), {})
    layers = rows.where("z in (3, 5) and x < 4 or z = 9 and x < 4 or z = 4 and x in (6, 8)")
    closed = {(r.z, r.x) for r in faces.close_along(rows, layers, up(), 1).collect()}
    was = {(r.z, r.x) for r in layers.collect()}
    assert closed == was | {(4, x) for x in range(4)}  # between layers of a bundle; neither towards z = 9 nor across the line at x = 7
    assert {(r.z, r.x) for r in faces.close_along(rows, layers, up(), 0).collect()} == was
    assert faces.close_along(rows, layers.limit(0), up(), 2).count() == 0
    edge = {(r.z, r.x) for r in faces.close_along(rows, rows.where("z in (0, 1)"), up(), 3).collect()}
    assert edge == {(z, x) for z in (0, 1) for x in range(12)}  # what is beyond the data doesn't break a line


RULES = faces.FaceRules(body_above=60.0, body_sigma=0.3, close_reach=1, least_component=10, thickness=(3.0, 8.0), side_reach=3, contact_reach=2, clip=6.0)


def test_faces_of_a_slab(spark):
    size = (20, 6, 6)
    rows = volume(spark, size, {"ct": ("double", lambda z, y, x: 100.0 if 8 <= z < 13 else 0.0), "recto": ("int", lambda z, y, x: 100 if z == 0 else 0),
        "data": ("boolean", lambda z, y, x: x > 0)})
    found = {(r.z, r.y, r.x): r for r in faces.face_labels(rows, up(), RULES).collect()}
    assert len(found) == np.prod(size)
    code = lambda d: int(np.rint(128 + np.clip(d, -6, 6) * 127 / 6))
    for (z, _, x), r in found.items():
        if x == 0:
            assert (r.sdf_in, r.sdf_out, r.thickness, r.faces_valid) == (0, 0, 0, 0)
        else:
            assert (r.sdf_in, r.sdf_out, r.thickness) == (code(z - 8), code(z - 12), 6)
            assert r.faces_valid == (2 if z == 0 else 1)  # doubtful and far from a face


def test_validity_of_faces(spark):
    slabs = lambda z, y, x: 100.0 if 4 <= z < 9 or 10 <= z < 15 else 0.0  # noqa: E731  a voxel of air between two sheets
    columns = {"ct": ("double", slabs), "recto": ("int", lambda *_: 0), "data": ("boolean", lambda *_: True)}
    rows = volume(spark, (24, 4, 4), columns)
    rules = RULES._replace(close_reach=0)
    by_z = {r.z: r.faces_valid for r in faces.face_labels(rows, up(), rules).where("y = 2 and x = 2").collect()}
    assert by_z[6] == 2 and by_z[8] == 2  # the lower sheet's outer face touches the next sheet
    assert by_z[20] == 1
    thick = {r.faces_valid for r in faces.face_labels(rows, up(), rules._replace(thickness=(7.0, 9.0))).collect()}
    assert thick == {2}
    gone = faces.face_labels(rows, up(), rules._replace(body_above=200.0)).select("sdf_in", "sdf_out", "thickness", "faces_valid").distinct().collect()
    assert [tuple(r) for r in gone] == [(255, 255, 0, 2)]  # no body
    missing = faces.face_labels(rows, up(), rules, (F.lit(0.0), F.lit(0.0), F.when(F.col("x") == 0, 1.0).otherwise(0.0)))
    assert {r.faces_valid for r in missing.where("x > 0").collect()} == {2}  # no normal
    assert faces.face_labels(rows.limit(0), up(), rules).count() == 0


def test_nearest_of_all_matches_brute_force(spark):
    draw = np.random.default_rng(1)
    places = [tuple(int(v) for v in p) for p in np.unique(draw.integers(0, 21, (90, 3)), axis=0)]
    targets = [(*p, i) for i, p in enumerate(places[::9])]
    rows = spark.createDataFrame(places, "z int, y int, x int")
    frame = spark.createDataFrame(targets, "z int, y int, x int, tag int")
    d2 = lambda p, t: sum((a - b) ** 2 for a, b in zip(p, t[:3], strict=True))
    expected = {p: min((d2(p, t), t[:3], t[3]) for t in targets) for p in places}
    for r in morphology.nearest_of_all(rows, frame, ["tag"]).collect():
        best = expected[r.z, r.y, r.x]
        assert (r.d2, r.near_tag) == (best[0], best[2])
    assert {(r.d2, r.near_tag) for r in morphology.nearest_of_all(rows, frame.limit(0), ["tag"]).collect()} == {(None, None)}


def shape_of(spark, normal, size=(12, 12, 12), **more):
    columns = {"inner": ("double", lambda z, y, x: 2.0), "outer": ("double", lambda z, y, x: -4.0), "valid": ("int", lambda z, y, x: 2 if z == 0 else 1)}
    columns |= {f"n_{a}": ("double", lambda z, y, x, i=i: normal(z, y, x)[i]) for i, a in enumerate("zyx")}
    rows = volume(spark, size, columns)
    n = tuple(F.col(f"n_{a}") for a in "zyx")
    return {(r.z, r.y, r.x): r for r in shape.shape_targets(rows, F.col("inner"), F.col("outer"), F.col("valid"), n, **more).collect()}


def test_shape_of_flat_and_crossing_sheets(spark):
    flat = shape_of(spark, lambda z, y, x: (1.0, 0.0, 0.0), sigma=3.0)
    for (z, _, _), r in flat.items():
        expected = (0, 0, 0, 0, 0, 0) if z == 0 else (1.0, 0, 0, 6.0, 0, 1)
        assert np.allclose((r.off_z, r.off_y, r.off_x, r.thick, r.incoherence, r.valid), expected, atol=1e-6)
    crossing = shape_of(spark, lambda z, y, x: (1.0, 0.0, 0.0) if (x // 2) % 2 else (0.0, 1.0, 0.0), sigma=20.0, factor=2)
    assert abs(crossing[6, 6, 6].incoherence - 0.5) < 0.02
    short = shape_of(spark, lambda z, y, x: (0.4, 0.0, 0.0))
    assert {r.valid for r in short.values()} == {0} and {r.thick for r in short.values()} == {0.0}
    assert [shape.coarse_factor(s) for s in (0.5, 1.5, 3.0, 8.0, 80.0)] == [1, 1, 2, 4, 4]


class Broken(Exception):
    pass


def test_a_build_goes_on_where_it_was_killed(spark, tmp_path):
    rows = volume(spark, (8, 8, 6), {"v": ("int", lambda z, y, x: z * y + x)}).where("not (z < 4 and y < 4)")
    sums = lambda part: part.join(part.select((F.col("x") + 1).alias("x"), "z", "y", F.col("v").alias("before")), ["z", "y", "x"], "left").select("z", "y", "x",
        (F.col("v") + F.coalesce("before", F.lit(0))).alias("w"))
    calls = []

    def fragile(part):
        calls.append(len(calls))
        if len(calls) == 3:
            raise Broken
        return sums(part)

    store = builds.BrickStore(spark, f"file://{tmp_path}/store", "one")
    with pytest.raises(FileNotFoundError):
        store.read()
    with pytest.raises(Broken):
        builds.build(store, rows, fragile, 4, 1, 2)
    first = {tuple(r) for r in store.done().collect()}
    assert len(first) == 4
    torn = store.done().limit(1).select("bz", "by", "bx")
    sums(rows).select("*", *builds.brick_of(4)).join(torn, builds.BRICK, "left_semi").limit(3).write.parquet(f"file://{tmp_path}/store/data/wave=0torn")
    assert builds.build(store, rows, sums, 4, 1, 100) == 1
    assert first < {tuple(r) for r in store.done().collect()}  # what was done isn't built again
    expected = {tuple(r) for r in sums(rows).collect()}
    assert {tuple(r) for r in store.read().collect()} == expected and store.read().count() == len(expected)  # rows without a mark don't exist
    assert store.damaged().count() == 0 and builds.build(store, rows, sums, 4, 1, 100) == 0
    other = builds.BrickStore(spark, store.path, "two")
    assert builds.build(other, rows, sums, 4, 1, 3, waves=1) == 1 and other.done().count() == 3
    wave = store.done().first()["wave"]
    rows.limit(1).select("z", "y", "x", F.lit(5).alias("w"), F.lit(1).alias("bz"), F.lit(0).alias("by"),
        F.lit(0).alias("bx")).write.mode("append").parquet(f"{store.path}/data/wave={wave}")
    assert [tuple(r) for r in store.damaged().collect()] == [(1, 0, 0)] or store.done().where("bz = 1 and by = 0 and bx = 0").first()["wave"] != wave


def test_within_halo_takes_each_row_once(spark):
    rows = volume(spark, (12, 4, 4), {})
    bricks = spark.createDataFrame([(1, 0, 0)], "bz int, by int, bx int")
    assert sorted(r.z for r in builds.within_halo(rows, bricks, 4, 1).where("y = 0 and x = 0").collect()) == [3, 4, 5, 6, 7, 8]


def test_audit_measures_and_verdict(spark):
    rows = volume(spark, (10, 6, 6), {"a": ("boolean", lambda z, y, x: 3 <= z < 6), "b": ("boolean", lambda z, y, x: None if z == 0 else 4 <= z < 7)})
    found = {r.measure: r.value for r in audit.measures(rows, near=1.0, least=5).collect()}
    assert found["share_a"] == 0.3 and abs(found["dice"] - 2 / 3) < 1e-12 and found["iou"] == 0.5 and found["a_inside_b"] == found["b_inside_a"]
    assert found["surface_a"] == 72 and found["components_b"] == 1 and found["largest_b"] == 108 and found["thickness_a"] == 4.0
    assert found["crest_a_near"] == 1.0
    verdict = {r.rule: r.passed for r in audit.verdict(audit.measures(rows, 1.0, 5), {"dice": (0.5, 1), "iou": (0.6, 1), "none": (0, 1)}).collect()}
    assert verdict == {"dice": True, "iou": False, "none": False}
    bare = {r.measure: r.value for r in audit.measures(rows.withColumn("b", F.lit(False))).collect()}
    assert bare["share_b"] == 0 and bare["b_inside_a"] is None and bare["thickness_b"] is None and bare["crest_a_near"] == 0


def test_body_pass_whatever_the_order_and_the_sides(spark):
    draw = np.random.default_rng(6)
    pred = draw.random((12, 8, 8)) < 0.2
    band = np.zeros((12, 8, 8), bool)
    band[4:7] = True
    band[10, 0, 0] = True  # too small a component
    rows = volume(spark, (12, 8, 8), {"pred": ("boolean", lambda z, y, x: bool(pred[z, y, x])), "band": ("boolean", lambda z, y, x: bool(band[z, y, x]))})
    one, far = (f.collect() for f in evaluation.body_pass(rows, 2, 1, 10))
    again = evaluation.body_pass(rows.repartition(3, "x"), 2, 1, 10)
    assert again[0].collect() == one and sorted(again[1].collect()) == sorted(far)
    places = lambda m: np.argwhere(m)
    d2 = lambda a, b: ((places(a)[:, None] - places(b)[None]) ** 2).sum(-1)
    near = np.zeros_like(pred)
    near[tuple(places(np.ones_like(pred))[d2(np.ones_like(pred), band).min(1) <= 4].T)] = True
    crest = np.zeros_like(pred)
    crest[5] = True
    cut = pred & near
    cube = lambda a, b: (np.abs(places(a)[:, None] - places(b)[None]).max(-1).min(1) <= 1).sum()
    assert (one[0].n_near, one[0].n_pred, one[0].n_band) == (near.sum(), cut.sum(), 64)
    assert abs(one[0].dice - (cube(cut, crest) + cube(crest, cut)) / (cut.sum() + 64)) < 1e-12
    by = {r.side: r for r in far}
    ways = {"pred_to_band": np.sqrt(d2(cut, crest).min(1)), "band_to_pred": np.sqrt(d2(crest, cut).min(1))}
    ways["symmetric"] = np.concatenate(list(ways.values()))
    for side, d in ways.items():
        got = by[side]
        assert (got.n, got.frac_gt3) == (len(d), (d > 3).mean()) and np.allclose([got.mean, got.median, got.p90], [d.mean(), np.median(d), np.percentile(d,
            90)])
    none = evaluation.body_pass(rows.withColumn("band", F.lit(None).cast("boolean")), 2, 1, 10)
    assert tuple(none[0].first()) == (0, 0, 0, None) and {(r.n, r["mean"]) for r in none[1].collect()} == {(0, None)}


def test_channels_are_added_beside_others_and_damage_shows(spark, tmp_path):
    rows = volume(spark, (8, 4, 4), {"a": ("int", lambda z, y, x: z + y), "b": ("int", lambda z, y, x: x)})
    store = builds.ChannelStore(spark, f"file://{tmp_path}/s", 4)
    for c in "ab":
        store.add(c, c, rows, lambda part, c=c: part.select("z", "y", "x", c))
    files = lambda c: {str(f): f.stat().st_mtime_ns for f in (tmp_path / "s" / c).rglob("*") if f.is_file()}
    before = files("a")
    twice = lambda part: part.select("z", "y", "x", (2 * F.col("a")).alias("twice"))
    assert store.add("twice", "t", store.read({"a": "a"}), twice, 0, 1, waves=1) == 1
    assert store.read({"a": "a", "b": "b"}).count() == 128 and store.read({"a": "a", "twice": "t"}).count() == 64  # half a channel
    store.add("twice", "t", store.read({"a": "a"}), twice)
    assert store.read({"a": "a", "twice": "t"}).where("twice <> 2 * a").count() == 0 and files("a") == before
    layers = {"a": "a", "b": "b"}
    found = {r.bz: (r.complete, [tuple(x) for x in r.layers]) for r in builds.packet_layers(store, layers, "a").collect()}
    assert found == {0: (True, [("a", 64, 64 * 3), ("b", 64, 96)]), 1: (True, [("a", 64, 64 * 7), ("b", 64, 96)])}
    wave = store.channel("a", "a").done().first()["wave"]
    rows.limit(1).select("z", "y", "x", "a", *builds.brick_of(4)).write.mode("append").parquet(f"{store.path}/a/data/wave={wave}")
    found = {r.bz: (r.complete, [x.layer for x in r.layers]) for r in builds.packet_layers(store, layers, "a").collect()}
    assert found == {0: (False, ["b"]), 1: (True, ["a", "b"])}
