"""Operators on small analytic inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brickwise.functions import codec, vectors
from brickwise.operators import aggregates, components, embeddings, faces, grid, joins, morphology, rays, sampling, stencil, winding
from brickwise.operators.components import connected_components
from brickwise.operators.prefix import running_sums
from brickwise.plans.catalog import queries
from brickwise.runtime import materialize
from brickwise.streaming import builds, incremental


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(("value", "code"), [(-1.0, 0), (0.0, 128), (1.0, 255), (2.0, 255), (1 / 255, 128)])
def test_signed_codes_round_half_to_even(spark, value, code):
    assert one(spark, codec.encode_signed(F.lit(value))) == code


def test_distance_code_never_says_no_data(spark):
    assert [one(spark, codec.encode_sdf(F.lit(v), 20.0)) for v in (-99.0, 0.0, 99.0)] == [1, 128, 255]


def test_line_codes_round_trip(spark):
    for angle in np.linspace(-1.5, 1.5, 7):
        codes = codec.line_codes(F.lit(math.cos(angle)), F.lit(math.sin(angle)))
        assert abs(one(spark, codec.line_angle(*codes)) - angle) < 1e-6


def test_channel_blocks_are_prefixes():
    assert codec.is_prefix(codec.channel_names(), codec.channel_names("faces", "rv"))
    with pytest.raises(KeyError):
        codec.channel_names("other")
    assert codec.octave_level(2.4, 9.6) == 2
    with pytest.raises(ValueError, match="no level"):
        codec.octave_level(2.4, 7.0)


def test_orientation_groups():
    assert {name: len(vectors.group(name)) for name in vectors.GROUPS} == {"oct48": 48, "rot24": 24, "flip8": 8, "inplane16": 16, "rot90z4": 4}
    assert all(vectors.group(name)[0][1:] == ((0, 1, 2), (1, 1, 1)) for name in vectors.GROUPS)


def test_max_eigenvalue(spark):
    a = np.random.default_rng(0).normal(size=(3, 3))
    m = a @ a.T
    cells = [F.lit(float(m[i, j])) for i, j in ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2))]
    assert abs(one(spark, vectors.max_eigenvalue_sym3(*cells)) - np.linalg.eigvalsh(m)[-1]) < 1e-9


def test_rotations_and_signed_permutations():
    turn = np.array(vectors.rotation((1.0, 2.0, -1.0), 40.0))
    assert np.allclose(turn @ turn.T, np.eye(3)) and np.isclose(np.linalg.det(turn), 1) and np.allclose(turn @ [1, 2, -1], [1, 2, -1])
    assert np.isclose((np.trace(turn) - 1) / 2, np.cos(np.radians(40)))
    assert np.allclose(vectors.rotation((0.0, 0.0, 1.0), 90.0), [[0, -1, 0], [1, 0, 0], [0, 0, 1]])
    assert vectors.signed_permutation(vectors.rotation((0.0, 0.0, 2.0), 90.0)) == ((1, 0, 2), (-1, 1, 1)) and vectors.signed_permutation(turn.tolist()) is None
    other = np.array(vectors.quaternion_rotation(0.3, -1.0, 2.0, 0.5))
    assert np.allclose(vectors.composed(turn.tolist(), other.tolist()), turn @ other)


def test_window_rules():
    assert grid.even_window_starts(10, 4, 4) == [0, 3, 6]
    assert grid.even_window_starts(4, 4, 2) == [0]
    assert grid.fixed_stride_starts(10, 4, 3) == [0, 3, 6]
    assert grid.fixed_stride_starts(11, 4, 3) == [0, 3, 6, 7]
    assert grid.fixed_stride_starts(3, 4, 3) == [0] and grid.even_edges(0, 5) == [0, 0]
    for extent in range(5, 40):
        cores = grid.partition_by_cores(extent, 12, 3)
        assert cores[0][1] == 0 and cores[-1][2] == extent
        assert all(a[2] == b[1] for a, b in zip(cores, cores[1:], strict=False)) and all(s <= lo <= hi <= s + 12 for s, lo, hi in cores)
    with pytest.raises(ValueError, match="no window"):
        grid.even_window_starts(3, 4, 1)


@pytest.fixture(scope="module")
def cloud(spark):
    random = np.random.default_rng(1)
    places = np.argwhere(random.random((9, 8, 7)) < 0.5)
    return places, spark.createDataFrame([(*map(int, p), int(v)) for p, v in zip(places, random.integers(0, 99, len(places)), strict=True)],
        "z int, y int, x int, u int").cache()


def test_stencils_on_ragged_places(cloud):
    places, rows = cloud
    values = {(r.z, r.y, r.x): r.u for r in rows.collect()}
    near = lambda p, r: [values[q] for q in values if all(abs(a - b) <= r for a, b in zip(p, q, strict=True))]
    assert {(r.z, r.y, r.x): r.top for r in stencil.neighbour_extreme(rows, "u", 1, True, "top").collect()} == {p: max(near(p, 1)) for p in values}
    assert {(r.z, r.y, r.x): round(r.m * 125) for r in stencil.box_mean(rows, "u", 2, "m").collect()} == {p: sum(near(p, 2)) for p in values}
    targets = [p for p, u in values.items() if u > 85]
    d2 = lambda p: min((sum((a - b) ** 2 for a, b in zip(p, t, strict=True)) for t in targets), default=99)
    found = {(r.z, r.y, r.x): r.d2 for r in stencil.distance_within(rows, rows.where("u > 85"), 3).collect()}
    assert found == {p: d2(p) if d2(p) <= 9 else None for p in values}
    nearest = {(r.z, r.y, r.x): r.d2 for r in joins.nearest(rows, rows.where("u > 85"), 3, [], []).collect()}
    assert nearest == found


def test_erosion_undoes_dilation_on_a_solid(spark):
    space = grid.box_grid(spark, (0, 0, 0), (9, 9, 9))
    solid = space.where(grid.inside((2, 3, 2), (4, 3, 5)))
    assert {tuple(r) for r in stencil.close(solid, 1, space).collect()} == {tuple(r) for r in solid.collect()}


def test_halo_covers_each_widened_brick(spark):
    space = grid.box_grid(spark, (0, 0, 0), (8, 8, 8))
    counts = grid.with_halo(space, 4, 1, (0, 0, 0), (2, 2, 2)).groupBy("bz", "by", "bx").agg(F.count("*").alias("n"), F.count(F.when(F.col("core"),
        1)).alias("core")).collect()
    assert len(counts) == 8 and all(r.n == 125 and r.core == 64 for r in counts)


def test_components_match_union_find(spark):
    random = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in random.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {}

    def find(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    linked = {i for e in edges if e[0] != e[1] for i in e}
    frame = spark.createDataFrame([*edges, (None, 3), (5, None)], "a long, b long")
    assert {tuple(r) for r in connected_components(frame).collect()} == {(i, find(i)) for i in linked}
    assert connected_components(frame.limit(0)).count() == 0


def test_running_sums_cross_ranges(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 1000).alias("k"), F.col("id").alias("v"))
    found = running_sums(rows, ["k"], {"v": "before"}, "sums", ["g"]).collect()
    for g in range(3):
        total = 0
        for r in sorted((r for r in found if r.g == g), key=lambda r: r.k):
            assert r.before == total
            total += r.v


def test_priority_merge_truth_table(spark):
    states = [(a, b) for a in (0, 1, 2, None) for b in (0, 1, 2, None) if (a, b) != (None, None)]
    first = spark.createDataFrame([(i, 10, a) for i, (a, _) in enumerate(states) if a is not None], "k int, u int, valid int")
    second = spark.createDataFrame([(i, 20, b) for i, (_, b) in enumerate(states) if b is not None], "k int, u int, valid int")
    for r in joins.priority_merge(first, second, ["u"], ["k"]).collect():
        a, b = (s or 0 for s in states[r.k])
        assert r.source == (1 if a == 1 else 2 if b == 1 else 0)
        assert r.valid == (1 if 1 in (a, b) else 0 if (a, b) == (0, 0) else 2)
        assert (r.u == 0) == (r.valid == 0) or states[r.k][1] is None


def test_interpolation_holds_the_ends(spark):
    points = spark.createDataFrame([(10.0, 1.0), (20.0, 3.0)], "t double, v double")
    probes = spark.createDataFrame([(i, t) for i, t in enumerate([0.0, 10.0, 15.0, 20.0, 99.0])], "id int, t double")
    assert [r.v for r in joins.as_of_interpolated(probes, points, "t", ["v"]).orderBy("id").collect()] == [1.0, 1.0, 2.0, 3.0, 3.0]


def test_boxes_and_intervals(spark):
    random = np.random.default_rng(6)
    a, b = random.integers(0, 60, (80, 3)).tolist(), random.integers(0, 60, (15, 3)).tolist()
    frame = lambda rows: spark.createDataFrame(rows, "z int, y int, x int")
    hit = lambda p: any(all(abs(c - d) < 9 for c, d in zip(p, q, strict=True)) for q in b)
    assert sorted(map(tuple, joins.box_overlap(frame(a), frame(b), 9, 9).collect())) == sorted(tuple(p) for p in a if hit(p))
    assert sorted(map(tuple, joins.box_overlap(frame(a), frame(b), 9, 9, anti=True).collect())) == sorted(tuple(p) for p in a if not hit(p))
    islands = joins.merge_intervals(spark.createDataFrame([(1, 3), (3, 5), (7, 8), (2, 2)], "lo int, hi int"), "lo", "hi").collect()
    assert sorted((r.lo, r.hi) for r in islands) == [(1, 5), (7, 8)]


def test_ranking_metrics_with_ties_and_one_class(spark):
    rows = [("tied", 0.5, i < 2) for i in range(4)] + [("one", 0.1, True), ("one", 0.2, True)]
    frame = spark.createDataFrame(rows, "g string, s double, p boolean")
    assert {r.g: r.average_precision for r in aggregates.average_precision(frame, "s", "p", ["g"]).collect()} == {"tied": 0.5, "one": None}
    assert {r.g: r.auroc for r in aggregates.auroc(frame, "s", "p", ["g"]).collect()} == {"tied": 0.5, "one": None}


def test_empty_masks(spark):
    none = F.col("id") < 0
    row = spark.range(3).agg(aggregates.masked_mean(F.col("id"), none.cast("double")).alias("m"), aggregates.mean_where(F.col("id"), none).alias("n"),
        aggregates.dice(none, none).alias("d"), aggregates.dice(none, none, 1.0).alias("e")).first()
    assert tuple(row) == (0.0, None, None, 1.0)


@pytest.mark.parametrize("one_task", [0, 1_000_000])
def test_percentiles_are_those_of_numpy(spark, monkeypatch, one_task):
    monkeypatch.setattr(aggregates, "ONE_TASK", one_task)
    random = np.random.default_rng(7)
    values = {"a": random.normal(size=301), "b": np.repeat([1.0, 5.0, 1e9], [200, 3, 40]), "c": np.array([2.5]), None: np.arange(7.0)}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs] + [("d", None), ("a", float("nan")), ("a", None)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = {"low": 0.01, "mid": 0.5, "high": 0.9}
    found = {r.g: r for r in aggregates.percentiles(frame, "v", ["g"], shares).collect()}
    assert set(found) == {*values, "d"} and found["d"].mid is None
    for g, vs in values.items():
        for name, share in shares.items():
            assert abs(found[g][name] - np.quantile(vs, share)) < 1e-6


def test_robust_normalise_falls_back(spark):
    frame = spark.createDataFrame([(g, float(v)) for g, vs in {"mad": range(100), "flat": [0] * 99 + [50], "same": [4] * 9}.items() for v in vs],
        "g string, v double")
    top = {r.g: r.top for r in aggregates.robust_normalise(frame, "v", ["g"]).groupBy("g").agg(F.max(F.abs("normalised")).alias("top")).collect()}
    assert 1 < top["mad"] < 2 and top["same"] == 0 and top["flat"] < 1


def test_unwrap_and_runs(spark):
    phase = np.arange(0, 40, 1.3)
    wrapped = (phase + math.pi) % (2 * math.pi) - math.pi
    frame = spark.createDataFrame([(0, k, float(v)) for k, v in enumerate(wrapped)], "ray_id int, k int, v double")
    assert np.allclose([r.unwrapped for r in rays.unwrap(frame, "v").orderBy("k").collect()], phase)
    marks = spark.createDataFrame([(0, k, float(c == "1")) for k, c in enumerate("1101110010")], "ray_id int, k int, v double")
    assert sorted((r.start, r.length, r.inner_run) for r in rays.runs(marks, F.col("v") > 0).collect()) == [(0, 2, False), (3, 3, True), (8, 1, True)]


def test_samples_do_not_depend_on_partitions(spark):
    rows = spark.range(500)
    one_way, other = (sorted(r.id for r in sampling.bottom_k(rows.repartition(n), 20, ["id"]).collect()) for n in (1, 7))
    assert one_way == other
    picks = sampling.weighted_choice(rows, ["id"], {"a": 3, "b": 1}).groupBy("choice").count().collect()
    assert 300 < {r.choice: r["count"] for r in picks}["a"] < 450


def test_spread_top_pages(spark):
    rows = spark.createDataFrame([(z, 0, 0, float(z % 7)) for z in range(60)], "z int, y int, x int, s double")
    taken = sampling.spread_top(rows, 5, 6, "s", grid.AXES, pool=4)
    assert len(taken) == 5 and all(abs(a["z"] - b["z"]) >= 6 for a in taken for b in taken if a is not b)


def test_pca_explains_a_plane(spark):
    random = np.random.default_rng(7)
    x = random.normal(size=(200, 2)) @ random.normal(size=(2, 6)) + 3
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, v array<double>")
    model = embeddings.fit_pca(frame, "v", 2)
    assert abs(model[2].sum() - 1) < 1e-9
    out = np.array([r.p for r in frame.select("id", embeddings.apply_pca(model, "v").alias("p")).orderBy("id").collect()])
    assert np.allclose(out @ model[1] + model[0], x)


def test_markers_keep_the_last_event_in_file_order(spark):
    lines = [(0, "2030 PREP_a_bands_START"), (1, "2001 PREP_a_bands_DONE PREP_b_labels_START"), (2, "PREP_b_labels_FAILED later PREP_b_labels_DONE"), (3,
        "XPREP_a_bands_START PREP_a_other_DONE")]
    states = incremental.last_states(incremental.markers(spark.createDataFrame(lines, "line_no long, line string"))).collect()
    assert {(r.region, r.stage): r.event for r in states} == {("a", "bands"): "DONE", ("b", "labels"): "DONE"}


def test_stream_build_resumes_and_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    spark.range(0, 50).write.parquet(str(source))
    stream = lambda: spark.readStream.schema("id long").parquet(str(source))
    build = lambda rows: rows.groupBy((F.col("id") % 5).alias("brick")).agg(F.sum("id").alias("total"))
    for extra in (None, (50, 80)):
        if extra:
            spark.range(*extra).write.mode("append").parquet(str(source))
        incremental.build_increment(stream(), build, str(tmp_path / "out"), str(tmp_path / "marks")).awaitTermination()
    found = incremental.read_increments(spark, str(tmp_path / "out")).groupBy("brick").agg(F.sum("total").alias("total")).collect()
    assert {r.brick: r.total for r in found} == {b: sum(i for i in range(80) if i % 5 == b) for b in range(5)}


def test_windows_over_a_stream_equal_the_batch(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    query = incremental.tumbling(stream, "ts", "1 day",
        "30 days").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    key = lambda rows: sorted((str(r.start), r.event_type, r.n) for r in rows)
    assert key(spark.table("windows").collect()) == key(incremental.tumbling(events, "ts", "1 day").collect())


def test_pending_counts_only_marks_of_the_writer(spark):
    plan = spark.range(4).select(F.col("id").alias("z0"))
    mine = incremental.fingerprint("store", "a")
    done = spark.createDataFrame([(0, mine), (1, "other")], "z0 long, fingerprint string")
    assert [r.z0 for r in incremental.pending(plan, done, ["z0"], mine).orderBy("z0").collect()] == [1, 2, 3]
    assert not incremental.is_complete(plan, done, ["z0"])


def test_core_axis_goes_on_beyond_its_first_points(spark, tmp_path):
    from brickwise.plans import volumes

    rows = [(i, 0, [0.0] * 64) for i in range(1280, 1344)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = {r.z: r.n for r in volumes.axis_core_mask(spark, str(tmp_path)).collect()}
    inside = lambda z: sum((y - 10 - z / 4) ** 2 + (x - 20 + z / 8) ** 2 <= 36 for y in range(32) for x in range(32))
    assert found == {z: inside(z) for z in range(80, 84)}


def test_rising_peaks_take_one_pass(spark, monkeypatch):
    written = []
    real = rays.materialize
    monkeypatch.setattr(rays, "materialize", lambda df, label: written.append(label) or real(df, label))
    rising = [(1, 2 * i, float(i)) for i in range(300)] + [(2, 3 * i, float(-i)) for i in range(50)] + [(3, 5, 1.0), (3, 5 + 4, 1.0), (3, 5 + 8, 1.0), (3, 40,
        0.5)]
    frame = spark.createDataFrame(rising, "ray_id long, k long, v double")

    def brute(distance, most=10**9):
        taken = []
        for ray, k, v in sorted((r for r in rising if r[1] < most), key=lambda r: (r[0], -r[2], r[1])):
            if all(r != ray or abs(k - q) >= distance for r, q, _ in taken):
                taken.append((ray, k, v))
        return sorted(taken)

    found = lambda d: sorted(tuple(r) for r in rays.spaced_peaks(frame, d).collect())
    assert found(4) == brute(4) and len(written) == 2  # however many peaks rise in a row
    assert found(5) == brute(5)
    monkeypatch.setattr(rays, "RUN_PEAKS", 20)  # runs that no task may hold go in rounds
    assert sorted(tuple(r) for r in rays.spaced_peaks(frame.where("k < 60"), 7).collect()) == brute(7, 60)
    assert rays.spaced_peaks(frame.limit(0), 4).count() == 0


def test_ranking_metrics_of_many_scores(spark, monkeypatch):
    draw = np.random.default_rng(4)
    rows = [(None if i % 3 == 0 else "g", float(draw.integers(0, 40)), bool(draw.integers(0, 2))) for i in range(600)]
    frame = spark.createDataFrame(rows, "name string, s double, p boolean")
    by_group = lambda f: {r["name"]: round(r[1], 12) for r in f(frame, "s", "p", ["name"]).collect()}
    one = [by_group(f) for f in (aggregates.average_precision, aggregates.auroc)]
    monkeypatch.setattr(aggregates, "ONE_TASK", 5)
    assert [by_group(f) for f in (aggregates.average_precision, aggregates.auroc)] == one and set(one[0]) == {None, "g"}


def test_tiles_by_division_are_the_even_ones(spark):
    for size, tile in ((1, 5), (32, 12), (100, 7), (101, 10), (997, 32)):
        edges = grid.even_edges(size, tile)
        rows = spark.range(size).select(F.col("id").cast("int").alias("p"))
        number, low, high = grid.even_tile(F.col("p"), size, tile)
        for r in rows.select("p", number.alias("i"), low.alias("a"), high.alias("b")).collect():
            assert (edges[r.i], edges[r.i + 1]) == (r.a, r.b) and r.a <= r.p < r.b
    assert grid.field_tiling(256, 122) == (124, 8)
    with pytest.raises(ValueError):
        grid.field_tiling(256, 126)
    assert grid.fitted_tile((64, 64, 64), 96, 4, 16, 1, 10**9) == 96 and grid.fitted_tile((640, 640, 640), 192, 4, 16, 1, 4 * 136**3) == 128
    with pytest.raises(MemoryError):
        grid.fitted_tile((64, 64, 64), 64, 4, 16, 1, 1000)


def test_a_ray_of_most_of_the_samples_is_dealt_out(spark, monkeypatch):
    draw = np.random.default_rng(8)
    rows = [(7 if i % 10 else (None if i % 20 else 3), i, float(draw.integers(0, 9)), float(draw.uniform(-math.pi, math.pi))) for i in range(400)]
    frame = spark.createDataFrame(rows, "ray_id long, k long, v double, a double").repartition(5)
    every = lambda: [sorted(map(str, f.collect())) for f in (
        rays.neighbours(frame, ["v", "k"]), rays.summed(frame, {"total": F.col("v"), "n": F.lit(1)}), rays.unwrap(frame, "a").select("ray_id", "k", "wraps",
            F.round("unwrapped", 9)), rays.runs(frame, F.col("v") > 3), rays.local_maxima(frame, 2.0))]
    one = every()
    assert len(one[0]) == 400 and len(one[3]) > 20
    monkeypatch.setattr(rays, "RAY_SAMPLES", 50)
    assert every() == one
    plans = rays.neighbours(frame, ["v"])._jdf.queryExecution().toString()
    assert "_bw_part" in plans


@pytest.fixture
def small_broadcasts(spark):
    """Broadcasts of over 2 MB fail, as larger ones do in a small driver."""
    spark.conf.set("spark.sql.maxBroadcastTableSize", "2m")
    yield
    spark.conf.unset("spark.sql.maxBroadcastTableSize")


def bricks(spark, tmp_path, n):
    """A folder with a table of n vectors, whose files are small beside the voxels in them."""
    values = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (F.sin(F.col("id") * 64 + i) / 3).cast("float"))
    spark.range(n).select(F.col("id").alias("vec_id"), (F.col("id") % 10).cast("int").alias("label"), values.alias("embedding")).write.parquet(
        f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def test_finer_voxels_are_not_broadcast(spark, tmp_path, small_broadcasts):
    found = queries()["upsample_nearest"](spark, bricks(spark, tmp_path, 2000))
    assert found.agg(F.sum("n")).first()[0] == 2000 * 64 * 27


def places(spark):
    return materialize(grid.box_grid(spark, (0, 0, 0), (16, 32, 32)), "places")


@pytest.mark.parametrize("found", [
    lambda rows, mask: morphology.crest(rows, mask),
    lambda rows, mask: morphology.nearest_of_all(rows, mask, ["z"]),
    lambda rows, mask: components.without_small(mask, 2),
    lambda rows, mask: stencil.touching(rows, mask),
    lambda rows, mask: stencil.distance_within(rows, mask, 2),
    lambda rows, mask: joins.nearest(rows, mask, 2, [], ["z"]),
    lambda rows, mask: winding.masked_upsample(rows, mask.withColumn("v", F.lit(1)), ["v"], "v", 2),
])
def test_places_are_not_broadcast(spark, small_broadcasts, found):
    rows = places(spark)
    assert found(rows, rows.where("z % 4 < 2 and (y + x) % 5 < 4")).count() > 0


def test_normals_of_bands_are_planned_in_steps(spark):
    rows = places(spark)
    out = faces.band_normals(rows, rows.where("z % 4 = 0"), (F.lit(0.0), F.col("y") * 1.0, F.col("x") * 1.0))
    assert len(out._jdf.queryExecution().analyzed().toString()) < 200_000
    assert materialize(out, "normals").where("n_ok").count() > 0


def test_a_channel_is_finished_in_one_wave(spark, tmp_path, monkeypatch):
    waves, build = [], builds.build
    monkeypatch.setattr(builds, "build", lambda *a: waves.append(build(*a)) or waves[-1])
    found = queries()["appended_channel"](spark, bricks(spark, tmp_path, 512))
    assert found.agg(F.sum("n")).first()[0] == 512 * 64
    assert waves == [1, 1, 1, 1]


def test_doubled_voxels_equal_those_of_eight_corners_with_one_shuffle(spark):
    rows = places(spark).where("(z * 7 + y * 5 + x) % 6 < 4").withColumn("v", F.sin(F.col("z") * 3.0 + F.col("y") * F.col("x")))
    rows = materialize(rows.select((F.col("z") - 5).alias("z"), "y", "x", "v"), "ragged")
    points = grid.refined(rows.select("z", "y", "x"), 2)
    points = points.select(F.struct("z", "y", "x").alias("id"), *[((F.col(a) + 0.5) / 2 - 0.5).alias(f"p{a}") for a in ("z", "y", "x")])
    expected = joins.trilinear(points, rows, "v").select("id.*", F.col("v").alias("expected"))
    found = joins.doubled(rows, ["v"])
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    both = found.join(expected, ["z", "y", "x"], "full")
    assert both.count() == 8 * rows.count()
    assert both.where("v is null or expected is null or abs(v - expected) > 1e-12").count() == 0
