"""Chunk tables, chunk files, configuration and the fluent wrapper."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from brickwise.api import VoxelFrame
from brickwise.functions import config
from brickwise.operators import grid
from brickwise.sources import cache, chunks
from brickwise.streaming import builds


@pytest.fixture(scope="module")
def block():
    return np.random.default_rng(3).integers(0, 256, (10, 9, 7), dtype=np.uint8)


def as_dict(rows):
    return {(r.z, r.y, r.x): r.u for r in rows.collect()}


def box_of(block, low, size):
    return {(z, y, x): int(v) for (z, y, x), v in np.ndenumerate(block) if all(lo <= c < lo + n for c, lo, n in zip((z, y, x), low, size, strict=True))}


def test_chunk_rows_round_trip_and_prune(spark, block, tmp_path):
    rows = spark.createDataFrame([("s", "u", *map(int, p), int(v)) for p, v in np.ndenumerate(block)],
        "store string, channel string, z int, y int, x int, u int")
    packed = chunks.pack(rows, 4)
    chunks.write_chunks(packed, str(tmp_path / "chunks"))
    stored = spark.read.parquet(str(tmp_path / "chunks"))
    assert stored.count() == 3 * 3 * 2
    low, size = (2, 3, 1), (4, 5, 6)
    assert chunks.chunks_of_box(stored, low, size, 4).count() == 2 * 2 * 2
    assert as_dict(chunks.read_box(stored, low, size, 4)) == box_of(block, low, size)


@pytest.mark.parametrize("version", [2, 3])
def test_chunk_files_of_both_versions(spark, block, tmp_path, version):
    edges = (4, 4, 4)
    if version == 2:
        (tmp_path / ".zarray").write_text(json.dumps({"shape": block.shape, "chunks": edges, "dtype": "|u1", "compressor": None, "fill_value": 0,
            "order": "C"}))
    else:
        (tmp_path / "zarr.json").write_text(json.dumps({"shape": block.shape, "data_type": "uint8", "chunk_grid": {"name": "regular",
            "configuration": {"chunk_shape": edges}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": 0,
                "codecs": [{"name": "bytes"}]}))
    padded = np.zeros((12, 12, 8), dtype=np.uint8)
    padded[:10, :9, :7] = block
    for z in range(3):
        for y in range(3):
            for x in range(2):
                name = f"{z}.{y}.{x}" if version == 2 else f"c/{z}/{y}/{x}"
                (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
                (tmp_path / name).write_bytes(padded[z * 4 : z * 4 + 4, y * 4 : y * 4 + 4, x * 4 : x * 4 + 4].tobytes())
    low, size = (-1, 2, 3), (6, 20, 3)
    assert as_dict(chunks.read_array(spark, str(tmp_path), low, size)) == box_of(block, low, size)


def test_only_the_chunks_of_a_box_are_opened(spark, tmp_path):
    (tmp_path / ".zarray").write_text(json.dumps({"shape": (2, 2, 8), "chunks": (2, 2, 2), "dtype": "|u1", "compressor": None, "fill_value": 0, "order": "C"}))
    (tmp_path / "0.0.0").write_bytes(bytes(range(8)))
    with open(tmp_path / "0.0.1", "wb") as far:
        far.truncate(3 << 30)  # more than one row holds: reading it would fail
    assert chunks.read_array(spark, str(tmp_path), (0, 0, 0), (2, 2, 2)).count() == 8
    assert chunks.read_array(spark, str(tmp_path), (0, 0, 4), (2, 2, 4)).count() == 0


def test_unsupported_arrays_are_refused(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        (tmp_path / "other").write_text("x")
        chunks.array_metadata(spark, str(tmp_path))
    (tmp_path / ".zarray").write_text(json.dumps({"shape": [1, 1, 1], "chunks": [1, 1, 1], "dtype": "|u1", "compressor": {"id": "zstd"}}))
    with pytest.raises(ValueError, match="uncompressed"):
        chunks.array_metadata(spark, str(tmp_path))


def test_run_configuration_is_strict():
    text = '{"volume": "v", "region": {"start": [0, 4, 8], "size": [4, 4, 4]}, "extra": {"a": {"b": 1}}}'
    run = config.parse_run(text)
    assert run.region.stop == (4, 8, 12) and run.region.scaled(4).start == (0, 1, 2)
    for bad in (text.replace("volume", "volumes"), text.replace('"size"', '"sizes"'), text.replace("[4, 4, 4]", "[4, 0, 4]")):
        with pytest.raises(ValueError):
            config.parse_run(bad)
    assert config.overridden(run.extra, {"a.c": 2, "d.e": 3}) == {"a": {"b": 1, "c": 2}, "d": {"e": 3}}
    assert config.differing({"a": 1, "b": 2}, {"b": 2, "c": 3}) == ["a", "c"]
    with pytest.raises(MemoryError):
        config.byte_budget({"block": 10}, 9)


def test_fluent_frame(spark):
    frame = VoxelFrame(grid.box_grid(spark, (0, 0, 0), (8, 8, 8)).withColumn("u", F.col("x")).withColumn("valid", F.lit(1)))
    pooled = frame.box((0, 0, 0), (4, 4, 4)).valid().pool(4, "u").rows.first()
    assert (pooled.u, pooled.cover) == (1.5, 1.0)
    assert frame.zero_crossing(F.col("u") <= 3, F.col("u") > 3).rows.where("x <> 3").count() == 0
    assert frame.shifted((1, 0, 0)).over(frame, ["u"]).rows.count() == 9 * 64
    assert {r.d2 for r in frame.distance(F.col("u") == 0, 2).rows.where("x < 4").collect()} == {0, 1, 4, None}


def test_raw_volumes_are_checked(spark, tmp_path):
    values = np.arange(24, dtype=np.uint8)
    (tmp_path / "correction.u8").write_bytes(values.tobytes())
    found = {(r.z, r.y, r.x): r.u for r in chunks.read_raw(spark, str(tmp_path), (2, 3, 4)).collect()}
    assert found == {(z, y, x): int(values.reshape(2, 3, 4)[z, y, x]) for z in range(2) for y in range(3) for x in range(4)}
    with pytest.raises(Exception, match="24 bytes, not 30"):
        chunks.read_raw(spark, str(tmp_path), (2, 3, 5)).collect()


def test_transforms_are_strict():
    given = {"schema_version": config.TRANSFORM_VERSION, "fixed_volume": "v", "transformation_matrix": [[1, 0, 0, 2], [0, 1, 0, 3], [0, 0, 1, 4]],
        "fixed_landmarks": [[1, 2, 3]]}
    read = config.parse_transform(json.dumps(given))
    assert read.matrix[3] == [0, 0, 0, 1] and read.fixed_landmarks == [[1, 2, 3]] and read.moving_landmarks == []
    for bad in ({"schema_version": "0"}, {"transformation_matrix": [[1, 0, 0]] * 3}):
        with pytest.raises(ValueError):
            config.parse_transform(json.dumps(given | bad))
    with pytest.raises(ValueError, match="fixed_volume"):
        config.parse_transform(json.dumps({k: v for k, v in given.items() if k != "fixed_volume"}))


@pytest.mark.parametrize("codec", ["zlib", "gzip"])
def test_compressed_arrays_read_back(spark, tmp_path, codec):
    data = np.random.default_rng(1).integers(0, 4, (8, 8, 8)).astype(np.uint8)
    rows = spark.createDataFrame([("s", "c", z, y, x, bytearray(data[4 * z : 4 * z + 4, 4 * y : 4 * y + 4,
        4 * x : 4 * x + 4].tobytes())) for z in range(2) for y in
        range(2) for x in range(2) if (z, y, x) != (1, 1, 1)], chunks.CHUNK_SCHEMA)
    path = f"file://{tmp_path}/array"
    chunks.write_array(rows, path, (8, 8, 8), 4, codec, 9)
    assert all(f.stat().st_size < 64 for f in (tmp_path / "array").glob("[0-9]*"))
    found = {(r.z, r.y, r.x): r.u for r in chunks.read_array(spark, path, (2, 0, 3), (6, 8, 5)).collect()}
    assert found == {(z, y, x): int(data[z, y, x]) for z in range(2, 8) for y in range(8) for x in range(3, 8) if not (z >= 4 and y >= 4 and x >= 4)}
    (tmp_path / "array" / "0.0.0").write_bytes(chunks.CODECS[codec][0](b"short", 1))
    with pytest.raises(Exception, match="5 bytes, not 64"):
        chunks.read_array(spark, path, (0, 0, 0), (4, 4, 4)).collect()


def test_existing_chunks_are_asked_for_not_listed(spark, tmp_path):
    for i in range(3000):
        (tmp_path / f"{i}.0.0").write_bytes(b"x")
    found = chunks._existing(spark, f"file://{tmp_path}", ["7.0.0", "x", "2999.0.0"])
    assert [f.rsplit("/", 1)[1] for f in found] == ["7.0.0", "2999.0.0"]


def test_only_complete_caches_are_read(spark, tmp_path):
    rows = spark.range(8 * 8 * 8).select((F.col("id") / 64).cast("int").alias("z"), (F.col("id") / 8 % 8).cast("int").alias("y"),
        (F.col("id") % 8).cast("int").alias("x"),
        F.col("id").alias("v"))
    open_cache = lambda name, box, level=0, who="me": cache.Cache(builds.BrickStore(spark, f"file://{tmp_path}/{name}", who), level, box, 4)
    whole = open_cache("whole", ((0, 0, 0), (8, 8, 8)))
    part = open_cache("part", ((0, 0, 0), (4, 8, 8)))
    assert not cache.copy_box(part, rows, 1, waves=2) and cache.footprint(part) is None
    assert cache.copy_box(whole, rows) and cache.footprint(whole) == ((0, 0, 0), (8, 8, 8))
    asked = spark.createDataFrame([(0, 0, 1, 1, 1, 2, 2, 2), (1, 0, 3, 0, 0, 3, 8, 8), (2, 1, 0, 0, 0, 1, 1, 1), (3, 0, 7, 7, 7, 2, 1, 1), (4, 0, 40, 0, 0, 1,
        1, 1)],
        "request int, level int, low_z int, low_y int, low_x int, size_z int, size_y int, size_x int")
    read = lambda caches: {(r.request, r.cache): r.n for r in cache.read_through(caches, asked, rows, 4).groupBy("request", "cache").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    assert read([part, whole]) == {(0, 1): 8, (1, 1): 192, (2, None): 1, (3, None): 1}
    assert cache.copy_box(part, rows) and read([part, whole])[0, 0] == 8 and read([whole, part])[0, 1] == 8
    assert read([open_cache("part", part.box, who="other")])[0, None] == 8  # another writer's marker proves nothing
    (tmp_path / "part" / "complete-me.json").write_text("{")
    assert cache.footprint(part) is None
    values = cache.read_through([whole], asked, rows, 4).where("request = 0").select("v").collect()
    assert sorted(r.v for r in values) == sorted(64 * z + 8 * y + x for z in (1, 2) for y in (1, 2) for x in (1, 2))
