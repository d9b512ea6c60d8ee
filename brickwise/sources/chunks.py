"""Chunked volumes: one row per chunk with its voxels as bytes, and chunk files, plain or compressed, as they lie in array stores.

A chunk table is (store, channel, cz, cy, cx, data); data holds edge^3 bytes in z, y, x order. Chunk coordinates are ordinary columns, so a box
becomes range predicates that Parquet statistics and partition pruning use.
"""

from __future__ import annotations

import gzip
import json
import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickwise.operators.grid import AXES, inside

CHUNK_SCHEMA = "store string, channel string, cz int, cy int, cx int, data binary"


def pack(voxels: DataFrame, edge: int, value: str = "u", keys: tuple[str, ...] = ("store", "channel")) -> DataFrame:
    """Chunk rows of voxel rows (keys, z, y, x, value in 0..255); places without rows become 0. A chunk is assembled by one task of at most edge^3 rows."""
    at = [F.floor(F.col(a) / edge).cast("int").alias(f"c{a}") for a in AXES]
    rows = voxels.select(*keys, *at, *[(F.col(a) % edge).cast("int").alias(a) for a in AXES], F.col(value).cast("int").alias("value"))

    def assemble(frame: pd.DataFrame) -> pd.DataFrame:
        block = np.zeros((edge, edge, edge), dtype=np.uint8)
        block[frame["z"], frame["y"], frame["x"]] = frame["value"]
        return frame[[*keys, "cz", "cy", "cx"]].head(1).assign(data=[block.tobytes()])

    schema = ", ".join([*(f"{k} string" for k in keys), "cz int, cy int, cx int, data binary"])
    return rows.groupBy(*keys, "cz", "cy", "cx").applyInPandas(assemble, schema)


def unpack(chunks: DataFrame, edge: int, keys: tuple[str, ...] = ("store", "channel"), value: str = "u") -> DataFrame:
    """Voxel rows of chunk rows, all edge^3 of each."""
    place = np.indices((edge, edge, edge)).reshape(3, -1)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in (*keys, "cz", "cy", "cx", "data")}
                voxel = np.frombuffer(row["data"], dtype=np.uint8).astype(np.int32)
                at = [pa.array(place[k].astype(np.int32) + row[f"c{a}"] * edge) for k, a in enumerate(AXES)]
                yield pa.RecordBatch.from_arrays([*[pa.array([row[k]] * len(voxel), pa.string()) for k in keys], *at, pa.array(voxel)], [*keys, *AXES, value])

    schema = ", ".join([*(f"{k} string" for k in keys), "z int, y int, x int", f"{value} int"])
    return chunks.select(*keys, "cz", "cy", "cx", "data").mapInArrow(spread, schema)


def chunks_of_box(chunks: DataFrame, low: tuple[int, int, int], size: tuple[int, int, int], edge: int) -> DataFrame:
    """The chunks that a box touches."""
    out = chunks
    for a, lo, n in zip(AXES, low, size, strict=True):
        out = out.where(F.col(f"c{a}").between(math.floor(lo / edge), math.floor((lo + n - 1) / edge)))
    return out


def read_box(chunks: DataFrame, low: tuple[int, int, int], size: tuple[int, int, int], edge: int) -> DataFrame:
    """Voxels of a box: pruned to its chunks before any byte is unpacked."""
    return unpack(chunks_of_box(chunks, low, size, edge), edge).where(inside(low, size))


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Append chunk rows to a table partitioned by store and channel."""
    chunks.write.mode("append").partitionBy("store", "channel").parquet(path)


#: Codecs of chunk files, by their name in metadata: how to pack bytes at a level, and how to unpack them.
CODECS = {"zlib": (zlib.compress, zlib.decompress), "gzip": (lambda data, level: gzip.compress(data, level, mtime=0), gzip.decompress)}


def _unpacked(content: bytes, codec: str | None, size: int, name: str) -> bytes:
    data = CODECS[codec][1](content) if codec else content
    if len(data) < size:
        raise ValueError(f"chunk {name} has {len(data)} bytes, not {size}")
    return data[:size]


def array_metadata(spark: SparkSession, path: str) -> dict:
    """Shape, chunk shape, fill, key rule and codec of a byte array, from its version 2 or 3 metadata file on any file system Spark reaches.

    Chunks may be plain or packed by one of ``CODECS``; other arrays raise ValueError.
    """
    jvm = spark.sparkContext._jvm  # Spark's own readers skip files whose names begin with a dot

    def load(name: str) -> dict | None:
        file = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        system = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(file):
            return None
        stream = system.open(file)
        try:
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    two, three = load(".zarray"), None
    if two is None:
        three = load("zarr.json")
    if two:
        packed = (two["compressor"] or {}).get("id")
        if packed not in (None, *CODECS) or two.get("filters") or two["dtype"] not in ("|u1", "u1"):
            raise ValueError(f"{path} isn't an uncompressed byte array, nor one packed by {', '.join(CODECS)}")
        return {"codec": packed, "shape": two["shape"], "chunks": two["chunks"], "fill": two.get("fill_value") or 0, "prefix": "",
            "separator": two.get("dimension_separator",
            ".")}
    if not three:
        raise FileNotFoundError(f"{path} has no array metadata")
    first, *packed = [c["name"] for c in three["codecs"]]
    if first != "bytes" or packed not in ([], *([c] for c in CODECS)) or three["data_type"] != "uint8":
        raise ValueError(f"{path} isn't an uncompressed byte array, nor one packed by {', '.join(CODECS)}")
    key = three["chunk_key_encoding"]
    separator = key.get("configuration", {}).get("separator", "/" if key["name"] == "default" else ".")
    return {"codec": packed[0] if packed else None, "shape": three["shape"], "chunks": three["chunk_grid"]["configuration"]["chunk_shape"],
        "fill": three["fill_value"],
        "prefix": f"c{separator}" if key["name"] == "default" else "", "separator": separator}


def _existing(spark: SparkSession, path: str, names: list[str]) -> list[str]:
    """Those of the named files under a folder that exist: each is asked for, nothing is listed, however many files the folder holds."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    system = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f"{path}/{name}" for name in names if system.exists(hadoop.Path(f"{path}/{name}"))]


def read_array(spark: SparkSession, path: str, low: tuple[int, int, int], size: tuple[int, int, int]) -> DataFrame:
    """(z, y, x, u) of a box of a chunked byte array, plain or compressed: only the chunk files that the box touches are opened.

    Leading axes are pinned to 0. Places outside the array, and of chunks that were never written, give no rows. A chunk that doesn't unpack to its size
    fails the query.
    """
    meta = array_metadata(spark, path)
    lead = len(meta["shape"]) - 3
    shape, edges = meta["shape"][lead:], meta["chunks"][lead:]
    ranges = [range(max(0, lo) // e, (min(n, lo + s) - 1) // e + 1) for lo, s, n, e in zip(low, size, shape, edges, strict=True)]
    keys = [meta["prefix"] + meta["separator"].join(["0"] * lead + [str(c) for c in (z, y, x)]) for z in ranges[0] for y in ranges[1] for x in ranges[2]]
    found = _existing(spark, path, keys)
    if not found:
        return spark.range(0).select(*[F.col("id").cast("int").alias(c) for c in (*AXES, "u")])
    pattern = rf"/({meta['prefix'] and 'c[./]'}(?:[0-9]+[./])*[0-9]+)$"
    named = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load(found).select(F.regexp_extract("path", pattern, 1).alias("key"),
        "content")
    place = np.indices(edges).reshape(3, -1)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, content in zip(batch.column("key").to_pylist(), batch.column("content").to_pylist(), strict=True):
                at = [int(c) for c in key.replace(".", "/").split("/")[-3:]]
                voxel = np.frombuffer(_unpacked(content, meta["codec"], math.prod(edges), key), dtype=np.uint8).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*[pa.array((place[k] + at[k] * edges[k]).astype(np.int32)) for k in range(3)], pa.array(voxel)], [*AXES, "u"])

    rows = named.select("key", "content").mapInArrow(spread, "z int, y int, x int, u int")
    return rows.where(inside(low, size)).where(inside((0, 0, 0), tuple(shape)))


def write_array(packed: DataFrame, path: str, shape: tuple[int, int, int], edge: int, codec: str | None = None, level: int = 1) -> None:
    """Chunk rows (cz, cy, cx, data) as the files of a version 2 byte array, plain or packed by a codec, written by the tasks that hold them.

    The path is a URI of a file system that Arrow knows and all executors share. Each file is written beside and then moved to its name, so that a
    task that is run again gives the same files and no reader sees a part of one.
    """
    spark = packed.sparkSession
    named = packed.select(F.concat_ws(".", *[F.col(f"c{a}").cast("string") for a in AXES]).alias("name"), "data")
    _write_metadata(spark, path, {"zarr_format": 2, "shape": list(shape), "chunks": [edge] * 3, "dtype": "|u1", "compressor": {"id": codec,
        "level": level} if codec else None, "fill_value": 0,
        "order": "C", "filters": None})

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, data in zip(batch.column("name").to_pylist(), batch.column("data").to_pylist(), strict=True):
                beside = f"{root}/.{name}-{uuid.uuid4().hex}"
                with system.open_output_stream(beside) as out:
                    out.write(CODECS[codec][0](data, level) if codec else data)
                system.move(beside, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    named.mapInArrow(write, "n long").agg(F.sum("n")).first()


def _write_metadata(spark: SparkSession, path: str, metadata: dict) -> None:
    jvm = spark.sparkContext._jvm
    file = jvm.org.apache.hadoop.fs.Path(f"{path}/.zarray")
    out = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(file, True)
    out.write(bytearray(json.dumps(metadata).encode()))
    out.close()


def read_raw(spark: SparkSession, path: str, size: tuple[int, int, int]) -> DataFrame:
    """(file, z, y, x, u) of raw files of bytes in z, y, x order under a path, one volume of ``size`` each; a file of another size fails the query."""
    voxels = math.prod(size)
    files = spark.read.format("binaryFile").load(path)
    sure = F.when(F.col("length") == voxels, F.col("content")).otherwise(
        F.raise_error(F.concat(F.col("path"), F.lit(": "), F.col("length").cast("string"), F.lit(f" bytes, not {voxels}"))).cast("binary"))
    place = np.indices(size).reshape(3, -1).astype(np.int32)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                values = np.frombuffer(content, dtype=np.uint8).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([name] * voxels), *map(pa.array, place), pa.array(values)], ["file", *AXES, "u"])

    return files.select("path", sure.alias("content")).mapInArrow(spread, "file string, z int, y int, x int, u int")
