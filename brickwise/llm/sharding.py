"""Sharding: arrivals become small immutable shards, similarly sized runs are merged into target-sized files.

Merges are planned over shards and carried out over their files: a shard that arrived as many small files, or as files far above the target, is written again
as files near it, however large the whole shard is.

A store is a folder of shards (folders of Parquet files, never changed once written) and of manifests. A manifest
is one small file that lists the live shards of a version and the merged schema of all arrivals, so that a column that only some
arrivals have is kept, null in the others. It is written beside and then renamed to its version's name, which
fails if that version exists: readers see a whole version or the one before, and of two writers one has to plan again.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

SHARD = "_bw_shard"
TARGET_BYTES, FANOUT = 64 << 20, 4
#: Merged shards that one job writes.
JOB_SHARDS = 64


class Conflict(RuntimeError):
    """Another writer has committed the version."""


@dataclass(frozen=True)
class Shard:
    """A live shard: its folder under the store, its bytes on disk, the arrivals that it holds, and its files with their bytes.

    ``settled``: the target that compaction wrote it for; for that one its files are as near to it as they get on their own.
    """

    path: str
    bytes: int
    arrivals: int = 1
    files: tuple[tuple[str, int], ...] = ()
    settled: int = 0


def merged_schema(known: StructType, new: StructType, case_sensitive: bool = False) -> StructType:
    """``known`` with the columns that only ``new`` has, all nullable.

    A column of another type than before raises ValueError, and so does one whose name differs from another's in case only, unless Spark tells such names apart.
    """
    fields = {f.name: StructField(f.name, f.dataType, True) for f in known.fields}
    named = {n if case_sensitive else n.lower(): n for n in fields}
    for f in new.fields:
        other = named.setdefault(f.name if case_sensitive else f.name.lower(), f.name)
        if other != f.name:
            raise ValueError(f"columns {other} and {f.name} differ in case only")
        if f.name in fields and fields[f.name].dataType != f.dataType:
            raise ValueError(f"column {f.name} is {fields[f.name].dataType.simpleString()} in the store and {f.dataType.simpleString()} in the arrival")
        fields.setdefault(f.name, StructField(f.name, f.dataType, True))
    return StructType(list(fields.values()))


def tier(size: int, target: int, fanout: int) -> int:
    """How often a run of this size must grow by ``fanout`` to reach the target; 0 from half the target on."""
    return 0 if 2 * size >= target else math.ceil(math.log(target / max(1, size), fanout) - 1e-9)


def plan_merges(shards: list[Shard], target: int = TARGET_BYTES, fanout: int = FANOUT) -> list[list[Shard]]:
    """Groups of shards to write again: runs to merge, and single shards whose own files are far from the target.

    Within a tier, runs are taken in order until they are ``fanout`` or reach the target; a tier of less than ``fanout`` runs that don't
    reach it waits for more. Merged runs join their own tier and are planned on, so that a backlog is rewritten once. Runs that are merged are below half the
    target each, so that what they become is below one and a half.
    """
    runs = [[s] for s in sorted(shards, key=lambda s: s.path)]
    size = lambda run: sum(s.bytes for s in run)
    while True:
        tiers: dict[int, list[list[Shard]]] = {}
        for run in runs:
            tiers.setdefault(tier(size(run), target, fanout), []).append(run)
        merged, kept = [], tiers.pop(0, [])
        for members in tiers.values():
            group: list[list[Shard]] = []
            for run in members:
                group.append(run)
                if len(group) == fanout or sum(map(size, group)) >= target:
                    merged.append([s for r in group for s in r])
                    group = []
            kept += group
        runs = kept + merged
        if not merged:
            return [r for r in runs if len(r) > 1 or ragged(r[0], target)]


def too_large(size: int, target: int) -> bool:
    return 2 * size > 3 * target


def bins(files: list[tuple[str, int]], target: int) -> list[list[tuple[str, int]]]:
    """Files dealt into outputs: small ones together, from the smallest on, until they are half the target or the next would lift them above one and a half."""
    out: list[list[tuple[str, int]]] = []
    held = 0
    for file in sorted(files, key=lambda f: (f[1], f[0])):
        if out and 2 * held < target and not too_large(held + file[1], target) or out and 4 * (held + file[1]) <= 5 * target:
            out[-1].append(file)
            held += file[1]
        else:
            out.append([file])
            held = file[1]
    return out


def ragged(shard: Shard, target: int) -> bool:
    """Whether a shard that compaction hasn't written for this target has too large a file, or would have a quarter less of files."""
    if shard.settled == target or not shard.files:
        return False
    return any(too_large(size, target) for _, size in shard.files) or 4 * len(bins(list(shard.files), target)) <= 3 * len(shard.files)


class ShardStore:
    """A versioned store of shards under ``root``, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = lambda rest: self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{rest}")
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self._path("manifests")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> tuple[int, list[Shard], StructType]:
        """Version, live shards and schema; version 0 without shards for a new store."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if not version:
            return 0, [], StructType()
        text = self.spark.read.text(f"{self.root}/manifests/{version:012d}.json", wholetext=True).first()[0]
        held = json.loads(text)
        shards = [Shard(**s | {"files": tuple((n, size) for n, size in s.get("files", ()))}) for s in held["shards"]]
        return version, shards, StructType.fromJson(held["schema"])

    def commit(self, version: int, shards: list[Shard], schema: StructType) -> int:
        """Write the manifest of ``version``; raises :class:`Conflict` if there is one, and any other failure as it is."""
        hadoop = self._jvm.org.apache.hadoop.fs
        name, beside = self._path(f"manifests/{version:012d}.json"), self._path(f"manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(beside, False)
        out.write(bytearray(json.dumps({"version": version, "shards": [asdict(s) for s in shards], "schema": schema.jsonValue()}).encode()))
        out.close()
        context = hadoop.FileContext.getFileContext(self._path("").toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = getattr(hadoop, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            context.rename(beside, name, options)
        except Py4JJavaError as e:
            self._fs.delete(beside, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(f"version {version} exists") from e
            raise
        return version

    def _update(self, change: Callable[[list[Shard], StructType], tuple[list[Shard], StructType]], written: list[str]) -> int:
        """Commit a change of the newest version, again on the newer one if another writer was first; if it fails, the folders it has ``written`` go."""
        try:
            for _ in range(20):
                version, shards, schema = self.manifest()
                try:
                    return self.commit(version + 1, *change(shards, schema))
                except Conflict:
                    continue
            raise Conflict("the store changes too often")
        except Exception:
            self._discard(written)
            raise

    def _discard(self, folders: list[str]) -> None:
        for folder in folders:
            self._fs.delete(self._path(f"data/{folder}"), True)

    def _written(self, folder: str, arrivals: dict[str, int] | None = None, target: int = 0) -> list[Shard]:
        """The shards in a folder that was just written, with the sizes of their files, by one listing of the folder.

        ``arrivals``: the number of arrivals in each; ``target``: what compaction wrote them for.
        """
        found: dict[str, list[tuple[str, int]]] = {}
        base = self._path(f"data/{folder}")
        files = self._fs.listFiles(base, True) if self._fs.exists(base) else None
        while files is not None and files.hasNext():
            file = files.next()
            name = file.getPath().getParent().getName()
            if name.startswith(f"{SHARD}="):
                found.setdefault(name, []).append((file.getPath().getName(), file.getLen()))
        count = lambda name: (arrivals or {}).get(name.partition("=")[2], 1)
        return [Shard(f"data/{folder}/{name}", sum(size for _, size in held), count(name), tuple(sorted(held)), target) for name, held in
            sorted(found.items())]

    def append(self, rows: DataFrame, arrival_col: str) -> int:
        """One immutable shard per value of ``arrival_col`` (null is one), written where the rows are, without a shuffle.

        Columns that are new to the store are added to its schema; a column of another type than before, or of a name that differs from another's in case only,
        raises ValueError and nothing is stored.
        """
        folder = uuid.uuid4().hex
        cased = self.spark.conf.get("spark.sql.caseSensitive", "false") == "true"
        merged_schema(self.manifest()[2], rows.schema, cased)
        try:
            rows.withColumn(SHARD, F.coalesce(F.col(arrival_col).cast("string"), F.lit("none"))).write.partitionBy(SHARD).parquet(f"{self.root}/data/{folder}")
        except Exception:
            self._discard([folder])
            raise
        new = self._written(folder)
        return self._update(lambda shards, schema: (shards + new, merged_schema(schema, rows.schema, cased)), [folder])

    def compact(self, target: int = TARGET_BYTES, fanout: int = FANOUT) -> int | None:
        """Merge what :func:`plan_merges` says and commit; the new version, or None if there is nothing to merge.

        Each output is one file written by one task that reads about the target's size: no shuffle, and a lost task is one file to write again. Only a
        file that is too large is dealt out. If a shard was merged by another writer meanwhile, nothing is committed and the written files go.
        """
        _, live, schema = self.manifest()
        groups = plan_merges(live, target, fanout)
        if not groups:
            return None
        outputs: list[tuple[list[tuple[str, int]], int]] = []
        for group in groups:
            files = [(f"{s.path}/{name}", size) for s in group for name, size in s.files] or [(s.path, s.bytes) for s in group]
            outputs += [(part, sum(s.arrivals for s in group)) for part in ([files] if len(group) > 1 else bins(files, target))]
        new: list[Shard] = []
        written: list[str] = []
        try:
            for at in range(0, len(outputs), JOB_SHARDS):
                part = outputs[at : at + JOB_SHARDS]
                written.append(uuid.uuid4().hex)
                frames = [self._output(files, schema, target).withColumn(SHARD, F.lit(f"m{i}")) for i, (files, _) in enumerate(part)]
                reduce(DataFrame.union, frames).write.partitionBy(SHARD).parquet(f"{self.root}/data/{written[-1]}")
                new += self._written(written[-1], {f"m{i}": n for i, (_, n) in enumerate(part)}, target)
        except Exception:
            self._discard(written)
            raise
        gone = {s.path for group in groups for s in group}

        def change(shards: list[Shard], now: StructType) -> tuple[list[Shard], StructType]:
            if not gone <= {s.path for s in shards}:
                raise RuntimeError("shards of the plan are gone: plan again")
            return [s for s in shards if s.path not in gone] + new, now

        return self._update(change, written)

    def _output(self, files: list[tuple[str, int]], schema: StructType, target: int) -> DataFrame:
        rows = self.spark.read.schema(schema).parquet(*[f"{self.root}/{path}" for path, _ in files])
        size = sum(n for _, n in files)
        return rows.repartition(round(size / target)) if len(files) == 1 and too_large(size, target) else rows.coalesce(1)

    def vacuum(self, versions: int = 1) -> int:
        """Delete the shards that none of the newest ``versions`` lists; the number of deleted shards."""
        known = self.versions()
        live = {s.path for v in known[-versions:] for s in self.manifest(v)[1]}
        past = {s.path for v in known[:-versions] for s in self.manifest(v)[1]}
        for path in past - live:
            self._fs.delete(self._path(path), True)
        return len(past - live)

    def _rows(self, shards: list[Shard], schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{s.path}" for s in shards])

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version in the store's schema, None if it has no shards."""
        _, shards, schema = self.manifest(version)
        return self._rows(shards, schema) if shards else None


def shard_documents(documents: DataFrame, root: str, arrivals: int = 32, id_col: str = "doc_id", text_col: str = "text", target: int = TARGET_BYTES,
    fanout: int = FANOUT) -> DataFrame:
    """Append ``documents`` to a store in ``arrivals`` shards (by id), compact it, and return each row as read from the manifest: id, arrival, n_bytes and
    text_sha256.

    Ids may be null (arrival 0) or repeated; null texts stay null and count 0 bytes, their digest is null. An empty table gives no rows. Other
    columns are stored as they are; one that is named ``arrival`` or like the internal column is replaced.
    """
    arrival = F.coalesce(F.pmod(F.col(id_col), F.lit(arrivals)), F.lit(0)).cast("long")
    store = ShardStore(documents.sparkSession, root)
    stored = documents.withColumn("arrival", arrival)
    store.append(stored, "arrival")
    while store.compact(target, fanout):
        store.vacuum()
    rows = store.read()
    rows = stored.limit(0) if rows is None else rows
    text = F.col(text_col)
    return rows.select(F.col(id_col), "arrival", F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"),
        256).alias("text_sha256"))
