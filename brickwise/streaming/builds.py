"""Resumable builds of brick stores: a plan of bricks, waves that read a halo and keep the cores, and a mark for every brick that is done."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickwise.operators.grid import AXES, brick_of
from brickwise.runtime import broadcast_if_small, discard, materialize, shuffled
from brickwise.streaming.incremental import pending

BRICK = [f"b{a}" for a in AXES]
MARK = "bz int, by int, bx int, wave string, fingerprint string, n long, digest long"


def planned_bricks(rows: DataFrame, edge: int) -> DataFrame:
    """(bz, by, bx) of every brick that holds a row."""
    return rows.select(*brick_of(edge)).distinct()


def within_halo(rows: DataFrame, bricks: DataFrame, edge: int, halo: int) -> DataFrame:
    """Rows that lie in one of the bricks or within ``halo`` voxels of it, each once."""
    near = rows.select(*AXES)
    for a in AXES:
        reach = F.sequence(F.floor((F.col(a) - halo) / edge).cast("int"), F.floor((F.col(a) + halo) / edge).cast("int"))
        near = near.withColumn(f"b{a}", F.explode(reach))
    return rows.join(shuffled(near.join(bricks, BRICK, "left_semi").select(*AXES).distinct()), list(AXES), "left_semi")


class BrickStore:
    """A folder of bricks, each committed once by a writer of one identity.

    A wave's rows are written first and its marks last, by one rename: rows without a mark, of a wave that failed or still runs, don't exist for readers. A
    mark counts the brick's rows and adds up their hashes, so that damage shows. Marks of another identity (another builder, other parameters) don't count:
    their bricks are built again. A brick that two writers of one identity both built is read from the wave of the lower name. ``path`` is on any file
    system that renames a folder at once and that all executors see.
    """

    def __init__(self, spark: SparkSession, path: str, identity: str):
        self.spark, self.path, self.identity = spark, path.rstrip("/"), identity

    def _fs(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def marks(self) -> DataFrame:
        """All marks, of any identity."""
        fs, target = self._fs(f"{self.path}/marks/wave=*")
        found = fs.globStatus(target)
        if found is None or not len(found):
            return self.spark.createDataFrame([], MARK)
        return self.spark.read.schema(MARK).option("basePath", f"{self.path}/marks").parquet(f"{self.path}/marks/wave=*")

    def done(self) -> DataFrame:
        """(bz, by, bx, wave, n, digest): one mark of this identity for each brick that has any."""
        own = self.marks().where(F.col("fingerprint") == self.identity)
        best = own.groupBy(*BRICK).agg(F.min(F.struct("wave", "n", "digest")).alias("_m"))
        return best.select(*BRICK, "_m.*")

    def commit(self, rows: DataFrame, bricks: DataFrame, edge: int) -> None:
        """Write rows of the planned ``bricks`` as one wave, and mark all of these, those without rows too."""
        wave = uuid.uuid4().hex
        placed = rows.select("*", *brick_of(edge)).join(bricks, BRICK, "left_semi")
        placed.write.parquet(f"{self.path}/data/wave={wave}")
        written = self.spark.read.schema(placed.schema).parquet(f"{self.path}/data/wave={wave}")
        sums = written.groupBy(*BRICK).agg(F.count(F.lit(1)).alias("n"), _digest(placed.columns).alias("digest"))
        marks = bricks.join(sums, BRICK, "left").select(*BRICK, F.lit(self.identity).alias("fingerprint"), F.coalesce("n", F.lit(0).cast("long")).alias("n"),
            F.coalesce("digest", F.lit(0).cast("long")).alias("digest"))
        marks.write.parquet(f"{self.path}/marks/_{wave}")  # names with an underscore aren't read
        fs, source = self._fs(f"{self.path}/marks/_{wave}")
        if not fs.rename(source, self._fs(f"{self.path}/marks/wave={wave}")[1]):
            raise OSError(f"marks of wave {wave} could not be renamed")

    def _all_rows(self) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/data").parquet(f"{self.path}/data/wave=*")

    def read(self) -> DataFrame:
        """Rows of all bricks that are done."""
        done = self.done().select(*BRICK, "wave")
        if done.isEmpty():
            raise FileNotFoundError(f"no brick of {self.path} is done")
        return self._all_rows().join(broadcast_if_small(done), [*BRICK, "wave"], "left_semi").drop(*BRICK, "wave")

    def damaged(self) -> DataFrame:
        """(bz, by, bx) of done bricks whose rows aren't those that were marked."""
        done = self.done()
        rows = self._all_rows()
        sums = rows.groupBy(*BRICK, "wave").agg(F.count(F.lit(1)).alias("_n"), _digest([c for c in rows.columns if c != "wave"]).alias("_digest"))
        both = done.join(sums, [*BRICK, "wave"], "left")
        same = (F.coalesce("_n", F.lit(0)) == F.col("n")) & (F.coalesce("_digest", F.lit(0)) == F.col("digest"))
        return both.where(~same).select(*BRICK)


def _digest(columns: list[str]):
    """Aggregate: the exclusive or of all rows' hashes, whatever their order."""
    return F.bit_xor(F.xxhash64(*[F.col(c) for c in sorted(columns)]))


def build(store: BrickStore, source: DataFrame, make: Callable[[DataFrame], DataFrame], edge: int, halo: int, wave_bricks: int,
    waves: int | None = None) -> int:
    """Build all bricks of ``source`` that aren't done, ``wave_bricks`` at a time; the number of waves that ran.

    ``make`` gets the rows of a wave's bricks and ``halo`` voxels around them and returns rows (z, y, x, ...); those in the bricks are kept. If no row's
    result depends on what is farther than the halo, a store is the same whatever the waves, the bricks' size and the failures on the way. A failure raises
    and loses its own wave only: another call goes on from the marks. ``waves`` stops early. A wave is a job over many bricks, so that the driver sees
    waves, not bricks.
    """
    ran = 0
    while waves is None or ran < waves:
        left = pending(planned_bricks(source, edge), store.done(), BRICK)
        bricks = materialize(left.orderBy(*BRICK).limit(wave_bricks), "wave-plan")  # side by side, so that their halos overlap
        if bricks.isEmpty():
            discard(bricks)
            break
        store.commit(make(within_halo(source, bricks, edge, halo)), bricks, edge)
        discard(bricks)
        ran += 1
    return ran


class ChannelStore:
    """Channels of one volume, each a store of bricks of its own beside the others: a channel that is added later leaves every file of the others as it was.

    Readers name the channels that they want, with the identity that wrote them: what a later writer adds, or has added half, doesn't matter to them.
    """

    def __init__(self, spark: SparkSession, path: str, edge: int):
        self.spark, self.path, self.edge = spark, path.rstrip("/"), edge

    def channel(self, name: str, identity: str) -> BrickStore:
        return BrickStore(self.spark, f"{self.path}/{name}", identity)

    def add(self, name: str, identity: str, source: DataFrame, make: Callable[[DataFrame], DataFrame], halo: int = 0, wave_bricks: int = 100_000,
        waves: int | None = None) -> int:
        """Build a channel's bricks that aren't done; ``make`` returns rows (z, y, x, name)."""
        return build(self.channel(name, identity), source, make, self.edge, halo, wave_bricks, waves)

    def read(self, channels: dict[str, str]) -> DataFrame:
        """(z, y, x, channels ...) of the bricks of which every named channel (name, identity) is done."""
        stores = [self.channel(n, i) for n, i in channels.items()]
        whole = stores[0].done().select(*BRICK)
        for store in stores[1:]:
            whole = whole.join(store.done().select(*BRICK), BRICK, "left_semi")
        whole = broadcast_if_small(whole)
        out = None
        for store, name in zip(stores, channels, strict=True):
            rows = store.read().select(*AXES, name).withColumns({b: F.floor(F.col(a) / self.edge).cast("int") for a, b in zip(AXES, BRICK, strict=True)})
            rows = rows.join(whole, BRICK, "left_semi").drop(*BRICK)
            out = rows if out is None else out.join(shuffled(rows), list(AXES))
        return out


def packet_layers(store: ChannelStore, layers: dict[str, str], leading: str) -> DataFrame:
    """(bz, by, bx, layers, complete): for each brick of any layer (name, identity) the list (layer, n, total) of those that are done and hold what was
    marked, in order, and whether the ``leading`` one is among them and none that is done is damaged. Sums are of what is read back.
    """
    found, torn = None, None
    for name, identity in layers.items():
        own = store.channel(name, identity)
        bad = own.damaged()
        sums = own.read().groupBy(*brick_of(store.edge)).agg(F.count(F.lit(1)).alias("n"), F.sum(name).alias("total"))
        good = sums.join(bad, BRICK, "left_anti").select(*BRICK, F.lit(name).alias("layer"), "n", "total")
        bad = bad.select(*BRICK, F.lit(None).cast("string").alias("layer"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("total"))
        found, torn = (good, bad) if found is None else (found.unionByName(good), torn.unionByName(bad))
    items = F.array_sort(F.collect_list(F.when(F.col("layer").isNotNull(), F.struct("layer", "n", "total"))))
    per = found.unionByName(torn).groupBy(*BRICK).agg(items.alias("layers"), F.count(F.when(F.col("layer").isNull(), 1)).alias("_torn"))
    return per.select(*BRICK, "layers", (F.exists("layers", lambda x: x["layer"] == leading) & (F.col("_torn") == 0)).alias("complete"))
