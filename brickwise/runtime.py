"""Shared scratch tables: how operators cut lineage so that a lost executor never costs the whole job."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_roots: dict[str, str] = {}
_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` where the cluster names one.

    Only where it is unset and all tasks run in this machine's JVM (tests, a laptop) a temporary folder is made, once for each
    application. On a cluster without the setting each executor would write to its own disk: that raises RuntimeError.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/") + "/brickwise"
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = "file://" + tempfile.mkdtemp(prefix="brickwise-")
    return _local_roots[app]


#: Spark's setting (from 4.1 on; unknown and without effect before) that a query's shuffle files are deleted when it ends, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_end_here(spark: SparkSession) -> Iterator[None]:
    """For what is written within: nothing reads its shuffles again once it is written."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and return a reader of it.

    Later jobs read the table instead of recomputing the plan, see one fixed set of rows even if
    ``df`` isn't deterministic across runs (range bounds, partition ids), and survive the loss of
    any executor. The folder may be emptied once the session has ended; :func:`discard` deletes a table before.
    The shuffle files of the write are deleted with its end.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    with shuffles_end_here(spark):
        df.write.parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    _written[read] = path
    return read


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialize` wrote and that nothing will read again; others are left alone."""
    for df in tables:
        if path := _written.pop(df, None):
            target = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def range_table(df: DataFrame, order_by: list[str], label: str, part: str = "_bw_part") -> DataFrame:
    """``df`` dealt into ordered ranges of ``order_by``, written once, with the range's number in ``part``.

    Range number grows with the order; rows within one range aren't sorted. Written so that range
    bounds are fixed for all later uses.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *[F.col(c) for c in order_by])
    return materialize(ranged.withColumn(part, F.spark_partition_id()), label)


def broadcast_if_small(keys: DataFrame, most_rows: int = 2_000_000) -> DataFrame:
    """``keys`` (a narrow table that is cheap to count) marked for broadcast if it has few enough rows; else for a shuffled join."""
    return F.broadcast(keys) if keys.count() <= most_rows else keys.hint("merge")


def shuffled(side: DataFrame) -> DataFrame:
    """``side``, a table of places, for a shuffled join whatever its files say.

    Spark goes by the size of Parquet files and takes what is exploded from them for as large. Places pack well: millions fit few MB of files, and
    each takes some 100 bytes of the driver in a broadcast.
    """
    return side.hint("merge")


#: Rows of a narrow table that take about 25 MB of the driver in a broadcast.
SMALL_ROWS = 250_000


def merged_if_large(side: DataFrame, rows: int | None = None) -> DataFrame:
    """``side`` (cheap to count, or of about ``rows`` rows) for a join that Spark is free to choose if it has few enough rows; else for a shuffled one.

    Spark goes by the size of Parquet files: below its limit of 10 MB there may be millions of rows, each of which takes some 100 bytes in a broadcast.
    """
    return side.hint("merge") if (side.count() if rows is None else rows) > SMALL_ROWS else side
