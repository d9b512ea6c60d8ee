"""Incremental builds, marker logs and event windows: the same functions serve batch and Structured Streaming frames.

Builds are defined by their batch result: a build that resumes where it stopped, and the last state in a log. A stream gives
the same result as a batch over all of its input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Marker lines: PREP_<region>_<stage>_<event>.
MARKER = r"\bPREP_([A-Za-z0-9]+)_(bands|teachers|labels)_(START|DONE|FAILED)\b"


def fingerprint(*parts: str) -> str:
    """Identity of a writer: completion marks of another identity don't count."""
    return hashlib.sha256("\x1f".join(parts).encode()).hexdigest()[:16]


def pending(plan: DataFrame, done: DataFrame, keys: list[str], identity: str | None = None) -> DataFrame:
    """Planned rows that aren't done; with an identity only the marks of that writer count."""
    marks = done.where(F.col("fingerprint") == identity) if identity is not None else done
    return plan.join(marks.select(*keys).distinct(), keys, "left_anti")


def complete_bricks(done: DataFrame, brick: list[str], channels: int) -> DataFrame:
    """Bricks of which every channel is done."""
    return done.groupBy(*brick).agg(F.countDistinct("channel").alias("_n")).where(F.col("_n") == channels).select(*brick)


def is_complete(plan: DataFrame, done: DataFrame, keys: list[str]) -> bool:
    return pending(plan, done, keys).isEmpty()


def build_increment(source: DataFrame, build: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Run a brick build over a stream's micro-batches, each once: the sink is keyed by batch, so that a batch that is tried again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        build(batch).write.mode("overwrite").parquet(f"{target}/batch={number:08d}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_increments(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target).drop("batch")


def markers(lines: DataFrame, line: str = "line", order: str = "line_no") -> DataFrame:
    """(order, place, region, stage, event) of every marker in every line."""
    found = F.regexp_extract_all(F.col(line), F.lit(MARKER), F.lit(0))
    spread = lines.select(order, F.posexplode(found).alias("place", "marker"))
    part = lambda i: F.regexp_extract("marker", MARKER, i)
    return spread.select(order, "place", part(1).alias("region"), part(2).alias("stage"), part(3).alias("event"))


def last_states(found: DataFrame, order: str = "line_no") -> DataFrame:
    """Last event per region and stage, by place in the log, not by time stamps."""
    return found.groupBy("region", "stage").agg(F.max_by("event", F.struct(order, "place")).alias("event"))


def tumbling(events: DataFrame, time: str, width: str, late: str | None = None) -> DataFrame:
    """Counts and sums of ``value`` by window and event type; ``late`` sets a watermark for streams."""
    rows = events.withWatermark(time, late) if late else events
    return rows.groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"),
        F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, time: str, gap: str, user: str = "user_id", late: str | None = None) -> DataFrame:
    rows = events.withWatermark(time, late) if late else events
    return rows.groupBy(F.session_window(time, gap).alias("w"), user).agg(F.count(F.lit(1)).alias("n")).select(user, F.col("w.start").alias("start"),
        F.col("w.end").alias("end"), "n")
