"""Operators on ordered samples (ray_id, k, v): unwrapping, runs, peaks and periods."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from brickwise.operators.prefix import running_sums
from brickwise.runtime import broadcast_if_small, discard, materialize, range_table


def _order() -> WindowSpec:
    return Window.partitionBy("ray_id").orderBy("k")


#: Samples of a ray that one task orders.
RAY_SAMPLES = 4_000_000


def _fits(samples: DataFrame) -> bool:
    """Whether no ray is longer than a task orders; the rays are counted for it."""
    return (samples.groupBy("ray_id").count().agg(F.max("count")).first()[0] or 0) <= RAY_SAMPLES


def _keyed(samples: DataFrame) -> DataFrame:
    """With ``_ray``, the ray's id as a text that isn't null."""
    return samples.withColumn("_ray", F.to_json(F.struct("ray_id"), {"ignoreNullFields": "false"}))


def neighbours(samples: DataFrame, values: list[str]) -> DataFrame:
    """``samples`` with ``before`` and ``after``: structs of the values of the sample before and after on the same ray, null at its ends.

    Rays of RAY_SAMPLES at most are ordered by a task each. Longer ones are dealt into ordered ranges; each range is told the last sample of the range before it and
    the first of the one after, so that a ray may hold any share of the samples.
    """
    row = F.struct(*values)
    if _fits(samples):
        return samples.withColumns({"before": F.lag(row).over(_order()), "after": F.lead(row).over(_order())})
    ranged = range_table(_keyed(samples), ["_ray", "k"], "rays")
    within = Window.partitionBy("_bw_part", "_ray").orderBy("k")
    local = ranged.withColumns({"before": F.lag(row).over(within), "after": F.lead(row).over(within)})
    ends = ranged.groupBy("_bw_part", "_ray").agg(F.min_by(row, "k").alias("_low"), F.max_by(row, "k").alias("_high"))
    along = Window.partitionBy("_ray").orderBy("_bw_part")  # a row per range that the ray touches
    ends = ends.select("_bw_part", "_ray", F.lag("_high").over(along).alias("_before"), F.lead("_low").over(along).alias("_after"))
    both = local.join(broadcast_if_small(ends), ["_bw_part", "_ray"])
    return both.select(*samples.columns, F.coalesce("before", "_before").alias("before"), F.coalesce("after", "_after").alias("after"))


def summed(samples: DataFrame, values: dict[str, Column]) -> DataFrame:
    """``samples`` with running sums along each ray, the sample's own value included, of any length of ray as :func:`neighbours`."""
    if _fits(samples):
        return samples.withColumns({n: F.sum(c).over(_order()) for n, c in values.items()})
    own = _keyed(samples).withColumns({f"_own_{n}": c for n, c in values.items()})
    before = running_sums(own, ["k"], {f"_own_{n}": n for n in values}, "ray-sums", ["_ray"])
    return before.select(*samples.columns, *[(F.col(n) + F.col(f"_own_{n}")).alias(n) for n in values])


def unwrap(samples: DataFrame, angle: str) -> DataFrame:
    """``samples`` with ``wraps``, the turns to add to each angle so that no step exceeds half a turn, and ``unwrapped``, zero at the first."""
    near = neighbours(samples, [angle])
    step = F.col(angle) - F.col("before")[angle]
    wrap = F.when(step > math.pi, -1).when(step < -math.pi, 1).otherwise(0)
    wound = summed(near.withColumn("_wrap", wrap).drop("before", "after"), {"wraps": F.col("_wrap")}).drop("_wrap")
    first = samples.groupBy(F.col("ray_id").alias("_id")).agg(F.min_by(angle, "k").alias("_first"))
    both = wound.join(first, F.col("ray_id").eqNullSafe(F.col("_id"))).drop("_id")
    return both.withColumn("unwrapped", F.col(angle) + 2 * math.pi * F.col("wraps") - F.col("_first")).drop("_first")


def runs(samples: DataFrame, member: Column) -> DataFrame:
    """(ray_id, start, length, inner_run) of the maximal runs of members; inner runs touch neither end of their ray."""
    near = neighbours(samples.withColumn("_in", F.coalesce(member, F.lit(False))), ["_in", "k"])
    opens = F.col("_in") & ~F.coalesce(F.col("before._in") & (F.col("before.k") == F.col("k") - 1), F.lit(False))
    marked = summed(near.withColumn("_opens", opens.cast("long")).drop("before", "after"), {"_run": F.col("_opens")}).where("_in")
    last = samples.groupBy(F.col("ray_id").alias("_id")).agg(F.max("k").alias("_last"))
    found = marked.groupBy("ray_id", "_run").agg(F.min("k").alias("start"), F.count(F.lit(1)).alias("length"), F.max("k").alias("_end"))
    found = found.join(last, F.col("ray_id").eqNullSafe(F.col("_id")))
    return found.select("ray_id", "start", "length", ((F.col("start") > 0) & (F.col("_end") < F.col("_last"))).alias("inner_run"))


def local_maxima(samples: DataFrame, least: float) -> DataFrame:
    """Samples not below the one before, above the one after, and at least ``least``; the ends of a ray are none."""
    near = neighbours(samples, ["v"])
    return near.where((F.col("v") >= F.col("before.v")) & (F.col("v") > F.col("after.v")) & (F.col("v") >= least)).drop("before", "after")


#: Peaks of one run that a task solves at once.
RUN_PEAKS = 4_000_000


def spaced_peaks(peaks: DataFrame, distance: int) -> DataFrame:
    """(ray_id, k, v): the highest peaks, none closer than ``distance`` to a higher one that is taken; of equal ones the first in place counts as higher.

    Peaks that are ``distance`` apart or more don't matter to each other: a ray is cut there into runs, and each run is solved in one pass by one task,
    however its heights rise or fall. Runs of over RUN_PEAKS peaks are solved in rounds of neighbours instead, in each of which their highest open peak is
    taken.
    """
    cut = F.coalesce(F.col("k") - F.lag("k").over(_order()) >= distance, F.lit(True)).cast("long")
    marked = peaks.select("ray_id", F.col("k").cast("long").alias("k"), F.col("v").cast("double").alias("v")).withColumn("_cut", cut)
    marked = materialize(marked.select("ray_id", "k", "v", F.sum("_cut").over(_order()).alias("_run")), "peak-runs")
    long = materialize(marked.groupBy("ray_id", "_run").count().where(F.col("count") > RUN_PEAKS).select("ray_id", "_run"), "long-runs")
    short, rest = marked, None
    if not long.isEmpty():
        short, rest = (marked.join(long, ["ray_id", "_run"], how) for how in ("left_anti", "left_semi"))

    def solve(run: pa.Table) -> pa.Table:
        run = run.sort_by("k")
        k, v = run.column("k").to_numpy(), run.column("v").to_numpy()
        low, high = np.searchsorted(k, k - distance, "right"), np.searchsorted(k, k + distance, "left")
        taken, closed = np.zeros(len(k), dtype=bool), np.zeros(len(k), dtype=bool)
        for i in np.lexsort((k, -v)).tolist():
            if not closed[i]:
                taken[i] = True
                closed[low[i] : high[i]] = True
        return run.filter(pa.array(taken)).drop_columns(["_run"])

    schema = marked.drop("_run").schema
    out = short.groupBy("ray_id", "_run").applyInArrow(solve, schema)
    return out if rest is None else out.unionByName(_in_rounds(rest.drop("_run"), distance))


def _in_rounds(peaks: DataFrame, distance: int) -> DataFrame:
    """A peak that is the highest of all open ones closer than the distance is taken, and closes these, until none is open."""
    near = Window.partitionBy("ray_id").orderBy("k").rangeBetween(-(distance - 1), distance - 1)
    rank = F.struct(F.col("v"), -F.col("k"))
    still = materialize(peaks, "open-peaks")
    taken: list[DataFrame] = []
    while not still.isEmpty():
        judged = still.withColumn("_top", F.max(rank).over(near) == rank).withColumn("_closed", F.max("_top").over(near))
        judged = materialize(judged, "peaks")
        discard(still)
        taken.append(judged.where("_top").select("ray_id", "k", "v"))
        still = materialize(judged.where("not _closed").select("ray_id", "k", "v"), "open-peaks")
    return reduce(DataFrame.unionByName, taken, still)


def dominant_period(samples: DataFrame, least: float, most: float) -> DataFrame:
    """(ray_id, period): where the Fourier amplitude is largest between two periods; null for rays too short for it."""

    def peak(frame: pd.DataFrame) -> pd.DataFrame:
        v = frame.sort_values("k")["v"].fillna(0.0).to_numpy(dtype=float)
        frequency = np.fft.rfftfreq(len(v))
        fits = (frequency >= 1 / most) & (frequency <= 1 / least)
        amplitude = np.abs(np.fft.rfft(v - v.mean()))
        period = round(float(1 / frequency[fits][amplitude[fits].argmax()]), 6) if fits.any() else None
        return pd.DataFrame({"ray_id": [frame["ray_id"].iloc[0]], "period": [period]}).astype({"period": "float64"})

    return samples.select("ray_id", "k", "v").groupBy("ray_id").applyInPandas(peak, "ray_id long, period double")


def autocorrelation_length(samples: DataFrame) -> DataFrame:
    """(ray_id, lag): the first lag at which the normalised autocorrelation is below 1/e; null for constant rays and if there is none.

    All lags of a ray by one transform of twice its length.
    """

    def length(frame: pd.DataFrame) -> pd.DataFrame:
        v = frame.sort_values("k")["v"].fillna(0.0).to_numpy(dtype=float)
        v = v - v.mean()
        power = float(v @ v)
        lag = None
        if power > 0:
            spectrum = np.fft.rfft(v, 2 * len(v))
            low = np.nonzero(np.fft.irfft(spectrum * spectrum.conj(), 2 * len(v))[1 : len(v)] / power < 1 / math.e)[0]
            lag = int(low[0]) + 1 if len(low) else None
        return pd.DataFrame({"ray_id": [frame["ray_id"].iloc[0]], "lag": [lag]}).astype({"lag": "float64"})

    return samples.select("ray_id", "k", "v").groupBy("ray_id").applyInPandas(length, "ray_id long, lag double")


def per_period(samples: DataFrame, window: int, step: int, least: float, most: float, valid_share: float = 0.95) -> DataFrame:
    """(ray_id, start, amount): for each window with enough valid samples the mean value times the dominant period.

    Samples are handed to the windows that hold them, so that windows, not rays, are the unit of work.
    """
    starts = F.sequence(F.greatest(F.lit(0), F.ceil((F.col("k") - window + 1) / step)).cast("int"), F.floor(F.col("k") / step).cast("int"))
    spread = samples.select("ray_id", "k", "v", "valid", F.explode(starts).alias("start")).withColumn("start", F.col("start") * step)
    full = spread.groupBy("ray_id", "start").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("valid").cast("double")).alias("share"),
        F.avg("v").alias("mean")).where((F.col("n") == window) & (F.col("share") >= valid_share))
    keyed = spread.join(full.select("ray_id", "start", "mean"), ["ray_id", "start"]).withColumn("ray", F.xxhash64("ray_id", "start"))
    period = dominant_period(keyed.select(F.col("ray").alias("ray_id"), "k", "v"), least, most)
    named = keyed.select("ray", "ray_id", "start", "mean").distinct()
    return named.join(period.withColumnRenamed("ray_id", "ray"), "ray").select("ray_id", "start", F.round(F.col("mean") * F.col("period"), 6).alias("amount"))
