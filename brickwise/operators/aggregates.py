"""Masked, weighted and pooled aggregates, overlap scores and ranking metrics.

Functions named for aggregates return columns for ``agg``. What an empty set gives differs by measure and is stated with each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brickwise.operators.grid import AXES, _all
from brickwise.operators.prefix import running_sums
from brickwise.runtime import broadcast_if_small


def masked_mean(x: Column, mask: Column) -> Column:
    """Sum of x over the mask's sum, which counts as 1 at least: 0 for an empty mask."""
    return F.sum(x * mask) / F.greatest(F.sum(mask), F.lit(1.0))


def mean_where(x: Column, condition: Column) -> Column:
    """Mean where the condition holds; null if it holds nowhere."""
    return F.avg(F.when(condition, x))


def dice(a: Column, b: Column, empty: float | None = None) -> Column:
    """2 |a and b| / (|a| + |b|) of two conditions; ``empty`` (null, 0 or 1) if neither holds anywhere."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    both = count(a) + count(b)
    return F.when(both > 0, 2 * count(a & b) / both).otherwise(F.lit(empty).cast("double"))


def iou(a: Column, b: Column, empty: float | None = None) -> Column:
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return F.when(count(a | b) > 0, count(a & b) / count(a | b)).otherwise(F.lit(empty).cast("double"))


#: Values of a group that one task ranks.
ONE_TASK = 1_000_000


def percentiles(rows: DataFrame, value: str, group: list[str], shares: dict[str, float]) -> DataFrame:
    """Per group exact, interpolated percentiles of a numeric column: a column for each item (name, share) of ``shares``; null for a group without values.

    Groups of ``ONE_TASK`` values at most (they are counted first) are ranked by a task each. Where one is larger, distinct values are counted, dealt into ordered
    ranges and ranked by running sums: a group of any size and any spread, outliers included, is over many tasks. Nulls and NaN aren't values.
    """
    known = rows.select(*group, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    most = known.groupBy(*group).count().agg(F.max("count")).first()[0]
    if (most or 0) <= ONE_TASK:
        value = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
        return rows.groupBy(*group).agg(*[F.percentile(value, F.lit(s)).alias(n) for n, s in shares.items()])
    key = F.to_json(F.struct(*group), {"ignoreNullFields": "false"}) if group else F.lit("")
    counted = known.withColumn("_key", key).groupBy("_key", "_v").agg(F.count(F.lit(1)).alias("_c"))
    placed = running_sums(counted, ["_v"], {"_c": "_at"}, "percentile-ranks", ["_key"])
    sizes = broadcast_if_small(placed.groupBy("_key").agg(F.sum("_c").alias("_n")))
    ranks = {f"{n}{end}": f(F.col("_n") - 1, share) for n, share in shares.items() for end, f in (("_lo", lambda n, s: F.floor(n * s)),
        ("_hi", lambda n, s: F.ceil(n * s)))}
    at = lambda rank: F.max(F.when((rank >= F.col("_at")) & (rank < F.col("_at") + F.col("_c")), F.col("_v")))
    found = placed.join(sizes, "_key").groupBy("_key").agg(F.first("_n").alias("_n"), *[at(rank).alias(n) for n, rank in ranks.items()])

    def interpolated(name: str, share: float) -> Column:
        place, low, high = (F.col("_n") - 1) * share, F.col(f"{name}_lo"), F.col(f"{name}_hi")
        between = (F.ceil(place) - place) * low + (place - F.floor(place)) * high
        return F.when(low == high, low).otherwise(between).alias(name)

    found = found.select("_key", *[interpolated(n, s) for n, s in shares.items()])
    every = rows.select(*group).distinct() if group else rows.sparkSession.range(1).select()
    return every.withColumn("_key", key).join(found, "_key", "left").select(*group, *shares)


def distributions(rows: DataFrame, value: str, group: list[str]) -> DataFrame:
    """Per group n, mean, population deviation and five percentiles of a column, rounded to six digits."""
    stats = rows.groupBy(*group).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_pop(value), 6).alias("std"))
    shares = {f"p{p}": p / 100 for p in (5, 25, 50, 75, 95)}
    found = percentiles(rows, value, group, shares)
    same = _all(F.lit(True), *[stats[g].eqNullSafe(found[g]) for g in group])
    return stats.join(found, same).select(*[stats[g] for g in group], "n", "mean", "std", *[F.round(n, 6).alias(n) for n in shares])


def weighted_percentile(value: str, p: float, count: str) -> Column:
    """Aggregate: interpolated percentile of values with counts, as if each value was repeated."""
    return F.percentile(F.col(value), F.lit(p), F.col(count))


def lower_order_statistic(hist: DataFrame, value: str, count: str, p: float, group: list[str]) -> DataFrame:
    """Per group the first value whose running count reaches the share ``p`` of the total: no interpolation."""
    order = Window.partitionBy(*group).orderBy(value)
    total = F.sum(count).over(Window.partitionBy(*group))
    reached = hist.withColumn("_run", F.sum(count).over(order)).withColumn("_all", total).where(F.col("_run") >= p * F.col("_all"))
    return reached.groupBy(*group).agg(F.min(value).alias(value))


def pool(rows: DataFrame, factor: int, value: str, mask: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Masked mean and cover of ``value`` in blocks of factor^3; an empty mask gives 0."""
    keys = [F.floor(F.col(a) / factor).cast("int").alias(a) for a in AXES]
    weight = mask.cast("double")
    return rows.groupBy(*keep, *keys).agg(masked_mean(F.col(value).cast("double"), weight).alias(value), (F.sum(weight) / float(factor**3)).alias("cover"))


def pyramid(rows: DataFrame, value: str, levels: int) -> DataFrame:
    """(level, z, y, x, value): means of 2^3 voxels that are there, level after level."""
    out, level = rows.select(F.lit(0).alias("level"), *AXES, F.col(value).cast("double").alias(value)), rows.select(*AXES,
        F.col(value).cast("double").alias(value))
    for k in range(1, levels + 1):
        level = level.groupBy(*[F.floor(F.col(a) / 2).cast("int").alias(a) for a in AXES]).agg(F.avg(value).alias(value))
        out = out.unionByName(level.select(F.lit(k).alias("level"), *AXES, value))
    return out


def per_sample_mean(rows: DataFrame, sample: str, x: Column, mask: Column) -> DataFrame:
    """One row: the masked means of the samples with a mask, averaged; 0 without any."""
    per = rows.groupBy(sample).agg(masked_mean(x, mask).alias("_m"), F.sum(mask).alias("_n"))
    return per.agg((F.sum(F.when(F.col("_n") > 0, F.col("_m")).otherwise(0.0)) / F.greatest(F.count(F.when(F.col("_n") > 0, 1)), F.lit(1))).alias("mean"))


def _by_score(rows: DataFrame, score: str, positive: str, group: list[str]) -> DataFrame:
    """Counts per distinct score, so that ties are one threshold and only distinct scores are sorted."""
    return rows.where(F.col(score).isNotNull()).groupBy(*group, score).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(positive).cast("long")).alias("_p"))


def _summed_before(tied: DataFrame, score: str, group: list[str], down: bool) -> DataFrame:
    """``tied`` with ``_sn`` and ``_sp``, the counts of all rows of the group with a lower score (a higher one, if ``down``).

    A group of ONE_TASK distinct scores at most is summed by one task; where one has more, all are dealt into ordered ranges.
    """
    most = tied.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    if most <= ONE_TASK:
        before = Window.partitionBy(*group).orderBy(F.desc(score) if down else score).rowsBetween(Window.unboundedPreceding, -1)
        return tied.withColumns({f"_s{c}": F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)) for c in "np"})
    key = F.to_json(F.struct(*group), {"ignoreNullFields": "false"}) if group else F.lit("")
    keyed = tied.withColumns({"_key": key, "_at": -F.col(score) if down else F.col(score)})
    return running_sums(keyed, ["_at"], {"_n": "_sn", "_p": "_sp"}, "ranked", ["_key"]).drop("_key", "_at")


def average_precision(rows: DataFrame, score: str, positive: str, group: list[str]) -> DataFrame:
    """Step-wise area under precision and recall per group; null unless both classes occur."""
    summed = _summed_before(_by_score(rows, score, positive, group), score, group, True)
    share = F.col("_p") * (F.col("_sp") + F.col("_p")) / (F.col("_sn") + F.col("_n"))
    total = summed.groupBy(*group).agg(F.sum("_p").alias("_P"), F.sum("_n").alias("_N"), F.sum(share).alias("_area"))
    return total.select(*group, F.when((F.col("_P") > 0) & (F.col("_P") < F.col("_N")), F.col("_area") / F.col("_P")).alias("average_precision"))


def auroc(rows: DataFrame, score: str, positive: str, group: list[str]) -> DataFrame:
    """Rank-sum area under the ROC curve per group, ties by their mean rank; null unless both classes occur."""
    summed = _summed_before(_by_score(rows, score, positive, group), score, group, False)
    won = summed.withColumn("_w", F.col("_p") * (F.col("_sn") - F.col("_sp") + (F.col("_n") - F.col("_p")) / 2))
    total = won.groupBy(*group).agg(F.sum("_w").alias("_w"), F.sum("_p").alias("_P"), F.sum(F.col("_n") - F.col("_p")).alias("_Q"))
    return total.select(*group, F.when((F.col("_P") > 0) & (F.col("_Q") > 0), F.col("_w") / (F.col("_P") * F.col("_Q"))).alias("auroc"))


def wasserstein1(hist: DataFrame, value: str, a: str, b: str, width: float) -> DataFrame:
    """One row: distance between two histograms over the same bins of a width."""
    order = Window.partitionBy(F.lit(0)).orderBy(value)  # a row per bin
    total = hist.agg(F.sum(a).alias("_ta"), F.sum(b).alias("_tb"))
    shares = hist.crossJoin(F.broadcast(total)).select(value, (F.col(a) / F.col("_ta")).alias("_a"), (F.col(b) / F.col("_tb")).alias("_b"))  # one row
    return shares.withColumn("_d", F.abs(F.sum(F.col("_a") - F.col("_b")).over(order))).agg((F.sum("_d") * width).alias("w1"))


def robust_normalise(rows: DataFrame, value: str, group: list[str], low: float = 0.01, high: float = 0.99, name: str = "normalised") -> DataFrame:
    """Values clipped to two percentiles of their group, less the median, over 1.4826 times the median absolute deviation.

    If that is below 1e-6, over the deviation before clipping, else half the span of the percentiles, else 1.
    """
    # clipping keeps the order and the middle values, so that the median of the clipped is the median
    ends = percentiles(rows, value, group, {"_lo": low, "_mid": 0.5, "_hi": high}).join(rows.groupBy(*group).agg(F.stddev_pop(value).alias("_sd")), group)
    centred = rows.join(broadcast_if_small(ends), group).withColumn("_c", F.greatest("_lo", F.least("_hi", value)) - F.col("_mid"))
    middle = percentiles(centred.withColumn("_off", F.abs("_c")), "_off", group, {"_mad": 0.5}).withColumn("_mad", 1.4826 * F.col("_mad"))
    mad = broadcast_if_small(middle)
    span = (F.col("_hi") - F.col("_lo")) / 2
    spread = F.when(F.col("_mad") >= 1e-6, F.col("_mad")).when(F.col("_sd") >= 1e-6, F.col("_sd")).when(span >= 1e-6, span).otherwise(1.0)
    return centred.join(mad, group).withColumn(name, F.col("_c") / spread).select(*rows.columns, name)


def zscore(rows: DataFrame, value: str, group: list[str], sample: bool = False, name: str = "normalised") -> DataFrame:
    """Values less their group's mean over its deviation: the population's, at least 1e-8, or the sample's, at least 1e-3."""
    deviation = F.greatest(F.coalesce(F.stddev_samp(value), F.lit(0.0)), F.lit(1e-3)) if sample else F.greatest(F.stddev_pop(value), F.lit(1e-8))
    stats = rows.groupBy(*group).agg(F.avg(value).alias("_mean"), deviation.alias("_sd"))
    return rows.join(stats, group).withColumn(name, (F.col(value) - F.col("_mean")) / F.col("_sd")).select(*rows.columns, name)


def percentile_minmax(rows: DataFrame, value: str, group: list[str], low: float, high: float, name: str = "normalised") -> DataFrame:
    """Values between two percentiles of their group as 0 to 1, clipped; 0 where both are equal."""
    ends = broadcast_if_small(percentiles(rows, value, group, {"_lo": low, "_hi": high}))
    span = F.col("_hi") - F.col("_lo")
    scaled = F.when(span > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(value) - F.col("_lo")) / span))).otherwise(0.0)
    return rows.join(ends, group).withColumn(name, scaled).select(*rows.columns, name)
