"""Deterministic samples, top picks and splits. Hashes are md5 of the row's key, so that samples don't depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brickwise.operators.prefix import running_sums


def hash_unit(*keys: Column | str, salt: str = "") -> Column:
    """A number in [0, 1) from the first 13 hex digits of the keys' md5."""
    text = F.concat_ws("|", *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys], F.lit(salt))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / float(1 << 52)


def bottom_k(rows: DataFrame, k: int, keys: list[str], group: list[str] | None = None, salt: str = "") -> DataFrame:
    """The ``k`` rows with the smallest hashes of their keys (per group): a uniform sample that merges over parts."""
    marked = rows.withColumn("_u", hash_unit(*keys, salt=salt))
    if not group:
        return marked.orderBy("_u", *keys).limit(k).drop("_u")
    return marked.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy("_u", *keys))).where(F.col("_r") <= k).drop("_u", "_r")


def weighted_choice(rows: DataFrame, keys: list[str], weights: dict[str, float], salt: str = "", name: str = "choice") -> DataFrame:
    """``rows`` with a store picked by the hash of their keys in proportion to the weights."""
    total, upto, pick = sum(weights.values()), 0.0, None
    u = hash_unit(*keys, salt=salt)
    for store, weight in weights.items():
        upto += weight / total
        pick = F.when(u < upto, store) if pick is None else pick.when(u < upto, store)
    return rows.withColumn(name, pick.otherwise(list(weights)[-1]))


def best_per_bin(rows: DataFrame, bins: int, order: str, score: str, ties: str) -> DataFrame:
    """The row with the highest score in each of ``bins`` equal runs of the order (the first ones a row longer if they can't be equal); ties by the lowest ``ties``."""
    numbered = running_sums(rows.withColumn("_bw_one", F.lit(1).cast("long")), [order, ties], {"_bw_one": "_bw_place"}, "bin-places")
    total = rows.count()
    short, longer = total // bins, total % bins
    place, first = F.col("_bw_place"), longer * (short + 1)
    number = F.when(place < first, F.floor(place / (short + 1))).otherwise(longer + F.floor((place - first) / max(1, short)))
    best = numbered.groupBy(number.alias("_bw_bin")).agg(F.max_by(F.struct(*rows.columns), F.struct(F.col(score), -F.col(ties))).alias("_bw_best"))
    return best.select("_bw_best.*")


def spread_top(rows: DataFrame, n: int, size: int, score: str, axes: tuple[str, ...], pool: int | None = None) -> list[dict]:
    """Greedily the ``n`` best rows of which no two cubes of ``size`` overlap; sequential by nature.

    Candidates come to the driver best first, ``pool`` rows at a time, until ``n`` are taken or none is left, so what is held is a page.
    """
    order = [F.desc(score), *axes]
    taken: list[dict] = []
    page, after = pool or 64 * n, None
    while len(taken) < n:
        rest = rows if after is None else rows.where(F.struct(-F.col(score), *axes) > F.struct(*[F.lit(v) for v in after]))
        found = [r.asDict() for r in rest.orderBy(*order).limit(page).collect()]
        for r in found:
            if len(taken) < n and all(any(abs(r[a] - t[a]) >= size for a in axes) for t in taken):
                taken.append(r)
        if len(found) < page:
            break
        after = [-found[-1][score], *[found[-1][a] for a in axes]]
    return taken


def band_split(rows: DataFrame, axis: str, size: int, low: int, high: int) -> DataFrame:
    """``rows`` with ``part``: holdout from low to high (half-open) along an axis, train where the cube is clear of all held-out cubes, else gap."""
    held = (F.col(axis) >= low) & (F.col(axis) < high)
    reach = rows.where(held).agg(F.coalesce(F.min(axis), F.lit(low)).alias("_lo"), F.coalesce(F.max(axis) + size, F.lit(high)).alias("_hi"))
    clear = (F.col(axis) + size <= F.col("_lo")) | (F.col(axis) >= F.col("_hi"))
    return rows.crossJoin(F.broadcast(reach)).withColumn("part", F.when(held, "holdout").when(clear, "train").otherwise("gap")).drop("_lo",
        "_hi")  # reach: one row


def fraction_band(rows: DataFrame, axis: str, size: int, share: float) -> tuple[int, int]:
    """Ends of the top share of the range of origins along an axis."""
    row = rows.agg(F.min(axis).alias("lo"), F.max(axis).alias("hi")).first()
    high = row["hi"] + size
    return round(high - share * (high - row["lo"])), high
