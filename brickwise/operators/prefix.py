"""Running sums over a total order, without bringing the rows of a group together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brickwise.runtime import range_table


def running_sums(df: DataFrame, order_by: list[str], values: dict[str, str], label: str, group_by: list[str] | None = None) -> DataFrame:
    """``df`` with, for each ``values`` item (column, new name), the sum over all earlier rows of the same group.

    The rows are dealt into ordered ranges of ``group_by`` and ``order_by``; each range is summed on its own and
    shifted by the totals of the ranges before it, so that a group of any size is spread over many tasks. Group columns must
    hold no nulls. Rows that tie in the whole order are summed in an arbitrary order.
    """
    group = list(group_by or [])
    ranged = range_table(df, group + order_by, label)
    totals = ranged.groupBy("_bw_part", *group).agg(*[F.sum(c).alias(f"_bw_{n}") for c, n in values.items()])
    ahead = Window.partitionBy(*group).orderBy("_bw_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select("_bw_part", *group, *[F.coalesce(F.sum(f"_bw_{n}").over(ahead), F.lit(0)).alias(f"_bw_{n}") for n in values.values()])
    within = Window.partitionBy("_bw_part", *group).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(n) for c, n in values.items()])
    joined = local.join(shifts, ["_bw_part", *group])
    return joined.select(*df.columns, *[(F.col(n) + F.col(f"_bw_{n}")).alias(n) for n in values.values()])
