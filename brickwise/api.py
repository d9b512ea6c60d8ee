"""Fluent wrapper of voxel rows: ``VoxelFrame(rows).box(...).where(...).pool(4)``; each step is a lazy DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickwise.operators import aggregates, grid, joins, stencil


class VoxelFrame:
    """Rows with z, y, x and channel columns."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def box(self, low: tuple[int, int, int], size: tuple[int, int, int]) -> VoxelFrame:
        return VoxelFrame(self.rows.where(grid.inside(low, size)))

    def channels(self, *names: str) -> VoxelFrame:
        return VoxelFrame(self.rows.select(*grid.AXES, *names))

    def where(self, condition: Column | str) -> VoxelFrame:
        return VoxelFrame(self.rows.where(condition))

    def valid(self, channel: str = "valid", state: int = 1) -> VoxelFrame:
        return self.where(F.col(channel) == state)

    def shifted(self, by: tuple[int, int, int]) -> VoxelFrame:
        return VoxelFrame(self.rows.withColumns({a: F.col(a) + d for a, d in zip(grid.AXES, by, strict=True)}))

    def pool(self, factor: int, value: str, mask: Column | None = None) -> VoxelFrame:
        return VoxelFrame(aggregates.pool(self.rows, factor, value, F.lit(True) if mask is None else mask))

    def zero_crossing(self, inside: Column, outside: Column) -> VoxelFrame:
        return VoxelFrame(stencil.zero_crossing(self.rows, inside, outside))

    def distance(self, targets: Column, limit: int, name: str = "d2") -> VoxelFrame:
        return VoxelFrame(stencil.distance_within(self.rows, self.rows.where(targets), limit, name))

    def over(self, other: VoxelFrame, values: list[str]) -> VoxelFrame:
        """Priority merge: this frame where it's valid, else the other."""
        return VoxelFrame(joins.priority_merge(self.rows, other.rows, values, list(grid.AXES)))

    def on_coarse(self, coarse: VoxelFrame, factor: int) -> VoxelFrame:
        return VoxelFrame(joins.coarse_join(self.rows, coarse.rows, factor))
