"""Vectors in array columns: norms, cosines, means, main components, and scoring by a model in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column | str, eps: float = 1e-12) -> Column:
    """Unit vector; a vector no longer than ``eps`` becomes zero."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > eps, x.cast("double") / n).otherwise(0.0))


def cosine(a: str, b: str) -> Column:
    return dot(a, b) / norm(a) / norm(b)


def mean_vector(rows: DataFrame, vector: str) -> DataFrame:
    """One row with the mean of the vectors, summed per place."""
    places = rows.select(F.posexplode(vector).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("v"))
    return places.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda p: p["v"]).alias(vector))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64)


def fit_pca(rows: DataFrame, vector: str, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, components, explained share): each task is reduced to its sums of products, which are added up by place; the driver gets one packed matrix."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = _matrix(batch.column(0))
            if len(x):
                x1 = np.hstack([np.ones((len(x), 1)), x])
                total = x1.T @ x1 if total is None else total + x1.T @ x1
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["m"])

    parts = rows.select(vector).where(F.col(vector).isNotNull()).mapInArrow(moments, "m array<double>")
    sums = parts.select(F.posexplode("m").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    m = np.zeros(sums.num_rows)
    m[sums.column("i").to_numpy()] = sums.column("v").to_numpy()
    size = int(np.sqrt(len(m)))
    m = m.reshape(size, size)
    n, mean = m[0, 0], m[0, 1:] / m[0, 0]
    values, axes = np.linalg.eigh(m[1:, 1:] / n - np.outer(mean, mean))
    order = np.argsort(values)[::-1][:components]
    return mean, axes[:, order].T, values[order] / values.sum()


def apply_pca(model: tuple[np.ndarray, np.ndarray, np.ndarray], vector: str) -> Column:
    """Array of a vector's coordinates on the components."""
    mean, axes, _ = model

    @F.arrow_udf("array<double>")
    def of(column: pa.Array) -> pa.Array:
        return pa.array(list((_matrix(column) - mean) @ axes.T), pa.list_(pa.float64()))

    return of(vector)


def score(rows: DataFrame, id_col: str, vector: str, model: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(id, score) of a model that maps a matrix of normalised rows to a number per row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            x = (x - x.mean(axis=1, keepdims=True)) / np.maximum(x.std(axis=1, keepdims=True), 1e-8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.asarray(model(x), dtype=np.float64))], [id_col, "score"])

    return rows.select(F.col(id_col).cast("long"), vector).mapInArrow(of, f"{id_col} long, score double")


def radial_power(rows: DataFrame, group: str, vector: str, edge: int) -> DataFrame:
    """(group, radius, power, n): mean power of the frequencies of blocks of edge^3 values less their mean, by their rounded distance from zero.

    Each batch of blocks is transformed at once and gives a sum per group and radius.
    """
    k = np.minimum(np.arange(edge), edge - np.arange(edge))
    radius = np.rint(np.sqrt(sum(a.astype(float) ** 2 for a in np.meshgrid(k, k, k, indexing="ij")))).astype(int).ravel()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            power = np.abs(np.fft.fftn((x - x.mean(axis=1, keepdims=True)).reshape(-1, edge, edge, edge), axes=(1, 2, 3))).reshape(len(x), -1) ** 2
            by_radius = np.stack([power[:, radius == r].sum(axis=1) for r in range(radius.max() + 1)], axis=1)
            names, place = np.unique(batch.column(0).to_numpy(), return_inverse=True)
            total = np.zeros((len(names), by_radius.shape[1]))
            np.add.at(total, place, by_radius)
            many = np.bincount(place)[:, None] * np.bincount(radius)[None, :]
            at = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(names[at[0].ravel()]), pa.array(at[1].ravel().astype(np.int32)), pa.array(total.ravel()),
                pa.array(many.ravel())], [group, "radius", "s", "n"])

    known = rows.where(F.col(vector).isNotNull()).select(F.col(group).cast("long"), vector)
    parts = known.mapInArrow(sums, f"{group} long, radius int, s double, n long")
    return parts.groupBy(group, "radius").agg(F.round(F.sum("s") / F.sum("n"), 4).alias("power"), F.sum("n").alias("n"))
