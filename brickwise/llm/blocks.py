"""Exact scores of a set of queries against all rows: vectors of whole numbers, dealt into blocks that Spark groups and shuffles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickwise.runtime import materialize

#: Bytes of doubles that the rows of a shard, or the queries of a block, take at most; shards at least, as far as each gets LEAST_ROWS.
BLOCK_BYTES, LEAST_SHARDS, LEAST_ROWS = 8 << 20, 16, 256


def usable(vector: Column) -> Column:
    """Whether a vector takes part: it isn't null and holds no null or non-finite component."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, finite), F.lit(False))


def numbered(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` with a number of their own each (``row``), written, so that rows that share an id and a vector stay apart."""
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()), label)


def counts(rows: DataFrame, of: Column) -> tuple[int, int, int]:
    """Rows, rows where ``of`` holds, and the length of the longest vector."""
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(of, 1)).alias("m"), F.max(F.size("vector")).alias("d")).first()
    return found["n"], found["m"], found["d"] or 0


def block_rows(dimension: int) -> int:
    return max(1, BLOCK_BYTES // (8 * max(1, dimension)))


def shards_of(n: int, dimension: int) -> int:
    """How many shards hold ``n`` rows."""
    return max(1, -(-n // block_rows(dimension)), min(LEAST_SHARDS, n // LEAST_ROWS))


def in_blocks(rows: DataFrame, shards: int, asked: DataFrame, blocks: int) -> DataFrame:
    """Rows (side 0) and queries (side 1, with their ``block``) for a group (shard, block) in which each meets each other once.

    A shard has about the same number of rows whatever they hold, so that copies of one vector are spread over all of them.
    """
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    right = rows.select("*", F.lit(0).alias("side"), F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), upto(blocks).alias("block"))
    left = asked.select("*", F.lit(1).alias("side"), upto(shards).alias("shard"))
    return right.unionByName(left, allowMissingColumns=True)


def whole_numbers(column: pa.ChunkedArray, dimension: int, scale: int) -> np.ndarray:
    """floor(scale * x) of each component, as doubles; shorter vectors end in zeros."""
    lists = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    values = np.floor(scale * np.asarray(lists.flatten()).astype(np.float64))
    lengths = np.asarray(lists.value_lengths())
    out = np.zeros((len(lists), dimension))
    out[np.arange(dimension)[None, :] < lengths[:, None]] = values
    return out


def exact_products(a: np.ndarray, b: np.ndarray, most: int = 2**63) -> np.ndarray:
    """Inner products of rows of whole numbers as int64.

    Raises OverflowError where a product might reach ``most``: a score isn't wrapped or rounded.
    """
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    bound = a.shape[1] * int(np.abs(a).max()) * int(np.abs(b).max())
    if bound < 2**53:
        return np.rint(a @ b.T).astype(np.int64)
    if bound >= most:
        raise OverflowError(f"inner products of up to {bound} don't fit")
    return a.astype(np.int64) @ b.astype(np.int64).T


def first_of_each(key: np.ndarray, score: np.ndarray, ids: np.ndarray, unnamed: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each key: higher scores first, ties by smaller id, those without an id last; in that order."""
    order = np.lexsort((ids, unnamed, -score, key))
    ranked = key[order]
    start = np.nonzero(np.r_[True, ranked[1:] != ranked[:-1]])[0] if len(ranked) else np.zeros(0, dtype=int)
    rank = np.arange(len(ranked)) - np.repeat(start, np.diff(np.r_[start, len(ranked)]))
    return order[rank < k]


def id_columns(table: pa.Table, name: str = "id") -> tuple[np.ndarray, np.ndarray]:
    """Ids with zeros for nulls, and where they are null."""
    column = table.column(name)
    return column.fill_null(0).to_numpy(), column.is_null().to_numpy()


def id_array(ids: np.ndarray, unnamed: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=unnamed)
