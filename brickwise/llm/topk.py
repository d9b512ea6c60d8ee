"""Exact top-k search by no-random-access aggregation.

The rows are dealt into shards. In a shard each dimension is a list sorted by value. A query reads all its lists from the end that its own component
favours, so many entries of each at a time, adds up what it has read of every row, and keeps bounds on every row's score: what unread entries can add
is bounded by the values that the lists have come to and by the lists' far ends. Rows that can't be among the first k any more are dropped, unseen rows
like others. Reading stops when few enough are left; their scores are resolved. The k-th best lower bound is carried from one set of lists to the next of a
shard. Shards give k rows a query each, which are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brickwise.llm import blocks

#: Rows whose entries are sorted into one set of lists, and steps in which lists are read to their end.
LIST_ROWS, STEPS = 4096, 8
SCALE, K, EVERY = 1024, 10, 100


def undecided(query: np.ndarray, values: np.ndarray, rows: np.ndarray, own: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, float]:
    """Rows that may be among the first ``k`` after as much reading as it takes, and the k-th best lower bound (``floor`` or higher).

    A column of ``values`` is a dimension's list, ascending. Entries beyond the value that their list has come to have been read. Any other counts
    as that value in its row's upper bound, and as the list's far end in its lower bound: nothing of a row is used that hasn't been read. Reading goes on until
    to resolve what is left takes no more entries than another step. ``own`` are the rows to leave out.
    """
    n, weights = len(rows), np.abs(query)
    turned = rows * np.sign(query)  # all lists are read from their high ends now
    end = lambda i: np.where(query > 0, values[i], -values[n - 1 - i])
    far = end(0)
    slack = 1 + (1e-9 if rows.dtype == np.float64 else 1e-5) * weights @ np.maximum(np.abs(far), np.abs(end(n - 1)))  # of rounding
    alive = np.nonzero(~own)[0]
    turned = turned[alive]
    step = max(k, -(-n // STEPS))
    depth = 0
    while len(alive) > step and depth < n:
        depth = min(n, depth + step)
        come_to = end(n - depth)
        upper = np.maximum(turned, come_to) @ weights
        best = turned[np.argpartition(upper, -k)[-k:]]
        floor = max(floor, (np.where(best > come_to, best, far) @ weights).min() - slack)
        left = upper + slack >= floor
        if not left.all():
            alive, turned = alive[left], turned[left]
    return alive, floor


def _search(block: pa.Table, dimension: int, scale: int, k: int) -> pa.Table:
    """The first ``k`` rows of a shard for each query of a block."""
    side = block.column("side").to_numpy()
    right, left = block.filter(pa.array(side == 0)), block.filter(pa.array(side == 1))
    queries, rows = (blocks.whole_numbers(x.column("vector"), dimension, scale) for x in (left, right))
    query_row, row = left.column("row").to_numpy(), right.column("row").to_numpy()
    ids, unnamed = blocks.id_columns(right)
    floors = np.full(len(queries), -np.inf)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(0, len(rows) if len(queries) else 0, LIST_ROWS):
        part = rows[i : i + LIST_ROWS]
        small = np.float32 if np.abs(part).max(initial=0) < 2**24 else np.float64
        listed = part.astype(small)
        values = np.sort(listed, axis=0)
        for q, query in enumerate(queries):
            left_over, floors[q] = undecided(query.astype(small), values, listed, row[i : i + LIST_ROWS] == query_row[q], k, floors[q])
            if len(left_over):
                found.append((np.full(len(left_over), q), left_over + i, blocks.exact_products(query[None], part[left_over])[0]))
    q, at, score = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64) for _ in range(3))
    kept = blocks.first_of_each(q, score, ids[at], unnamed[at], k)
    q, at = q[kept], at[kept]
    named = left.column("id").take(pa.array(q, pa.int64()))
    return pa.table({"query_row": query_row[q], "query_id": named, "id": blocks.id_array(ids[at], unnamed[at]), "score": score[kept]})


def top_k(rows: DataFrame, asks: Column, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, k: int = K) -> DataFrame:
    """(query_id, rank, id_col, score): for each row where ``asks`` holds, the ``k`` other rows of the highest integer inner products; all, if fewer.

    Components become floor(scale * x). Ties go to the smaller id, then to rows without one. Null vectors and vectors with null or non-finite components
    take no part; shorter vectors end in zeros, an empty one scores 0. A row is left out of its own query only: rows that share its id, or its id and
    vector, are candidates. Scores beyond 64 bits raise OverflowError. Other columns are ignored; an empty table gives no rows. The work is that of all
    queries on all rows, in blocks; each block's memory is bounded, and its rows are its own whichever executor makes them again.
    """
    named = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.coalesce(asks, F.lit(False)).alias("asks"))
    taken = blocks.numbered(named.where(blocks.usable(F.col("vector"))), "topk-rows")
    n, m, dimension = blocks.counts(taken, F.col("asks"))
    split = max(1, -(-m // blocks.block_rows(dimension)))
    asked = taken.where("asks").select("row", "id", "vector", F.pmod(F.xxhash64("row"), F.lit(split)).cast("int").alias("block"))
    dealt = blocks.in_blocks(taken.select("row", "id", "vector"), blocks.shards_of(n, dimension), asked, split)
    found = dealt.groupBy("shard", "block").applyInArrow(lambda block: _search(block, dimension, scale, k),
        "query_row long, query_id long, id long, score long")
    first = Window.partitionBy("query_row").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")


def nearest_rows(embeddings: DataFrame) -> DataFrame:
    """The ten highest scores of every row whose id is divisible by 100."""
    return top_k(embeddings, F.col("vec_id") % EVERY == 0)
