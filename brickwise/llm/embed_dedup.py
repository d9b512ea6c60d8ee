"""Embedding near-duplicates: spherical k-means cells, blocked cosine products within cells, one representative per group.

Every vector is a resident of the nearest centroid's cell. For each pair of cells either both sides send each other, as guests, the vectors
that lie within half the distance of linked vectors of their border, or one side sends those within the whole distance: of two linked vectors
in different cells one is always a guest of the other's cell. Which side sends is read off the sample, and only changes the amount of work.
Within a cell, residents are compared with residents and guests in blocks of bounded size, so that a cell of any size is
spread over many tasks. Blocks give counts of links and stars of what they connect, never all pairs. Equal vectors are one vector with a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickwise.operators.components import connected_components
from brickwise.runtime import materialize

THRESHOLD = 0.9
#: Vectors of a cell on average, and cells at most (beyond it cells grow); the centroids are fitted on SAMPLE_PER_CELL vectors
#: for each cell, SAMPLE_BYTES of doubles at most.
CELL_ROWS, MOST_CELLS, SAMPLE_PER_CELL, SAMPLE_BYTES, ROUNDS = 8192, 4096, 16, 128 << 20, 8
#: Vectors of the sample at least, for the estimate of which cells should send.
LEAST_SAMPLE = 2048
#: Residents and members of a block at most, and the sides of the products within it.
BLOCK_RESIDENTS, BLOCK_MEMBERS, TILE = 8192, 32768, (512, 4096)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """``k`` unit centroids of unit rows, from evenly spaced rows as seeds; empty cells keep their centroid."""
    centroids = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        home = np.concatenate([(x[i : i + 4096] @ centroids.T).argmax(1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, x)
        norms = np.linalg.norm(sums, axis=1)
        centroids[norms > 1e-9] = sums[norms > 1e-9] / norms[norms > 1e-9, None]
    return centroids


def _units(rows: np.ndarray) -> np.ndarray:
    """Unit rows in double precision of finite rows that aren't zero."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # no overflow or underflow of squares
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _listed(arrays: pa.Array, size: int) -> np.ndarray:
    """The rows of an Arrow array of lists of ``size`` numbers, in the numbers' own precision."""
    return np.asarray(arrays.flatten()).reshape(-1, size)


def _packed(column: pa.ChunkedArray, size: int) -> np.ndarray:
    """Unit rows of packed vectors; the width of a vector tells its precision."""
    cells = column.to_pylist()
    kind = np.float32 if len(cells[0]) == 4 * size else np.float64
    return _units(np.frombuffer(b"".join(cells), dtype=kind).reshape(-1, size))


def linked_distance(threshold: float) -> float:
    """The distance of unit vectors at the threshold, with an allowance for rounding: linked vectors are no further apart."""
    return float(np.sqrt(2 - 2 * threshold)) + 1e-9


def _border_distances(near: np.ndarray, home: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """How far each row is from the border between its own cell and every other, given its products with the centroids."""
    gaps = np.sqrt(np.maximum(2 - 2 * centroids[home] @ centroids.T, 1e-12))
    return (near[np.arange(len(near)), home][:, None] - near) / gaps


def sending_margins(sample: np.ndarray, centroids: np.ndarray, threshold: float) -> np.ndarray:
    """Entry (a, b): residents of a that lie this near the border with b are guests of b; below zero: none are.

    Two linked vectors on either side of a border are ``linked_distance`` apart at most and their distances to the border add up to no more. So all links
    across it are found if both cells send what lies within half of that, or if one of them sends what lies within the whole. The least number of
    products, by the counts in the sample, decides.
    """
    whole = linked_distance(threshold)
    k = len(centroids)
    rows, halves, wholes = np.zeros(k), np.zeros((k, k)), np.zeros((k, k))
    for i in range(0, len(sample), 1024):
        near = sample[i : i + 1024] @ centroids.T
        home = near.argmax(1)
        off = _border_distances(near, home, centroids)
        np.add.at(rows, home, 1)
        np.add.at(halves, home, off <= whole / 2)
        np.add.at(wholes, home, off <= whole)
    both = rows[:, None] * halves.T + rows[None, :] * halves
    sent = wholes * rows[None, :]  # the row's cell sends to the column's
    order = np.arange(k)
    first = order[:, None] < order[None, :]
    out = np.full((k, k), whole / 2)
    one = np.minimum(sent, sent.T) < both
    sends = (sent < sent.T) | ((sent == sent.T) & first)
    out[one] = np.where(sends, whole, -1.0)[one]
    return out


def assign_cells(vectors: DataFrame, centroids: np.ndarray, margins: np.ndarray) -> DataFrame:
    """(id, weight, packed, cells): ``cells`` begins with the vector's own cell, then those it is a guest of."""
    size = centroids.shape[1]
    step = max(1, (8 << 20) // len(centroids))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = _listed(batch.column("vector"), size)
            cells: list[list[int]] = []
            for i in range(0, len(raw), step):
                near = _units(raw[i : i + step]) @ centroids.T
                home = near.argmax(1)
                guest = _border_distances(near, home, centroids) <= margins[home]
                guest[np.arange(len(near)), home] = False
                cells += [[h, *np.nonzero(g)[0].tolist()] for h, g in zip(home.tolist(), guest, strict=True)]
            packed = pa.array([r.tobytes() for r in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("weight"), packed, pa.array(cells, pa.list_(pa.int32()))], ["id", "weight",
                "packed", "cells"])

    return vectors.select("id", "weight", "vector").mapInArrow(of, "id long, weight long, packed binary, cells array<int>")


def joined_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``labels`` (each node's is a node, itself at first) after nodes ``a`` were connected with ``b``: the smallest node of what is connected."""
    while len(a):
        la, lb = labels[a], labels[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        if not len(a):
            break
        parent = np.arange(len(labels))
        np.minimum.at(parent, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        labels = parent[labels]
    return labels


def _compare(block: pa.Table, threshold: float, size: int) -> pa.Table:
    """Counts of links, and a star for all that they connect, of one block; side 0 are residents, side 1 what they are compared with.

    In a cell each pair of residents counts once. A pair of a resident and a guest that also meets in the guest's own cell
    counts in the cell with the lower number only. Products are made in single precision; those too near the threshold to tell are made again in double.
    """
    side = block.column("side").to_numpy()
    empty = np.zeros(0, dtype=np.int64)
    left, right = block.filter(pa.array(side == 0)), block.filter(pa.array(side == 1))
    if not left.num_rows or not right.num_rows:
        return pa.table({"id": empty, "links": empty, "other": empty})
    here = block.column("cell")[0].as_py()
    a, b = _packed(left.column("packed"), size), _packed(right.column("packed"), size)
    small_a, small_b = a.astype(np.float32), b.astype(np.float32)
    left_id, right_id = left.column("id").to_numpy(), right.column("id").to_numpy()
    left_weight, right_weight = left.column("weight").to_numpy(), right.column("weight").to_numpy()
    lists = right.column("cells").combine_chunks()
    home = np.asarray(lists.flatten())[np.asarray(lists.offsets)[:-1] - lists.offsets[0].as_py()]
    # whether a resident is a guest of each home that is lower than this cell
    lower = np.unique(home[home < here])
    known = np.zeros((len(a), len(lower) + 1), dtype=bool)
    place = np.where(home < here, np.searchsorted(lower, home), len(lower))
    if len(lower):
        of = left.column("cells").combine_chunks()
        row = np.repeat(np.arange(len(a)), np.diff(np.asarray(of.offsets)))
        cell = np.asarray(of.flatten())
        at = np.minimum(np.searchsorted(lower, cell), len(lower) - 1)
        hit = lower[at] == cell
        known[row[hit], at[hit]] = True
    nodes = np.unique(np.concatenate([left_id, right_id]))
    left_node, right_node = np.searchsorted(nodes, left_id), np.searchsorted(nodes, right_id)
    labels, counts = np.arange(len(nodes)), np.zeros(len(nodes), dtype=np.int64)
    doubt = (size + 8) * 1.2e-7
    for i in range(0, len(a), TILE[0]):
        for j in range(0, len(b), TILE[1]):
            cosine = small_a[i : i + TILE[0]] @ small_b[j : j + TILE[1]].T
            p, q = np.nonzero(cosine >= threshold - doubt)
            near = cosine[p, q] < threshold + doubt
            p, q = p + i, q + j
            own = home[q] == here
            kept = np.where(own, left_id[p] < right_id[q], ~known[p, place[q]])
            unsure = np.nonzero(near & kept)[0]
            for u in np.array_split(unsure, len(unsure) // 65536 + 1):
                kept[u] = np.einsum("ij,ij->i", a[p[u]], b[q[u]]) >= threshold
            p, q = p[kept], q[kept]
            np.add.at(counts, left_node[p], right_weight[q])
            np.add.at(counts, right_node[q], left_weight[p])
            labels = joined_labels(labels, left_node[p], right_node[q])
    linked, star = np.nonzero(counts)[0], np.nonzero(labels != np.arange(len(nodes)))[0]
    return pa.table({
        "id": np.concatenate([nodes[linked], nodes[star]]),
        "links": np.concatenate([counts[linked], np.zeros(len(star), dtype=np.int64)]),
        "other": np.concatenate([np.full(len(linked), -1), nodes[labels[star]]]),
    })


def links(vectors: DataFrame, dimension: int, total: int, threshold: float = THRESHOLD) -> DataFrame:
    """(id, links, other): rows with a count of links (other is -1; several for one id add up) and rows that are edges."""
    k = int(np.clip(-(-total // CELL_ROWS), 1, MOST_CELLS))
    most = max(k, SAMPLE_BYTES // (8 * dimension))
    drawn = vectors.orderBy(F.xxhash64("id"), "id").limit(min(most, max(LEAST_SAMPLE, SAMPLE_PER_CELL * k))).select("vector").toArrow()
    sample = _units(_listed(drawn.column("vector").combine_chunks(), dimension))
    centroids = spherical_kmeans(sample, min(k, len(sample)))
    placed = materialize(assign_cells(vectors, centroids, sending_margins(sample, centroids, threshold)), "cells")
    every = placed.select("*", F.posexplode("cells").alias("nth", "cell"))
    counts = placed.select(F.posexplode("cells").alias("nth", "cell")).groupBy("cell")
    counts = counts.agg(F.count(F.when(F.col("nth") == 0, 1)).alias("residents"), F.count(F.lit(1)).alias("members"))
    chunks = lambda n, size: F.greatest(F.lit(1), F.ceil(F.col(n) / size)).cast("int")
    split = F.broadcast(counts.select("cell", chunks("residents", BLOCK_RESIDENTS).alias("rows_n"), chunks("members",
        BLOCK_MEMBERS).alias("columns_n")))  # a row per cell
    dealt = every.join(split, "cell")
    number = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["id", "weight", "packed", "cells", "cell"]
    resident = dealt.where("nth = 0").select(*columns, F.lit(0).alias("side"), number("rows_n").alias("i"), upto("columns_n").alias("j"))
    member = dealt.select(*columns, F.lit(1).alias("side"), upto("rows_n").alias("i"), number("columns_n").alias("j"))
    blocks = resident.unionByName(member)
    return blocks.groupBy("cell", "i", "j").applyInArrow(lambda block: _compare(block, threshold, dimension), "id long, links long, other long")


def near_duplicates(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, n_links, component_id (the smallest id that links can reach) and kept (whether that is the row's own id).

    Null and zero vectors, vectors with null or non-finite components and vectors of another length than most have no links and
    are their own component. Rows are told apart by their vectors, not by their ids: rows that share an id and a vector count as linked copies, rows that
    share an id only are as any others. Rows with a null id keep their row, link like others, and their component is named by an id if it has one.
    Other columns are ignored; an empty table gives no rows.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.col("vector").isNotNull() & F.forall("vector", finite) & F.exists("vector", lambda x: x != 0)
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec"), F.col(vector_col).alias("vector")).withColumn("usable", F.coalesce(usable, F.lit(False)))
    common = rows.where("usable").groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dimension = common["n"] if common else 0
    rows = rows.withColumn("usable", F.col("usable") & (F.size("vector") == dimension))
    apart = rows.where("not usable").select("vec", F.lit(0).cast("long").alias("n_links"), F.col("vec").alias("component"))
    if not common:
        return _named(apart, id_col)
    distinct = rows.where("usable").groupBy("vector").agg(F.min("vec").alias("low"), F.count(F.lit(1)).alias("weight"))
    nodes = materialize(distinct.withColumn("id", F.monotonically_increasing_id()), "distinct-vectors")
    total = nodes.count()
    found = materialize(links(nodes, dimension, total, threshold), "links")
    roots = connected_components(found.where("other <> -1"), "id", "other")
    counted = found.where("other = -1").groupBy("id").agg(F.sum("links").alias("links"))
    linked = counted.join(roots.withColumnRenamed("node", "id"), "id")
    named = nodes.join(linked, "id", "left")
    named = named.select("vector", "low", F.coalesce("root", "id").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component"))
    groups = named.join(lowest, "root").select("vector", "n_links", "component")
    joined = rows.where("usable").join(groups, "vector").select("vec", "n_links", "component")
    return _named(joined.unionByName(apart), id_col)


def _named(rows: DataFrame, id_col: str) -> DataFrame:
    kept = F.coalesce(F.col("vec") == F.col("component"), F.lit(False))
    return rows.select(F.col("vec").alias(id_col), "n_links", F.col("component").alias("component_id"), kept.alias("kept"))
