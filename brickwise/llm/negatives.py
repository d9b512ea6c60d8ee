"""Hard negatives from lists that anchors of a cluster share.

Anchors are clustered by direction. For a cluster and a shard of the rows, one list holds the shard's rows by an upper bound on their scores, highest
first: a row at angle t from the centroid is at least t - b from every member, b being the widest angle of a member, so that its score is at most the
product of the lengths and cos(max(0, t - b)). All members walk that list together, so many rows at a time; a member leaves once the bound of what
is ahead certifies that nothing there can change what it has. One walk finds the positives, a second one, with the scores of the
positives known, the negatives. Shards give a few rows for each anchor, which are merged. The first walk is over rows of the anchors' own labels only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brickwise.llm import blocks
from brickwise.llm.embed_dedup import spherical_kmeans
from brickwise.runtime import materialize

SCALE, EVERY, SHIFTED, LABELS, POSITIVES, NEGATIVES = 256, 100, 7, 10, 5, 10
#: The least and the highest negative score, in hundredths of the positive's.
LEAST, MOST = 30, 90
#: Anchors of a cluster on average, clusters and the bytes of their centroids at most, anchors that they are fitted on for each cluster.
CLUSTER_ANCHORS, MOST_CLUSTERS, CENTROID_BYTES, SAMPLE_PER_CLUSTER = 64, 1024, 8 << 20, 16
#: Rows of a list that members look at before they test whether they are done; a quarter at first, as all of them count until there are enough, four times
#: as many from the third time on.
STRIDE = 1024
#: Shards from which on they have more rows, and how many times as many at most; families of labels that the first walk deals its rows by.
MANY_SHARDS, WIDER, FAMILIES = 64, 4, 64
#: Members that walk a list together at most.
WALKERS = 1024
#: Scores below this fit their hundredfold into 64 bits.
MOST_SCORE = 2**63 // 100


def directions(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and lengths; a zero vector stays zero."""
    lengths = np.linalg.norm(vectors, axis=1)
    return vectors / np.where(lengths > 0, lengths, 1)[:, None], lengths


class Shard:
    """The rows of a shard as whole numbers, and their scores with ``anchors``."""

    def __init__(self, rows: np.ndarray, anchors: np.ndarray):
        self.units, self.lengths = directions(rows)
        # no sum of some of a product's terms exceeds the product of the lengths: whole numbers of that size are exact, in whatever order they are added
        reach = self.lengths.max(initial=0) * np.linalg.norm(anchors, axis=1).max(initial=0) * (1 + 1e-9)
        self.kind, self.most = (np.float32, 2**24) if reach < 2**24 else (np.float64, 2**53)
        self.floating = reach < self.most
        self.rows = rows.astype(self.kind) if self.floating else rows

    def list_of(self, members: np.ndarray, centroid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows by descending bound, and the bounds: no member's score with a row exceeds the member's length times the row's bound."""
        angle = lambda units: np.arccos(np.clip(units @ centroid, -1, 1))
        widest = angle(directions(members)[0]).max()
        bound = self.lengths * (np.cos(np.maximum(angle(self.units) - widest - 1e-6, 0)) + 1e-9)  # with an allowance for rounding
        order = np.argsort(-bound)
        return order, bound[order]

    def reaching(self, members: np.ndarray, at: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the member, row, score) of each score that is ``least`` of its member or more."""
        if not self.floating:
            scores = blocks.exact_products(members, self.rows[at], MOST_SCORE)
            m, r = np.nonzero(scores >= least[:, None])
            return m, at[r], scores[m, r]
        scores = members.astype(self.kind) @ self.rows[at].T
        found = np.flatnonzero(scores >= np.clip(least, -self.most, self.most).astype(self.kind)[:, None])
        m, r = np.divmod(found, len(at))
        return m, at[r], np.rint(scores.ravel()[found]).astype(np.int64)


def shared_list(rows: np.ndarray, members: np.ndarray, centroid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:meth:`Shard.list_of` of rows that no shard holds."""
    return Shard(rows, members).list_of(members, centroid)


def walk(rows: np.ndarray | Shard, members: np.ndarray, centroid: np.ndarray, look: Callable[[np.ndarray, np.ndarray, np.ndarray], None],
    least: Callable[[], np.ndarray]) -> None:
    """Hand ``look(members, rows, scores)`` what reaches ``least()``, below which scores don't matter to a member, of the list in strides until that is above
    all that is ahead."""
    shard = rows if isinstance(rows, Shard) else Shard(rows, members)
    order, bound = shard.list_of(members, centroid)
    lengths = np.linalg.norm(members, axis=1)
    walking, i = np.arange(len(members)), 0
    strides = iter((max(1, STRIDE // 4), STRIDE, 4 * STRIDE))
    stride = next(strides)
    while i < len(order):
        floor = least()
        walking = walking[lengths[walking] * bound[i] + 1 >= floor[walking]]
        if not len(walking):
            break
        m, at, scores = shard.reaching(members[walking], order[i : i + stride], floor[walking])
        if len(m):
            look(walking[m], at, scores)
        i += stride
        stride = next(strides, stride)


class _Best:
    """The first ``k`` rows of each key so far."""

    def __init__(self, keys: int, k: int, ids: np.ndarray, unnamed: np.ndarray):
        self.k, self.ids, self.unnamed = k, ids, unnamed
        self.key, self.at, self.score = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.last = np.full(keys, -np.inf)  # the k-th score, once there are as many

    def add(self, key: np.ndarray, at: np.ndarray, score: np.ndarray) -> None:
        key, at, score = np.r_[self.key, key], np.r_[self.at, at], np.r_[self.score, score]
        kept = blocks.first_of_each(key, score, self.ids[at], self.unnamed[at], self.k)
        self.key, self.at, self.score = key[kept], at[kept], score[kept]
        full = self.k - 1 + np.nonzero(self.key[self.k - 1 :] == self.key[: len(self.key) - self.k + 1])[0] if self.k <= len(self.key) else []
        self.last[self.key[full]] = self.score[full]


def _companies(cluster: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each cluster with the places of its members, WALKERS at most at a time."""
    for c in np.unique(cluster):
        of = np.nonzero(cluster == c)[0]
        for i in range(0, len(of), WALKERS):
            yield c, of[i : i + WALKERS]


def _sides(block: pa.Table, dimension: int, scale: int) -> tuple[pa.Table, pa.Table, np.ndarray, np.ndarray]:
    side = block.column("side").to_numpy()
    right, left = block.filter(pa.array(side == 0)), block.filter(pa.array(side == 1))
    return left, right, *(blocks.whole_numbers(x.column("vector"), dimension, scale) for x in (left, right))


def _joined(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else tuple(np.zeros(0, dtype=np.int64) for _ in range(3))


def _positives(block: pa.Table, dimension: int, centroids: np.ndarray, scale: int, k: int) -> pa.Table:
    """The first ``k`` other rows of a shard with the label of each anchor of a block."""
    left, right, anchors, rows = _sides(block, dimension, scale)
    anchor_row, row = left.column("row").to_numpy(), right.column("row").to_numpy()
    anchor_label, label = left.column("label").to_numpy(), right.column("label").to_numpy()
    cluster = left.column("cluster").to_numpy()
    shard, named, found = Shard(rows, anchors), blocks.id_columns(right), []
    for c, of in _companies(cluster) if len(rows) else []:
        best = _Best(len(of), k, *named)

        def look(m: np.ndarray, at: np.ndarray, scores: np.ndarray, of: np.ndarray = of, best: _Best = best) -> None:
            fits = (anchor_label[of[m]] == label[at]) & (anchor_row[of[m]] != row[at])
            best.add(m[fits], at[fits], scores[fits])

        walk(shard, anchors[of], centroids[c], look, lambda best=best: best.last)
        found.append((of[best.key], best.at, best.score))
    anchor, at, score = _joined(found)
    return pa.table({"row": anchor_row[anchor], "positive_row": row[at], "positive_id": blocks.id_array(*(x[at] for x in named)), "positive_score": score})


def _negatives(block: pa.Table, dimension: int, centroids: np.ndarray, scale: int, k: int, least: int, most: int) -> pa.Table:
    """The first ``k`` rows of a shard with another label and a score within the bounds, for each positive of each anchor of a block."""
    left, right, anchors, rows = _sides(block, dimension, scale)
    anchor_label, label = left.column("label").to_numpy(), right.column("label").to_numpy()
    cluster = left.column("cluster").to_numpy()
    lists = left.column("positives").combine_chunks()
    taken = np.asarray(lists.value_lengths())
    width = int(taken.max(initial=0))
    score = np.full((len(anchors), width), -1, dtype=np.int64)
    score[np.arange(width) < taken[:, None]] = np.asarray(lists.flatten().field("positive_score"))
    shard, named, found = Shard(rows, anchors), blocks.id_columns(right), []
    lowest = np.where(score < 0, np.inf, least * score / 100)  # below zero nothing fits
    for c, of in _companies(cluster) if len(rows) and width else []:
        best = _Best(len(of) * width, k, *named)

        def look(m: np.ndarray, at: np.ndarray, scores: np.ndarray, of: np.ndarray = of, best: _Best = best) -> None:
            other = anchor_label[of[m]] != label[at]
            m, at, scores = m[other], at[other], scores[other]
            low = score[of[m]]
            fits = (least * low <= 100 * scores[:, None]) & (100 * scores[:, None] <= most * low) & (scores[:, None] >= best.last[m[:, None] * width
                + np.arange(width)])
            i, p = np.nonzero(fits)
            best.add(m[i] * width + p, at[i], scores[i])

        walk(shard, anchors[of], centroids[c], look, lambda of=of, best=best: np.maximum(best.last.reshape(-1, width), lowest[of]).min(1))
        found.append((of[best.key // width] * width + best.key % width, best.at, best.score))
    key, at, score = _joined(found)
    return pa.table({"row": left.column("row").to_numpy()[key // max(width, 1)], "nth": key % max(width, 1), "negative_id": blocks.id_array(*(x[at]
        for x in named)), "negative_score": score})


def clusters_of(anchors: DataFrame, n: int, dimension: int, scale: int) -> tuple[np.ndarray, DataFrame, int]:
    """Centroids, the anchors with their ``cluster`` and ``block``, and the number of blocks.

    Centroids are fitted on a sample of SAMPLE_PER_CLUSTER anchors for each, those of the lowest hashes; every anchor joins the nearest. A block holds the
    anchors of consecutive clusters, about ``blocks.block_rows`` of them; a cluster of more is spread over several.
    """
    k = int(np.clip(min(n // CLUSTER_ANCHORS, CENTROID_BYTES // (8 * max(1, dimension))), 1, MOST_CLUSTERS))
    drawn = anchors.orderBy(F.xxhash64("row"), "row").limit(SAMPLE_PER_CLUSTER * k).select("vector").toArrow()
    sample = directions(blocks.whole_numbers(drawn.column("vector"), dimension, scale))[0]
    centroids = directions(spherical_kmeans(sample, min(k, len(sample))))[0]

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = directions(blocks.whole_numbers(pa.chunked_array([batch.column("vector")]), dimension, scale))[0]
            home = (units @ centroids.T).argmax(1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home)], [*batch.schema.names, "cluster"])

    kind = dict(anchors.dtypes)["vector"]
    placed = materialize(anchors.mapInArrow(nearest, f"row long, id long, label long, vector {kind}, cluster int"), "anchors")
    sizes = {r["cluster"]: r["count"] for r in placed.groupBy("cluster").count().collect()}  # a row per centroid
    most, ahead, dealt = blocks.block_rows(dimension), 0, []
    for c, size in sorted(sizes.items()):
        dealt.append((c, ahead // most, -(-size // most)))
        ahead += size
    first = placed.sparkSession.createDataFrame(dealt, "cluster int, first int, parts int")
    block = F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")
    total = max(first + parts for _, first, parts in dealt)
    return centroids, placed.join(F.broadcast(first), "cluster").withColumn("block", block).drop("first", "parts"), total


def with_their_label(rows: DataFrame, asks: Column, anchors: DataFrame, blocks_n: int, shard_rows: int, dimension: int) -> DataFrame:
    """Rows and anchors for a group (family, shard, block) in which each anchor meets each row of its label once.

    A family has the labels of one hash, so that there are few whatever the number of labels; one label may hold any share of the rows.
    """
    family = lambda df: df.withColumn("family", F.pmod(F.xxhash64("label"), F.lit(FAMILIES)).cast("int"))
    sizes = family(rows).groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(asks, 1)).alias("m")).where("m > 0").collect()  # FAMILIES at most
    dealt = [(r["family"], -(-r["n"] // shard_rows), min(blocks_n, -(-r["m"] // blocks.block_rows(dimension)))) for r in sizes]
    dealt = F.broadcast(rows.sparkSession.createDataFrame(dealt, "family int, shards int, blocks int"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kept = ["row", "id", "label", "vector", "family"]
    right = family(rows).join(dealt, "family").select(*kept, F.lit(0).alias("side"), F.pmod(F.xxhash64("row"), F.col("shards")).cast("int").alias("shard"),
        upto("blocks").alias("block"))
    place = F.floor(F.col("block") * F.col("blocks") / blocks_n).cast("int")  # consecutive clusters stay together
    left = family(anchors).join(dealt, "family").select(*kept, "cluster", F.lit(1).alias("side"), upto("shards").alias("shard"), place.alias("block"))
    return right.unionByName(left, allowMissingColumns=True)


def hard_negatives(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE,
    every: int = EVERY, shifted: int = SHIFTED, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor, a row whose id is divisible by ``every``, and each of
    its first ``positives`` other rows of its label, the first ``negatives`` rows of other labels that score ``least`` to ``most`` hundredths of the
    positive.

    Components become floor(scale * x), scores are integer inner products, higher ones first, ties by smaller id, then rows without an id. Where the id is
    divisible by ``shifted`` the label is one higher, modulo ten. Rows with a null label or vector or a null or non-finite component take no part; shorter
    vectors end in zeros. A row isn't its own positive; other rows that share its id, or its id and vector, may be. A positive of a negative score has no
    negatives, one of zero only those of zero. Scores beyond 2^63 / 100 raise OverflowError. Other columns are ignored; an empty table, or one without
    anchors, gives no rows.
    """
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    vec, tag = F.col(id_col).cast("long"), F.col(label_col).cast("long")
    label = F.when(F.coalesce(vec % shifted == 0, F.lit(False)), (tag + 1) % LABELS).otherwise(tag)
    named = embeddings.select(vec.alias("id"), label.alias("label"), F.col(vector_col).alias("vector"))
    rows = blocks.numbered(named.where(F.col("label").isNotNull() & blocks.usable(F.col("vector"))), "labelled")
    asks = F.coalesce(F.col("id") % every == 0, F.lit(False))
    n, m, dimension = blocks.counts(rows, asks)
    if not m:
        return embeddings.sparkSession.createDataFrame([], out)
    centroids, anchors, parts = clusters_of(rows.where(asks).select("row", "id", "label", "vector"), m, dimension, scale)
    shards = blocks.shards_of(n, dimension)
    shards = max(min(shards, MANY_SHARDS), -(-shards // WIDER))
    taken = rows.select("row", "id", "label", "vector")
    alike = with_their_label(taken, asks, anchors, parts, -(-n // shards), dimension)
    near = alike.groupBy("family", "shard", "block").applyInArrow(lambda b: _positives(b, dimension, centroids, scale,
        positives), "row long, positive_row long, positive_id long, positive_score long")
    ranked = Window.partitionBy("row").orderBy(F.desc("positive_score"), F.col("positive_id").asc_nulls_last(), "positive_row")
    first = near.withColumn("nth", (F.row_number().over(ranked) - 1).cast("long")).where(F.col("nth") < positives)
    first = materialize(first.select("row", "nth", "positive_id", "positive_score"), "positives")
    lists = first.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("nth", "positive_score"))).alias("positives"))  # a few each
    asked = anchors.join(lists, "row")
    far = blocks.in_blocks(taken, shards, asked, parts).groupBy("shard", "block").applyInArrow(lambda b: _negatives(b, dimension, centroids, scale, negatives,
        least, most), "row long, nth long, negative_id long, negative_score long")
    order = Window.partitionBy("row", "nth").orderBy(F.desc("negative_score"), F.col("negative_id").asc_nulls_last())
    kept = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    joined = kept.join(first, ["row", "nth"]).join(anchors.select("row", F.col("id").alias("anchor_id")), "row")
    return joined.select(*[c.split()[0] for c in out.split(", ")])
