"""A Merkle manifest of a table, with proofs: subtrees are exchanged by superblocks.

Leaves of a group (a source) stand in order and belong to superblocks of WIDTH ** LEVELS. On the way up every superblock is reduced to one node, those
nodes belong to superblocks of their own, and so on until each group is one node; the groups' nodes are the leaves of one more tree. On the way down the
nodes of a superblock are cogrouped with the one outer row that they need, the siblings of all their common ancestors: each cogroup reduces
its subtree again, joins the proofs and, at the leaves, folds them. Only digests travel, and no task holds more than a superblock.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickwise.operators.prefix import running_sums
from brickwise.runtime import broadcast_if_small, discard, materialize

#: Children of a node, and which rows are tampered with.
WIDTH, TAMPERED = 16, 5
#: Levels of a superblock.
LEVELS = 3
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
#: For each level from the bottom: the node's place in its run, and the run's other digests.
PATH = "array<struct<place: int, others: array<string>>>"
PATH_TYPE = pa.list_(pa.struct([("place", pa.int32()), ("others", pa.list_(pa.string()))]))


def leaf_digest(columns: list[Column]) -> Column:
    """Digest of a row: each column as ``-`` if null, else its UTF-8 byte count, a colon and its value."""
    text = lambda c: c.cast("string")
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("-")) for c in columns]), 256)


def _digest(nodes: list[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def _levels(nodes: list[str], height: int) -> Iterator[list[str]]:
    """The nodes, then those of each level above up to ``height``."""
    yield nodes
    for _ in range(height):
        nodes = [_digest(nodes[i : i + WIDTH]) for i in range(0, len(nodes), WIDTH)]
        yield nodes


def _height(block: int, size: int, levels: int) -> int:
    """Levels that a superblock reduces: all, but for the only one of a small tree, which stops at one node."""
    if block > 0 or size == WIDTH**levels:
        return levels
    return next(h for h in range(levels + 1) if WIDTH**h >= size)


def _in_order(table: pa.Table) -> pa.Table:
    return table.sort_by("place")


def _reduced(table: pa.Table, levels: int) -> pa.Table:
    """The node that a superblock becomes."""
    table = _in_order(table)
    tree, block = table.column("tree")[0].as_py(), table.column("block")[0].as_py()
    *_, top = _levels(table.column("digest").to_pylist(), _height(block, table.num_rows, levels))
    return pa.table({"tree": [tree], "place": [block], "digest": top})


def _paths(nodes: list[str], height: int, outer: list[dict]) -> Iterator[list[dict]]:
    """For each node its siblings up to the superblock's top, followed by those outside."""
    levels = list(_levels(nodes, height))[:-1]
    for i in range(len(nodes)):
        path = []
        for h, level in enumerate(levels):
            at = i // WIDTH**h
            run = level[at - at % WIDTH : at - at % WIDTH + WIDTH]
            path.append({"place": at % WIDTH, "others": run[: at % WIDTH] + run[at % WIDTH + 1 :]})
        yield path + outer


def _handed_down(members: pa.Table, outer: pa.Table, levels: int) -> pa.Table:
    """Paths of a superblock's nodes."""
    members = _in_order(members)
    block = members.column("block")[0].as_py()
    paths = list(_paths(members.column("digest").to_pylist(), _height(block, members.num_rows, levels), outer.column("path")[0].as_py()))
    return pa.table({"tree": members.column("tree"), "place": members.column("place"), "path": pa.array(paths, PATH_TYPE)})


def _folded(leaf: str, path: list[dict]) -> str:
    for level in path:
        run = list(level["others"])
        run.insert(level["place"], leaf)
        leaf = _digest(run)
    return leaf


def _proved(leaves: pa.Table, outer: pa.Table, levels: int) -> pa.Table:
    """Proofs of a superblock's leaves, and the roots that they fold to from what the rows are now."""
    leaves = _in_order(leaves)
    block, now = leaves.column("block")[0].as_py(), leaves.column("now").to_pylist()
    proofs, folded = [], []
    for leaf, path in zip(now, _paths(leaves.column("digest").to_pylist(), _height(block, leaves.num_rows, levels), outer.column("path")[0].as_py()),
        strict=True):
        proofs.append(_digest([d for level in path for d in level["others"]]))
        folded.append(_folded(leaf, path))
    n = leaves.num_rows
    return pa.table({"id": leaves.column("id"), "leaf": leaves.column("digest"), "subroot": outer.column("subroot").to_pylist() * n,
        "root": outer.column("root").to_pylist() * n, "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string())})


def _blocked(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("place") / WIDTH**levels))


def reduce_up(leaves: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """Tables of (tree, place, digest): the leaves given, then the nodes of each height of superblocks until every tree is one node."""
    stages = [leaves]
    while True:
        grouped = _blocked(stages[-1].select("tree", "place", "digest"), levels).groupBy("tree", "block")
        stages.append(materialize(grouped.applyInArrow(lambda t: _reduced(t, levels), "tree long, place long, digest string"), "nodes"))
        if not stages[-1].where("place > 0").take(1):
            return stages


def hand_down(nodes: DataFrame, above: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(tree, place, path) of nodes, from the paths of the nodes that their superblocks became."""
    outer = above.withColumnRenamed("place", "block").groupBy("tree", "block")
    members = _blocked(nodes.select("tree", "place", "digest"), levels).groupBy("tree", "block")
    return materialize(members.cogroup(outer).applyInArrow(lambda m, o: _handed_down(m, o, levels), f"tree long, place long, path {PATH}"), "paths")


def ordered_leaves(rows: DataFrame, source: str, order_by: list[str]) -> DataFrame:
    """Rows with ``tree``, the number of their source, and ``place`` in it.

    Sources are numbered in order, null first, bytewise. Rows are dealt into ordered ranges, so that a source may hold any share of them.
    """
    sources = materialize(rows.groupBy(source).count().withColumn("one", F.lit(1).cast("long")), "sources")
    numbered = materialize(running_sums(sources, [source], {"one": "tree", "count": "ahead"}, "source-order"), "source-numbers")
    keyed = numbered.select(F.col(source).alias("_bw_source"), "tree", "ahead")
    placed = running_sums(rows.withColumn("one", F.lit(1).cast("long")), [source, *order_by], {"one": "at"}, "leaf-order")
    joined = placed.join(broadcast_if_small(keyed), placed[source].eqNullSafe(F.col("_bw_source")))
    leaves = materialize(joined.withColumn("place", F.col("at") - F.col("ahead")).drop("one", "at", "ahead", "_bw_source"), "leaves")
    discard(sources, numbered)
    return leaves


def manifest(documents: DataFrame, tampered: Column, changed_text: Column, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of ``documents`` (doc_id, source, lang, n_chars, text).

    Where ``tampered`` holds the text is ``changed_text`` when proofs are folded; leaves, nodes and proofs are those of the rows as they were. Leaves of a
    source ascend by doc_id, null first; rows that share an id are ordered by their digests. A null source is a source of its own. Rows that are equal are
    leaves of their own. Other columns are ignored; an empty table gives no rows.
    """
    changed = [F.when(tampered, changed_text).otherwise(F.col("text")) if c == "text" else F.col(c) for c in COLUMNS]
    rows = documents.select(F.col("doc_id").cast("long").alias("id"), "source", leaf_digest([F.col(c) for c in COLUMNS]).alias("digest"),
        leaf_digest(changed).alias("now"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows, "digests")
    leaves = ordered_leaves(rows, "source", ["id", "digest", "row"])  # equal rows are dealt out by their numbers
    discard(rows)
    stages = reduce_up(leaves, levels)
    subroots = stages[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), "digest")
    top = reduce_up(subroots, levels)
    path = top[-1].select("tree", "place", F.array().cast(PATH).alias("path"))
    for nodes in reversed(top[:-1]):
        path = hand_down(nodes, path, levels)
    root = F.broadcast(top[-1].select(F.col("digest").alias("root")))  # one row
    path = path.select(F.col("place").alias("tree"), F.lit(0).cast("long").alias("place"), "path")
    for nodes in reversed(stages[1:-1]):
        path = hand_down(nodes, path, levels)
    outer = path.join(stages[-1].select("tree", F.col("digest").alias("subroot")), "tree").crossJoin(root)
    outer = outer.withColumnRenamed("place", "block").groupBy("tree", "block")
    schema = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    proved = _blocked(leaves, levels).groupBy("tree", "block").cogroup(outer).applyInArrow(lambda m, o: _proved(m, o, levels), schema)
    return proved.withColumnRenamed("id", "doc_id").withColumn("verified", F.col("folded_root") == F.col("root"))


def document_manifest(documents: DataFrame) -> DataFrame:
    """The manifest where every fifth id, by checksum, had its text's A-Z lower-cased afterwards."""
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0, F.lit(False))
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return manifest(documents, tampered, lower)
