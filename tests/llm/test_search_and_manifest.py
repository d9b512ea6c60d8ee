"""Hard negatives, exact top-k and the Merkle manifest against brute force, with nulls, ties, repeated rows, ragged vectors and clashing columns."""

from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brickwise.llm import blocks, merkle, negatives, topk

VECTORS = "vec_id long, embedding array<double>, label int, score string, rank int, row string, block int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, tag, "s", 1, "r", 2) for i, v, tag in rows], VECTORS)


def whole(vector, scale, size):
    return [int(np.floor(scale * x)) for x in vector] + [0] * (size - len(vector))


def usable(vector):
    return vector is not None and all(x is not None and np.isfinite(x) for x in vector)


def in_order(scored):
    """(score, id, place) with higher scores first, then smaller ids, then no id."""
    return sorted(scored, key=lambda x: (-x[0], x[1] is None, x[1] or 0))


def scores(rows, scale):
    size = max((len(v) for _, v, *_ in rows), default=0)
    x = [whole(v, scale, size) for _, v, *_ in rows]
    return lambda i, j: sum(a * b for a, b in zip(x[i], x[j], strict=True))


def brute_top(rows, scale, k, every):
    rows = [r for r in rows if usable(r[1])]
    score, out = scores(rows, scale), []
    for i, (vec, *_) in enumerate(rows):
        if vec is not None and vec % every == 0:
            first = in_order((score(i, j), r[0], j) for j, r in enumerate(rows) if j != i)[:k]
            out += [(vec, n + 1, other, s) for n, (s, other, _) in enumerate(first)]
    return sorted(out, key=str)


def brute_negatives(rows, every=10):
    rows = [(i, v, (t + 1) % 10 if i is not None and i % 7 == 0 else t) for i, v, t in rows if t is not None and usable(v)]
    score, out = scores(rows, 256), []
    for i, (vec, _, tag) in enumerate(rows):
        if vec is None or vec % every:
            continue
        others = [(score(i, j), r[0], j) for j, r in enumerate(rows) if j != i]
        for p, positive, _ in in_order(x for x in others if rows[x[2]][2] == tag)[:5]:
            fit = [x for x in others if rows[x[2]][2] != tag and 30 * p <= 100 * x[0] <= 90 * p]
            out += [(vec, positive, n + 1, other, p, s) for n, (s, other, _) in enumerate(in_order(fit)[:10])]
    return sorted(out, key=str)


def clustered(seed, n, d, spread):
    """Vectors around a few directions, a third of them equal, with every odd case."""
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(6, d))
    rows = [(i, (centres[i % 6] + spread * draw.normal(size=d)).tolist() if i % 3 else [0.25] * d, int(draw.integers(0, 10))) for i in range(n)]
    odd = [(n, None, 1), (n + 1, [float("nan")] * d, 1), (n + 2, [None] * d, 2), (n + 3, [float("inf")] * d, 2), (n + 4, [0.0] * d, 3), (n + 5, [], 3)]
    more = [(None, [0.25] * d, 1), (10, [0.25] * d, 4), (20, [-0.25] * d, 4), (20, [-0.25] * d, 4), (n + 6, [0.5] * (d - 1), 1), (n + 7, [0.5] * d, None)]
    return rows + odd + more


@pytest.mark.parametrize("spread", [0.1, 2.0])
def test_top_k_matches_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(topk, "LIST_ROWS", 50)
    monkeypatch.setattr(blocks, "LEAST_ROWS", 70)
    rows = clustered(1, 240, 6, spread)
    found = topk.top_k(table(spark, rows), F.col("vec_id") % 10 == 0, scale=1024, k=4)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == brute_top(rows, 1024, 4, 10)


def test_top_k_blocks_small_tables_and_large_numbers(spark, monkeypatch):
    rows = clustered(2, 60, 4, 1.0)
    with monkeypatch.context() as small:
        small.setattr(blocks, "block_rows", lambda d: 7)  # many blocks of queries and of rows
        found = topk.top_k(table(spark, rows), F.col("vec_id") % 5 == 0, scale=1024, k=3)
        assert sorted(map(tuple, found.collect()), key=str) == brute_top(rows, 1024, 3, 5)
    few = [(0, [1.0, 2.0], 0), (1, [3.0, -1.0], 0)]
    assert [tuple(r) for r in topk.nearest_rows(table(spark, few)).collect()] == [(0, 1, 1, 1024 * 1024)]
    assert topk.nearest_rows(table(spark, few[:1])).count() == 0
    assert topk.nearest_rows(table(spark, few).limit(0)).count() == 0
    huge = [(i, [1e6 + i / 1024, 5e4 * i, -3.0], 0) for i in range(40)]  # scores near 2^60, beyond doubles
    assert sorted(map(tuple, topk.nearest_rows(table(spark, huge).where("vec_id < 15")).collect()), key=str) == brute_top(huge[:15], 1024, 10, 100)
    with pytest.raises(Exception, match="don't fit"):
        topk.nearest_rows(table(spark, [(0, [1e12], 0), (1, [1e12], 0)])).collect()


def test_reading_stops_before_the_lists_end():
    draw = np.random.default_rng(3)
    rows = draw.normal(size=(400, 3)) * 100
    rows[:20] += 1000
    query = np.array([1.0, 2.0, 0.0])
    left, floor = topk.undecided(query, np.sort(rows, axis=0), rows, np.zeros(400, bool), 5, -np.inf)
    first = set(np.argsort(-(rows @ query))[:5])
    assert first <= set(left) and len(left) <= 50 and floor <= np.sort(rows @ query)[-5]
    own = np.zeros(400, bool)
    own[list(first)] = True
    assert not first & set(topk.undecided(query, np.sort(rows, axis=0), rows, own, 5, -np.inf)[0])


@pytest.mark.parametrize("spread", [0.1, 2.0])
def test_hard_negatives_match_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(negatives, "CLUSTER_ANCHORS", 5)
    monkeypatch.setattr(negatives, "STRIDE", 16)
    monkeypatch.setattr(negatives, "WALKERS", 3)
    monkeypatch.setattr(blocks, "LEAST_ROWS", 60)
    monkeypatch.setattr(blocks, "block_rows", lambda d: 100)
    rows = clustered(4, 210, 6, spread)
    found = negatives.hard_negatives(table(spark, rows), every=10)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    expected = brute_negatives(rows)
    assert len(expected) > 300
    assert sorted(map(tuple, found.collect()), key=str) == expected


def test_hard_negatives_of_small_tables(spark):
    none = negatives.hard_negatives(table(spark, [(0, [1.0], 1)]).limit(0))
    assert none.count() == 0 and none.columns[0] == "anchor_id"
    assert negatives.hard_negatives(table(spark, [(1, [1.0], 1), (2, [1.0], 2)])).count() == 0  # no anchor
    assert negatives.hard_negatives(table(spark, [(0, [1.0], 0), (1, [1.0], 3)])).count() == 0  # no positive: the anchor's label is 1
    zero = [(100, [0.0], 5), (1, [1.0], 5), (2, [1.0], 6)]
    assert [tuple(r) for r in negatives.hard_negatives(table(spark, zero)).collect()] == [(100, 1, 1, 2, 0, 0)]


def test_work_of_a_block_grows_with_its_anchors(monkeypatch):
    ranked = []
    first_of_each = blocks.first_of_each
    monkeypatch.setattr(blocks, "first_of_each", lambda key, *more: ranked.append(len(key)) or first_of_each(key, *more))
    draw = np.random.default_rng(6)
    vectors, labels, centroids = draw.normal(size=(3000, 8)), draw.integers(0, 3, 3000), negatives.directions(draw.normal(size=(120, 8)))[0]

    def cost(clusters):
        n = 2000 + 8 * clusters
        block = pa.table({"row": np.arange(n), "id": np.arange(n), "label": labels[:n], "vector": list(vectors[:n]), "side": (np.arange(n) >= 2000) * 1,
            "cluster": np.r_[np.zeros(2000, int), np.arange(n - 2000) // 8]})
        scores = [[{"positive_score": s} for s in (2_000_000, 1_800_000, 1_600_000)] if i >= 2000 else None for i in range(n)]
        ranked.clear()
        assert len(negatives._positives(block, 8, centroids, 256, 5)) == 5 * 8 * clusters
        assert len(negatives._negatives(block.append_column("positives", pa.array(scores)), 8, centroids, 256, 10, 1, 90)) > 8 * clusters
        return sum(ranked)

    assert cost(120) < 6 * cost(30)


def test_members_leave_a_shared_list_early():
    draw = np.random.default_rng(5)
    rows = np.concatenate([np.array([100.0, 0, 0]) + draw.normal(size=(50, 3)), np.array([-100.0, 0, 0]) + draw.normal(size=(5000, 3))])
    members = np.array([[10.0, 0, 0], [10.0, 1, 0]])
    centroid = negatives.directions(members)[0].mean(0)
    centroid /= np.linalg.norm(centroid)
    seen = []
    order, bound = negatives.shared_list(rows, members, centroid)
    assert (rows[order] @ members.T <= bound[:, None] * np.linalg.norm(members, axis=1) + 1e-6).all()
    negatives.walk(rows, members, centroid, lambda m, r, s: seen.extend(r), lambda: np.full(2, 500.0))
    assert len(seen) <= negatives.STRIDE


def hashed(nodes):
    return sha256("".join(nodes).encode()).hexdigest()


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([hashed(levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, i):
    for level in levels[:-1]:
        yield level[i - i % 16 : i], level[i + 1 : i - i % 16 + 16]
        i //= 16


def leaf_of(row):
    return hashed(["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def brute_manifest(rows):
    by = {}
    for row in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))):
        by.setdefault(row[1], []).append(row)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([leaf_of(r) for r in by[s]]) for s in sources}
    top = tree([trees[s][-1][0] for s in sources])
    for k, s in enumerate(sources):
        for i, row in enumerate(by[s]):
            path = [*siblings(trees[s], i), *siblings(top, k)]
            text = row[4]
            if text is not None and row[0] is not None and crc32(str(row[0]).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = leaf_of((*row[:4], text))
            for left, right in path:
                folded = hashed([*left, folded, *right])
            proof = hashed([d for left, right in path for d in left + right])
            yield row[0], leaf_of(row), trees[s][-1][0], top[-1][0], proof, folded, folded == top[-1][0]


DOCUMENTS = "doc_id long, source string, lang string, n_chars long, text string, place int, tree string, root int"


def documents(spark, rows):
    return spark.createDataFrame([(*r, 1, "t", 2) for r in rows], DOCUMENTS)


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_manifest_matches_brute_force(spark, levels):
    source = lambda i: ["big", "é", "b", None, "", "Z", f"s{i}"][min(i % 9, 6)] if i % 2 else "big"
    rows = [(i, source(i), "en", 10 * i, f"Text Ünd {i} " * (i % 5)) for i in range(700)]
    rows += [(None, "big", None, None, None), (None, None, None, None, "A"), (3, "big", "x", 1, "A"), (3, "big", "x", 1, "A"), (5, "é", "x", -1, "L" * 100_000)]
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    found = merkle.manifest(documents(spark, rows), tampered, lower, levels)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(brute_manifest(rows), key=str)


def test_manifest_of_small_tables(spark):
    assert merkle.document_manifest(documents(spark, [(1, "a", "b", 1, "c")]).limit(0)).count() == 0
    one = [(1, None, None, None, "Lone")]
    assert [tuple(r) for r in merkle.document_manifest(documents(spark, one)).collect()] == list(brute_manifest(one))
    runs = [(i, "a", "b", 1, "c") for i in range(17)]  # the last run is one node
    assert sorted(map(tuple, merkle.document_manifest(documents(spark, runs)).collect())) == sorted(brute_manifest(runs))
