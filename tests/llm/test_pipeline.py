"""The pipeline's stages on the smallest tables, each held against its own input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brickwise.llm import bpe, pii, simhash
from brickwise.runtime import materialize


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(materialize(stage(spark, docs[-1], sf_dir), "stage"))
    return docs


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_all_but_the_last_stage_keep_the_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(set(d.columns) == set(stages[0].columns) for d in stages[1:-1])


def test_good_documents_stay_and_junk_goes(spark, sf_dir, stages):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = {r.doc_id for r in stages[1].select("doc_id").collect()}
    marked = [(r.doc_id in kept, r.quality) for r in labels.collect()]
    assert sum(k == bool(q) for k, q in marked) >= 0.95 * len(marked)


def test_one_of_each_group_of_near_copies_stays(stages):
    texts = {r.doc_id: shingles(r.text or "") for r in stages[1].collect()}
    ids = sorted(texts)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and len(texts[a] & texts[b]) >= 0.8 * len(texts[a] | texts[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(i for i in ids if find(i) == i)


def test_near_copies_of_every_kind(spark):
    base = [f"w{i * i % 1009}" for i in range(200)]
    edited = [*base[:50], "new", *base[51:120], *base[121:]]
    rows = [(1, " ".join(base)), (2, " ".join(base).upper().replace(" ", "\n")), (3, " ".join(edited)), (4, " ".join(base[:100])), (5, None), (6, " "), (7,
        "a b"), (8, "a b"), (8, "other"), (None, "a b")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, root int")
    assert {tuple(r) for r in simhash.near_copy_groups(docs).collect()} == {(2, 1), (3, 1), (6, 5), (8, 7)}
    kept = [r.doc_id for r in simhash.keep_one_of_each_group(docs).collect()]
    assert sorted(kept, key=str) == sorted([1, 4, 5, 7, None], key=str)
    assert simhash.keep_one_of_each_group(docs.limit(0)).count() == 0


def lowest_of_groups(texts):
    """Brute force: by id, the smallest id that near copies can reach."""
    ids, sets = sorted(texts), {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in ids}
    for a in ids:
        for b in ids:
            if a < b and root[a] != root[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return root


def groups_found(spark, texts):
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    return {i: i for i in texts} | {r.id: r.root for r in simhash.near_copy_groups(docs).collect()}


def test_near_copies_that_repeat_themselves(spark):
    base = " ".join(f"w{i * i % 1009}" for i in range(200))
    line = "all rights reserved by the makers of this page "
    texts = {1: base, 2: f"{base} {base}", 3: "x y z " + line * 10 + base[:600], 4: "x y z " + line * 90 + base[:600]}
    assert groups_found(spark, texts) == lowest_of_groups(texts) == {1: 1, 2: 1, 3: 3, 4: 3}


def test_near_copies_that_share_rare_passages_with_others(spark):
    base = [f"w{i}" for i in range(1500)]
    edited = lambda name, places: [f"{name}{i}" if i in places else w for i, w in enumerate(base)]
    first, second = edited("a", range(50, 1450, 100)), edited("b", range(100, 1450, 100))
    texts = {i: " ".join(t) for i, t in enumerate([first, [*first, "more"], second, [*second, "end"]])}
    assert groups_found(spark, texts) == lowest_of_groups(texts) == {0: 0, 1: 0, 2: 0, 3: 0}


def test_near_copies_of_few_words(spark):
    random = np.random.default_rng(4)
    texts = {}
    for size in range(6, 41):
        words = [f"s{size}w{i}" for i in range(size)]
        at = int(random.integers(1, size))
        for kind in ([*words], [*words, "after"], ["before", *words], words[1:], words[:-1], [*words[:at], *words[at + 1 :]], [*words[:at], "within",
            *words[at:]]):
            texts[len(texts)] = " ".join(kind)
    expected = lowest_of_groups(texts)
    assert len(set(expected.values())) < len(texts)
    assert groups_found(spark, texts) == expected


def test_near_copies_whose_fingerprints_differ_in_23_bits(spark):
    words = [f"v53x{i}" for i in range(9)]
    assert groups_found(spark, {1: " ".join(words[:8]), 2: " ".join(words)}) == {1: 1, 2: 1}


def test_near_copies_of_a_larger_table_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    sets = {r.doc_id: shingles(r.text or "") for r in docs.collect()}
    holders, pairs = {}, {}
    for i, s in sorted(sets.items()):
        for x in s:
            for j in holders.setdefault(x, []):
                pairs[j, i] = pairs.get((j, i), 0) + 1
            holders[x].append(i)
    root = {i: i for i in sets}
    for (a, b), n in pairs.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    found = {i: i for i in sets} | {r.id: r.root for r in simhash.near_copy_groups(docs).collect()}
    assert found == root and len(set(root.values())) < len(root)


def test_no_personal_data_is_left(stages):
    assert pii.pii_report(stages[3]).where("n_email + n_ip + n_card + n_phone > 0").count() == 0
    assert stages[3].count() == stages[2].count()
    assert stages[3].where(F.length("text") != F.col("n_chars")).count() == 0


def test_sources_come_near_their_targets(stages):
    from brickwise.llm import mixing

    words = stages[4].groupBy("source").agg(F.sum(mixing.word_count("text")).alias("n")).collect()
    plan = mixing.Mix(stages[3])
    targets = {r["_bw_source"]: r["target"] for r in plan.sources.collect()}
    assert all(abs(r.n - targets[r.source]) <= 1 for r in words)


def bpe_tokens(ids):
    tokens = bpe.read_ranks(__import__("public_tokenizers").path(bpe.VOCABULARY))
    return b"".join(tokens[i] for i in ids)


def test_every_row_is_encoded(spark, sf_dir, stages):
    assert stages[5].count() == stages[4].count()
    first = stages[4].orderBy("doc_id").first()
    found = stages[5].where(F.col("doc_id") == first.doc_id).first()
    codec = bpe.ByteBpe()
    size = spark.createDataFrame([(first.text,)], "t string").select(F.size(codec.encode("t"))).first()[0]
    assert found.n_tokens == size == len(found.ids) and bytes(bpe_tokens(found.ids)).decode() == first.text
    facts = lambda rows: sorted((r.doc_id, r.source, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows.collect())
    assert facts(corpus_pipeline.run(spark, sf_dir)) == facts(stages[5])


def test_signatures_bound_what_sets_share():
    random = np.random.default_rng(7)
    for size in (0, 1, 7, 60, 500, 3000):
        base = random.integers(0, 2**64, size + size // 3, dtype=np.uint64)
        for begin in (0, size // 20, size // 3):
            a, b = np.unique(base[:size]), np.unique(base[begin : begin + size])
            shared = len(np.intersect1d(a, b))
            near = shared >= 0.8 * (len(a) + len(b) - shared)
            found = simhash.may_share(simhash.signature(a), simhash.signature(b), 0.8)
            assert found or not near
            assert size < 500 or found == near
    many = np.arange(300, dtype=np.uint64) << np.uint64(32)
    assert simhash.signature(many) == b"" and simhash.may_share(b"", simhash.signature(many[:9]), 0.8)


def test_texts_that_share_a_passage_only_are_told_apart_without_their_sets(spark, monkeypatch):
    counted = {}

    def noted(df, label):
        out = materialize(df, label)
        counted.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(simhash, "materialize", noted)
    texts = {i: " ".join([*(f"t{i}w{k}" for k in range(250)), *(f"p{i // 2}w{k}" for k in range(60))]) for i in range(120)}
    texts[500], texts[501] = (" ".join(f"n{k}" for k in range(n)) for n in (300, 305))
    assert groups_found(spark, texts) == {i: 500 if i == 501 else i for i in texts}
    assert counted["candidates"][0] + counted["other-candidates"][0] > 40
    assert max(counted["shingle-sets"]) == 2
