"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import base64
import hashlib
import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from brickwise.llm import bpe, chat, ebm, embed_dedup, imatch, mixing, pii, queries, sharding, simhash, url_rules

DOCS = "doc_id long, text string, source string, component_id int, fingerprint string, score string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, s, 7, "x", "y") for i, t, s in rows], DOCS)


WORDS = [f"w{i}" for i in range(400)]
MIXED = [
    (1, "the quick brown fox jumps over the lazy dog " * 4, "a"),
    (2, None, "a"),
    (3, "", None),
    (4, "  \t\n", "b"),
    (5, "one", "b"),
    (5, "one", "b"),
    (6, "mail me.at@x.org or 10.0.0.1, card 4111 1111 1111 1111, +1 (234) 567-8901 é日本𝒳", "c"),
    (None, "no id here", "c"),
    (7, " ".join(WORDS), "a"),
    (8, " ".join(WORDS[:200]) + " changed " + " ".join(WORDS[201:]), "a"),
    (9, "x" * 50_000, None),
]


@pytest.fixture(scope="module")
def mixed(spark):
    return documents(spark, MIXED).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [(1, "a", "b")]).limit(0)


def roots(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# --- SimHash


def test_golay_keys_meet_at_distance_one():
    nearest, around = simhash.golay_tables()
    words = np.random.default_rng(1).integers(0, 65536, 500)
    for bit in range(16):
        assert (around[words] == nearest[words ^ (1 << bit)][:, None]).any(axis=1).all()


def components_of(values):
    mask = (1 << 64) - 1
    near = [(i, j) for i, a in enumerate(values) for j, b in enumerate(values[:i]) if ((a ^ b) & mask).bit_count() <= 3]
    return [values[r] for r in roots(len(values), near)]


@pytest.mark.parametrize("few", [0, 2, 64])
def test_near_links_have_the_components_of_all_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(simhash, "FEW", few)
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 5)
    random = np.random.default_rng(2)
    flipped = lambda b, n: int(np.int64(b) ^ np.bitwise_or.reduce(np.array([1 << int(k) for k in random.choice(64, n, replace=False)],
        dtype=np.uint64)).view(np.int64))
    values = {int(b) for b in random.integers(-(2**63), 2**63 - 1, 40)}
    for b in list(values):
        values |= {flipped(b, n) for n in (1, 2, 3, 4)}
    values |= {flipped(min(values), n) for n in (1, 2, 3) for _ in range(40)}
    values = sorted(values)
    expected = components_of(values)
    links = [tuple(r) for r in simhash.near_links(spark.createDataFrame([(v,) for v in values], "fp long")).collect()]
    place = {v: i for i, v in enumerate(values)}
    assert [values[r] for r in roots(len(values), [(place[a], place[b]) for a, b in links])] == expected
    assert len(set(expected)) < len(values)


def test_links_of_one_ball_grow_with_its_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "FEW", 8)
    ball = [0, *(1 << i for i in range(63)), *(1 << i | 1 << j for i in range(63) for j in range(i))]
    count = lambda values: simhash.near_links(spark.createDataFrame([(v,) for v in values], "fp long")).count()
    part, whole = count(ball[::4]), count(ball)
    assert whole < 5 * part and whole < 60 * len(ball)


@pytest.fixture
def small_broadcasts(spark):
    """Broadcasts of over 2 MB fail, as larger ones do in a small driver."""
    spark.conf.set("spark.sql.maxBroadcastTableSize", "2m")
    yield
    spark.conf.unset("spark.sql.maxBroadcastTableSize")


def test_keys_of_fingerprints_are_not_broadcast(spark, small_broadcasts):
    nodes = spark.range(5000).select(F.xxhash64("id").alias("fp"))
    near = nodes.unionByName(nodes.where("fp % 5 = 0").select(F.expr("fp ^ 5").alias("fp")))
    grouped = simhash.group_by_fingerprint(near.withColumn("doc_id", F.monotonically_increasing_id())).groupBy("component_id").count()
    assert grouped.where("count = 2").count() == near.count() - 5000 > 900


def test_near_copies_are_found_without_large_broadcasts(spark, small_broadcasts):
    spark.conf.set("spark.sql.maxBroadcastTableSize", "48m")  # a table of two keys takes 32 MB at least
    words = F.concat_ws(" ", *[F.xxhash64("doc_id", F.lit(k)).cast("string") for k in range(3)])
    documents = spark.range(20000).select(F.col("id").alias("doc_id")).withColumn("text", words)
    again = documents.where("doc_id % 10 = 0").select((F.col("doc_id") + 20000).alias("doc_id"), F.concat(F.lit(" "), "text").alias("text"))
    kept = simhash.keep_one_of_each_group(documents.unionByName(again))
    assert kept.agg(F.count("doc_id"), F.max("doc_id")).first() == (20000, 19999)


def test_sets_of_near_copies_are_not_broadcast(spark, small_broadcasts):
    spark.conf.set("spark.sql.maxBroadcastTableSize", "48m")
    words = F.expr("concat_ws(' ', transform(sequence(0, 7999), i -> if(i = 1000 + id % 6000, concat('new', id), concat('w', i))))")
    documents = spark.range(800).select(F.col("id").alias("doc_id"), words.alias("text"))
    assert simhash.near_copy_groups(documents).agg(F.count("id"), F.max("root")).first() == (799, 0)


def test_many_copies_are_grouped_without_large_broadcasts(spark, small_broadcasts):
    spark.conf.set("spark.sql.maxBroadcastTableSize", "40m")
    documents = spark.range(420_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("one of "), F.xxhash64(F.expr("id % 2000"))).alias("text"))
    assert simhash.near_copy_groups(documents).agg(F.count("id"), F.max("root")).first() == (418_000, 1999)


def test_fingerprint_is_the_majority_of_shingle_hashes(spark):
    text = "A b\tC d e f g"
    shingles = [" ".join(text.lower().split()[i : i + 3]) for i in range(5)]
    hashes = [r[0] for r in spark.createDataFrame([(s,) for s in shingles], "s string").select(F.xxhash64("s")).collect()]
    ones = [sum(h >> b & 1 for h in hashes) for b in range(64)]
    expected = sum(1 << b for b, n in enumerate(ones) if 2 * n > 5)
    assert simhash.fingerprint_bytes(text.encode()) & ((1 << 64) - 1) == expected
    assert simhash.fingerprint_bytes(b"") == simhash.fingerprint_bytes(b" \n") == 0


def test_simhash_components(spark, mixed, empty):
    found = sorted((tuple(r) for r in simhash.simhash_components(mixed).collect()), key=str)
    assert len(found) == len(MIXED)
    by_id = {r[0]: r for r in found}
    assert by_id[2][1] == "0" * 16 and by_id[2][2] == by_id[3][2] == by_id[4][2] == 2
    assert by_id[5][2] == 5 and by_id[None][2] is None
    assert simhash.simhash_components(empty).count() == 0


def test_keep_one_of_each_group(spark, mixed):
    kept = [r["doc_id"] for r in simhash.keep_one_of_each_group(mixed).collect()]
    assert sorted(kept, key=str) == sorted([1, 2, 5, 6, 7, None, 9] + ([8] if 8 in kept else []), key=str)


# --- quality


def test_additive_model_learns_an_interaction():
    random = np.random.default_rng(3)
    x = random.random((3000, len(ebm.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = ebm.fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9


def test_quality_held_out_accuracy(spark, sf_dir):
    folder = sf_dir.replace("0.001", "0.01")
    rows = queries.op9_quality(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.97


def test_score_is_the_sum_of_looked_up_values():
    random = np.random.default_rng(8)
    x = random.random((400, len(ebm.FEATURES)))
    model = ebm.fit(x, ((x[:, 0] + x[:, 1] * x[:, 2]) > 0.8).astype(float), rounds=5, pair_rounds=3)
    for row, found in zip(x[:60], model.score(x[:60]), strict=True):
        total = model.intercept
        for f, table in enumerate(model.tables):
            total += table[sum(e <= row[f] for e in model.edges[f])]
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            total += table[sum(e <= row[a] for e in model.coarse[a])][sum(e <= row[b] for e in model.coarse[b])]
        assert abs(found - 1 / (1 + np.exp(-total))) < 1e-12


def test_a_tree_of_two_leaves_is_the_best_split():
    random = np.random.default_rng(9)
    for _ in range(20):
        g, h = random.normal(size=12), random.random(12) * 4
        gain = lambda s: g[s].sum() ** 2 / (h[s].sum() + 1)
        fits = [c for c in range(1, 12) if min(h[:c].sum(), h[c:].sum()) >= 2]
        best = max(fits, key=lambda c: gain(slice(0, c)) + gain(slice(c, 12)))
        expected = np.zeros(12)
        for s in (slice(0, best), slice(best, 12)) if gain(slice(0, best)) + gain(slice(best, 12)) - gain(slice(0, 12)) > 1e-9 else (slice(0, 12),):
            expected[s] = g[s].sum() / (h[s].sum() + 1)
        assert np.allclose(ebm._tree(g, h, 2, 2.0), expected)


def test_an_id_is_learnt_from_once(spark, monkeypatch):
    docs = documents(spark, [(i % 7, f"words {i} and more", None) for i in range(200)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(ebm, "fit", lambda x, y: seen.append((x, y)) or ebm.AdditiveModel())
    ebm.learn(docs, labels)
    ebm.learn(docs.repartition(5), labels)
    allowed = [i for i in range(7) if ebm.crc_remainder(i) != 2]
    assert len(seen[0][1]) == len(allowed) and np.array_equal(seen[0][0], seen[1][0])


def test_quality_edge_cases(spark, mixed, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (7, 0, None), (5, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = ebm.quality_scores(mixed, labels).collect()
    assert len(rows) == len(MIXED) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (r["doc_id"] is None or ebm.crc_remainder(r["doc_id"]) == 2) for r in rows)
    assert ebm.quality_scores(empty, labels).count() == 0
    assert {r["score"] for r in ebm.quality_scores(mixed, labels.limit(0)).collect()} == {0.5}


# --- personal data

BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def base_spans(text):
    def valid(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "phone":
            return 10 <= len(digits) <= 15
        if kind == "card":
            doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
            return 14 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
        return True

    spans = sorted((m.start(), i, k, m.end()) for i, (k, p) in enumerate(BASE) for m in re.finditer(p, text) if valid(k, m.group()))
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)


TRICKY = ["x@a.b_c@d.ef .@a.b", "1.2.3.4.5.6.7.8 999.1.1.1 01.02.03.0004", "4111-1111-1111-1111 4111  1111 1111 1111 1", "+12 345 678 90 1+(234)",
    "a@b" + ".c" * 3000, "1." * 3000, "1" * 20000, "4 " * 9000, "𝒳é a@b.c 𝒳 10.0.0.1"]


def test_base_spans_match_brute_force(spark, mixed, empty):
    rows = MIXED + [(100 + i, t, None) for i, t in enumerate(TRICKY)]
    found = {(r["doc_id"], r["base_sha256"]) for r in pii.pii_report(documents(spark, rows)).collect()}
    assert found == {(i, hashlib.sha256(base_spans(t or "").encode()).hexdigest()) for i, t, _ in rows}
    assert pii.pii_report(empty).count() == 0


def test_checksums_and_context_add_spans_and_redact(spark):
    text = "IBAN DE89 3704 0044 0532 0130 00, not DE88 3704 0044 0532 0130 00; ssn 123-45-6789 but 123-45-6789" + " " * 60 + "then 123-45-6780"
    docs = documents(spark, [(1, text, None), (2, None, None)])
    assert pii.pii_report(docs).where("doc_id = 1").first()["spans"] == "iban:5:32,ssn:71:82,ssn:87:98"
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert clean[2] is None and clean[1].startswith("IBAN <IBAN>, not DE88") and clean[1].endswith("123-45-6780")
    assert pii.redact(docs).columns == docs.columns


def test_context_on_both_sides_and_overlaps(spark):
    texts = ["123-45-6789 is a social security number", "123-45-6789" + " " * 49 + "ssn", "ssn " + "123-45-6789 " * 9, "call:555-123-4567",
        "ssn 123-45-6789@x.org a@b.c ssn 123-45-6789"]
    found = {r["doc_id"]: r["spans"] for r in pii.pii_report(documents(spark, [(i, t, None) for i, t in enumerate(texts)])).collect()}
    within = [4 + 12 * i for i in range(9) if 12 * i + 1 <= 48]
    assert found[0] == "ssn:0:11" and found[1] == "" and found[3] == "localphone:5:17"
    assert found[2] == ",".join(f"ssn:{a}:{a + 11}" for a in within)
    assert found[4] == "email:4:21,email:22:27,ssn:32:43"


def test_many_matches_in_one_text(spark):
    import time

    def seconds(n):
        text = "".join(f"mail a{i}@b{i}.org, ssn 123-45-{1000 + i % 9000}; " for i in range(n))
        docs = documents(spark, [(1, text, None)])
        began = time.perf_counter()
        report, clean = pii.pii_report(docs).first(), pii.redact(docs).first()["text"]
        assert report["n_email"] == n and report["spans"].count("ssn:") == n
        assert report["base_sha256"] == hashlib.sha256(base_spans(text).encode()).hexdigest()
        assert clean == "mail <EMAIL>, ssn <SSN>; " * n
        return time.perf_counter() - began

    few = seconds(2000)
    assert seconds(20_000) < 3 * few + 20


# --- mixing


def test_mix_matches_sql_and_rows(spark, mixed, empty):
    import duckdb

    frame = mixed.select("doc_id", "text", "source").where("doc_id is not null").dropDuplicates(["doc_id"]).toPandas()
    connection = duckdb.connect()
    connection.register("documents", frame)
    expected = sorted(connection.sql(queries.OP1_SQL).fetchall())
    mix = mixing.Mix(spark.createDataFrame(frame))
    found = sorted(tuple(r) for r in mix.plan().select("doc_id", "size", "source_size", "target", "taken").collect())
    assert [f[:3] + f[4:] for f in found] == [e[:3] + e[4:] for e in expected] and np.allclose([f[3] for f in found], [e[3] for e in expected])
    words = {}
    for r in mix.rows().collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    assert words == {f[0]: f[4] for f in found if f[4]}
    assert mixing.Mix(empty).plan().count() == 0 and mixing.Mix(empty).rows().count() == 0


def test_mix_caps_and_reshares(spark):
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate([("a", 10), ("b", 1000), ("b", 500), ("c", 3), (None, 700), ("d", 0)])]
    plan = mixing.Mix(documents(spark, rows)).plan().collect()
    target = {r["source_size"]: r["target"] for r in plan}
    assert target[10] == 30 and target[3] == 9 and abs(sum(target.values()) - 2213) < 1e-6
    assert all(r["taken"] <= 3 * r["size"] for r in plan)
    for size, t in target.items():
        assert abs(sum(r["taken"] for r in plan if r["source_size"] == size) - t) <= 1


def test_mix_counts_rows_of_one_id_as_one_place(spark, mixed):
    plan = mixing.Mix(mixed.unionByName(mixed)).plan().collect()
    assert len(plan) == 2 * len(MIXED) and all(r["taken"] <= 3 * r["size"] for r in plan)


# --- byte-level BPE


@pytest.fixture(scope="module")
def encoding():
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_matches_the_ranks(spark, mixed, empty, encoding):
    rows = [*MIXED, (200, "▁ ▁a<unk></s>\x00\x01 <|endoftext|>", None), (201, " " * 3000 + "x\n\n\t y", None), (202, "=-" * 2000 + "ééé日本語🙂", None)]
    for r in bpe.bpe_digests(documents(spark, rows)).collect():
        text = next(t for i, t, _ in rows if i == r["doc_id"]) or ""
        ids = encoding.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.bpe_digests(empty).count() == 0


def test_bpe_columns_round_trip_and_memory_is_bounded(spark, mixed, encoding, monkeypatch):
    codec = bpe.ByteBpe()
    back = mixed.select("text", codec.decode(codec.encode("text")).cast("string").alias("back")).collect()
    assert all(r["text"] == r["back"] for r in back)
    monkeypatch.setattr(bpe, "MEMORY", 3)
    small = bpe.Codec(bpe.read_ranks(__import__("public_tokenizers").path(bpe.VOCABULARY)), codec.pattern)
    texts = ["the quick brown fox", "x" * 100 + " the fox", "", "another brown fox and another"]
    assert list(small.encode_many(texts)) == [encoding.encode_ordinary(t) for t in texts] and len(small.known) <= 20


# --- I-Match


def test_imatch_edits_and_neighbours(spark, mixed, empty):
    rows = imatch.fingerprints(mixed).collect()
    assert len(rows) == len(MIXED)
    ordered = sorted(MIXED, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for k, (i, text, _) in enumerate(ordered):
        text, after = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (i, len(text), hashlib.sha256(edited.encode()).hexdigest()) in {(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows}
    assert all(0 <= r[c] <= 1 for r in rows for c in ("near_edited", "near_next"))
    assert len({r["fingerprint"] for r in rows if r["doc_id"] == 5}) == 1
    by_id = {r["doc_id"]: r["fingerprint"] for r in rows}
    assert by_id[2] == by_id[3] == by_id[4] != by_id[5]
    assert imatch.fingerprints(empty).count() == 0


def brute_imatch(texts):
    """Fingerprints of texts (all of one table, in order) and of their edited texts, as lists of numbers, from the definition."""
    import xxhash

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    longs = lambda values, seed=42: [seed := xxhash.xxh64_intdigest(int(v).to_bytes(8, "little", signed=True), seed) for v in values][-1]
    split = lambda text: {signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.findall(r"[^\W_]+", text.lower())}
    counts = {}
    for t in texts:
        for term in split(t):
            counts[term] = counts.get(term, 0) + 1
    band = {t for t, c in counts.items() if len(texts) * imatch.LEAST_SHARE <= c <= max(1, int(len(texts) * imatch.MOST_SHARE))}

    def fingerprint(text):
        found = sorted(split(text) & band)
        if not found:
            every = 1
            for t in split(text):
                every ^= signed(longs([t]))
            return [every & 0xFFFFFFFF] + [0] * (len(imatch.RATES) - 1)
        out = []
        for k, rate in enumerate(imatch.RATES):
            kept = [t for t in found if rate == 1 or signed(xxhash.xxh64_intdigest(k.to_bytes(4, "little"), longs([t]))) % rate == 0]
            out.append(longs(kept) & 0xFFFFFFFF if kept else 0)
        return out

    edited = []
    for i, t in enumerate(texts):
        half, after = len(t) // 2, texts[(i + 1) % len(texts)]
        edited.append(t[: len(t) - half] + after[:half])
    return [fingerprint(t) for t in texts], [fingerprint(t) for t in edited]


def test_imatch_fingerprints_and_likenesses_match_brute_force(spark):
    random = np.random.default_rng(11)
    texts = [" ".join(f"t{int(w)}" for w in random.zipf(1.3, int(random.integers(1, 120))) % 700) for _ in range(120)] + ["", "é—Ü ß1 _x_", "t0", "t0"]
    own, other = brute_imatch(texts)
    alike = lambda a, b: (sum(x == y != 0 for x, y in zip(a, b, strict=True)) / n) if (n := sum(x != 0 or y != 0 for x, y in zip(a, b,
        strict=True))) else 1.0
    text = lambda values: "".join(f"{v:08x}" for v in values)
    found = {r["doc_id"]: r for r in imatch.fingerprints(documents(spark, [(i, t, None) for i, t in enumerate(texts)])).collect()}
    for i in range(len(texts)):
        r = found[i]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (text(own[i]), text(other[i]))
        assert abs(r["near_edited"] - alike(own[i], other[i])) < 1e-12 and abs(r["near_next"] - alike(own[i], own[(i + 1) % len(texts)])) < 1e-12


# --- chat


RECORDS = [
    ('{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":"</s>[INST] ok [/INST]"}]}', [("user", "hi"), ("assistant",
        "</s>[INST] ok [/INST]")]),
    ('{"conversations":[{"from":"human","value":"a<|end|>b"},{"from":"gpt","value":"\\\\e<|text|>"}]}', [("user", "a<|end|>b"), ("assistant", "\\e<|text|>")]),
    ('{"instruction":"do","input":"this","output":"done"}', [("user", "do\n\nthis"), ("assistant", "done")]),
    ('{"output":"done","instruction":"do"}', [("user", "do"), ("assistant", "done")]),
    ('{"prompt":"p","completion":null}', [("user", "p"), ("assistant", "")]),
    ('{"system":"s","prompt":"p","response":"r"}', [("system", "s"), ("user", "p"), ("assistant", "r")]),
    ('{"unknown":1}', None),
    ("not json", None),
    (None, None),
]


def test_layouts_become_turns_that_read_back(spark):
    frame = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(RECORDS)], "conv_id long, record string")
    rows = chat.format_records(frame).withColumn("back", chat.read_back(F.col("formatted"))).orderBy("conv_id").collect()
    for r, (_, turns) in zip(rows, RECORDS, strict=True):
        assert (None if r["back"] is None else [tuple(t) for t in r["back"]]) == turns
        if turns:
            masked = [r["formatted"][m["start"] : m["end"]] for m in r["loss_mask"]]
            plain = [t for role, t in turns if role == "assistant"]
            assert [m.replace("\\l|", "<|").replace("\\e", "\\") for m in masked] == plain


def test_conversation_rows_with_nulls_and_ties(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (None, None, None, "x"), (2, 0, "assistant", "y" * 30_000)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    found = {r["conv_id"]: r for r in chat.digests(chat.format_records(chat.records_of(frame))).collect()}
    assert found[1]["n_turns"] == 3 and found[1]["loss_sha256"] == hashlib.sha256(b"ab").hexdigest()
    assert found[1]["turns_sha256"] == hashlib.sha256(b"user\n\nassistant\na\nassistant\nb\n").hexdigest()
    assert found[2]["loss_chars"] == 30_000 and found[None]["n_turns"] == 1
    assert chat.records_of(frame.limit(0)).count() == 0


def test_roles_of_table_rows_stay_and_those_of_other_layouts_are_renamed(spark):
    frame = spark.createDataFrame([(1, 0, "gpt", "x"), (1, 1, "assistant", "y")], "conv_id long, turn long, role string, text string")
    found = chat.digests(chat.format_records(chat.records_of(frame))).first()
    assert found["turns_sha256"] == hashlib.sha256(b"gpt\nx\nassistant\ny\n").hexdigest() and found["loss_sha256"] == hashlib.sha256(b"y").hexdigest()


def test_typed_records_of_other_layouts(spark):
    frame = spark.createDataFrame([(1, ("do", None, "done")), (2, None)], "conv_id long, record struct<instruction:string,input:string,output:string>")
    rows = {r["conv_id"]: r for r in chat.format_records(frame).withColumn("back", chat.read_back(F.col("formatted"))).collect()}
    assert [tuple(t) for t in rows[1]["back"]] == [("user", "do"), ("assistant", "done")] and rows[2]["formatted"] is None
    other = spark.createDataFrame([(1, ("a",))], "conv_id long, record struct<unknown:string>")
    assert chat.format_records(other).first()["formatted"] is None


def test_layouts_differ_by_row_and_digests_do_not(spark):
    texts = ["hi <|end|>", "", "</s>[INST] ok [/INST]", "\\e"]
    shapes = [("user", "assistant"), ("system", "user", "assistant"), ("user", "assistant", "user"), ("human", "gpt"), ("assistant",)]
    rows = [(i, t, role, texts[(i + t) % 4]) for i in range(240) for t, role in enumerate(shapes[i % 5])]
    records = chat.records_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    kind = records.schema["record"].dataType
    prints = {r[0] for r in records.select(chat.row_fingerprint(F.col("record"), kind)).distinct().collect()}
    assert prints <= {chat.type_fingerprint(json.loads(x.example)) for x in chat.LAYOUTS} and len(prints) == 6
    found = {r["conv_id"]: r for r in chat.digests(chat.format_records(records)).collect()}
    for i in range(240):
        turns = [(role, text) for c, _, role, text in rows if c == i]
        assert found[i]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert found[i]["loss_sha256"] == hashlib.sha256("".join(t for r, t in turns if r == "assistant").encode()).hexdigest()
    swapped = records.select("conv_id",
        F.struct(*[F.col(f"record.{n}").alias(n) for n in reversed(kind.names)]).alias("record"))  # an order of fields is no layout
    assert sorted(map(tuple, chat.digests(chat.format_records(swapped)).collect())) == sorted(map(tuple, found.values()))
    odd = records.select("conv_id", F.col("record").withField("turns", F.coalesce("record.turns", F.array().cast(kind["turns"].dataType))).alias("record"))
    assert chat.format_records(odd).where("formatted is null").count() == records.where("record.turns is null").count()  # fields of two layouts are no layout


def test_long_conversations_are_formatted_whole(spark):
    row = "CAST({} AS BIGINT) AS conv_id, CAST({} AS BIGINT) AS turn, '{}' AS role, repeat('{}', {}) AS text"
    frame = spark.sql("SELECT " + row.format(1, 0, "user", "<|a", 10_000_000) + " UNION ALL SELECT " + row.format(1, 1, "assistant", "b", 5))
    found = chat.digests(chat.format_records(chat.records_of(frame))).first()
    assert (found["n_turns"], found["loss_chars"], found["formatted_chars"]) == (2, 5, 40_000_000 + 5 + 13 + 2 * len("<|turn|><|text|><|end|>"))
    assert found["turns_sha256"] == hashlib.sha256(b"user\n" + b"<|a" * 10_000_000 + b"\nassistant\nbbbbb\n").hexdigest()
    many = spark.range(20_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.lit("some words").alias("text"))
    found = chat.digests(chat.format_records(chat.records_of(many))).first()
    assert found["n_turns"] == 20_000 and found["loss_sha256"] == hashlib.sha256(b"some words" * 20_000).hexdigest()


def test_json_records_too_large_to_parse_fail_loudly(spark):
    record = spark.sql("""SELECT concat('{"prompt":"', repeat('x', 25000000), '","completion":"y"}') AS record""")
    with pytest.raises(Exception, match="too large to parse"):
        chat.format_records(record).select(F.length("formatted")).collect()


# --- URL rules


def test_rules_match_brute_force(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.net", "/en/x", "block"), ("a.example.net", "", "allow"), ("org", "/fr/",
        "allow"), ("org", "/fr/", "block")]
    hosts = ["net", "example.net", "a.example.net", "b.a.example.net", "xexample.net", "org", "x.org", "", "com"]
    paths = ["", "/", "/en/", "/en/xy", "/en", "/fr/", "/fr/é\U0010ffff", "/en/x\U0010ffff"]
    urls = [f"http://{h.upper()}{p}?q#f" for h in hosts for p in paths] + ["nothing", None, "://", "x://y://z/q", "http://net/"]
    rows = [(i, u, "clash", "clash") for i, u in enumerate([*urls, *urls[:5]])] + [(None, "http://net/", "a", "b")]
    frame = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    found = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge(frame, url_rules.rule_table(spark, rules)).collect()}

    def judged(i, url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits)[:2] if fits else None
        verdict = min(v for _, r, v in fits if r == best[1]) if best else "allow"
        return i, host, path, best[1] if best else None, verdict

    assert found == {judged(i, u) for i, u, _, _ in rows}
    assert url_rules.judge(frame.limit(0), url_rules.rule_table(spark, rules)).count() == 0


def test_very_long_hosts_are_looked_up_at_few_suffixes(spark):
    long = ".".join(f"l{i}" for i in range(20_000))
    frame = spark.createDataFrame([(1, f"http://{long}.example.net/en/x"), (2, f"http://{long}/"), (3, f"http://{long}.net")], "page_id long, url string")
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_rules.judge(frame, url_rules.rule_table(spark, url_rules.RULES)).collect()}
    assert found == {1: ("example.net/en/", "allow"), 2: (None, "allow"), 3: (None, "allow")}
    deep = [(f"{long}.net", "/", "block"), ("net", "/", "allow")]
    found = {r["page_id"]: r["verdict"] for r in url_rules.judge(spark.createDataFrame([(1, f"http://x.{long}.net/a"), (2, "http://x.net/")],
        "page_id long, url string"),
        url_rules.rule_table(spark, deep), default="none").collect()}
    assert found == {1: "block", 2: "allow"}


# --- embeddings


def brute_embeddings(rows):
    usable = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 8]
    x = np.array([rows[i][1] for i in usable], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    pairs = [(usable[a], usable[b]) for a, b in zip(*np.nonzero(near), strict=True) if a != b]
    links = [sum(a == i for a, _ in pairs) for i in range(len(rows))]
    root = roots(len(rows), pairs)
    ids = [r[0] for r in rows]
    return {(ids[i], links[i], min(ids[j] for j in range(len(rows)) if root[j] == root[i])) for i in range(len(rows))}


def test_embeddings_match_brute_force(spark, monkeypatch):
    random = np.random.default_rng(5)
    centres = random.normal(size=(12, 8))
    rows = [(i, [float(np.float32(v)) for v in centres[i % 12] + random.normal(scale=0.12, size=8)]) for i in range(500)]
    rows += [(600, None), (601, [0.0] * 8), (602, [1.0] * 7 + [None]), (603, [1.0] * 7 + [float("nan")]), (604, [1.0] * 9), (605, rows[0][1]), (606,
        [x * 3 for x in rows[1][1]]), (607, [])]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, n_links int, id int")
    monkeypatch.setattr(embed_dedup, "CELL_ROWS", 40)
    monkeypatch.setattr(embed_dedup, "BLOCK_RESIDENTS", 16)
    monkeypatch.setattr(embed_dedup, "BLOCK_MEMBERS", 24)
    found = [tuple(r) for r in embed_dedup.near_duplicates(frame).collect()]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert {r[:3] for r in found} == brute_embeddings(rows) and len(found) == len(rows)
    assert all(r[3] == (r[0] == r[2]) for r in found)
    assert embed_dedup.near_duplicates(frame.limit(0)).count() == 0


@pytest.mark.parametrize("rank", [4, 8, 64])
def test_links_across_borders_in_64_dimensions(spark, monkeypatch, rank):
    random = np.random.default_rng(6)
    base = random.normal(size=(2500, rank)) @ np.linalg.qr(random.normal(size=(64, rank)))[0].T
    x = np.concatenate([base, base[:300] + random.normal(scale=0.4 * rank**0.5 / 8, size=(300, 64))])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(embed_dedup, "CELL_ROWS", 100)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    root = roots(len(x), zip(*np.nonzero(near), strict=True))
    found = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(frame).collect()}
    assert near.sum() > len(x)
    assert found == {i: (int(n) - 1, root[i]) for i, n in enumerate(near.sum(axis=1))}


def test_rows_that_share_an_id_are_told_apart(spark):
    rows = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (8, [1.0, 0.1]), (None, [0.1, 1.0]), (9, [-1.0, 0.0]), (9, [-0.95, 0.31]), (9, [-0.95, 0.31])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, weight int")
    found = sorted(((r.vec_id, r.n_links, r.component_id) for r in embed_dedup.near_duplicates(frame).collect()), key=str)
    assert found == sorted([(5, 1, 5), (5, 1, 5), (8, 1, 5), (None, 1, 5), (9, 2, 9), (9, 2, 9), (9, 2, 9)], key=str)


# --- shards


def test_plan_merges_by_tiers():
    shards = [sharding.Shard(f"s{i:02d}", size) for i, size in enumerate([10] * 9 + [40] * 3 + [200])]
    groups = sharding.plan_merges(shards, target=160, fanout=4)
    merged = [sum(s.bytes for s in g) for g in groups]
    assert sorted(merged) == [40, 160] or all(m >= 40 for m in merged)
    assert all(s.bytes < 160 for g in groups for s in g)
    assert sharding.plan_merges(shards[:3], 160, 4) == []


def test_store_versions_conflicts_and_reads(spark, mixed, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store")
    assert store.read() is None and store.compact() is None
    for k in range(4):
        store.append(mixed.withColumn("arrival", F.lit(k)), "arrival")
    assert store.versions() == [1, 2, 3, 4]
    with pytest.raises(sharding.Conflict):
        store.commit(3, [], mixed.schema)
    before = store.read().count()
    version = store.compact(target=1 << 20)
    assert version == 5 and len(store.manifest()[1]) == 1 and store.manifest()[1][0].arrivals == 4
    assert store.read().count() == before == 4 * len(MIXED) and store.read(2).count() == 2 * len(MIXED)
    assert store.vacuum() == 4 and store.read().count() == before
    json.loads((tmp_path / "store/manifests/000000000005.json").read_text())


def test_columns_of_some_arrivals_are_kept(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store")
    for k in range(4):
        rows = spark.range(3).withColumn("arrival", F.lit(k))
        store.append(rows.withColumn("late", F.concat(F.lit("v"), "id")) if k == 2 else rows, "arrival")
    expected = sorted((i, k, f"v{i}" if k == 2 else None) for i in range(3) for k in range(4))
    values = lambda: sorted(((r["id"], r["arrival"], r["late"]) for r in store.read().collect()), key=lambda r: r[:2])
    assert values() == expected
    store.compact(target=1 << 20)
    assert store.vacuum() == 4 and len(store.manifest()[1]) == 1 and values() == expected
    files = lambda: sorted(str(f) for f in (tmp_path / "store/data").rglob("*.parquet"))
    before = files()
    with pytest.raises(ValueError, match="late"):
        store.append(spark.range(1).withColumn("arrival", F.lit(9)).withColumn("late", F.lit(1)), "arrival")
    with pytest.raises(RuntimeError, match="gone"):
        store._update(lambda shards, schema: (_ for _ in ()).throw(RuntimeError("gone")), [])
    assert files() == before and values() == expected


def test_a_failed_commit_is_no_conflict_and_leaves_no_files(spark, mixed, tmp_path, monkeypatch):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store")

    def fail(*_):
        raise OSError("no space")

    monkeypatch.setattr(store, "commit", fail)
    with pytest.raises(OSError, match="no space"):
        store.append(mixed.withColumn("arrival", F.lit(0)), "arrival")
    assert not list((tmp_path / "store").rglob("*.parquet"))


def test_arrivals_of_any_size_end_in_files_near_the_target(spark, tmp_path):
    store, target = sharding.ShardStore(spark, f"file://{tmp_path}/store"), 200_000
    for k in range(4):
        rows = spark.range(5_000, numPartitions=24).select((F.col("id") + 5_000 * k).alias("id"), F.lit(k).alias("arrival"), F.sha2(F.col("id").cast("string"),
            512).alias("text"))
        store.append(rows.repartition(24), "arrival")
    sizes = lambda: [size for s in store.manifest()[1] for _, size in s.files]
    assert len(sizes()) == 96 and max(sizes()) < target / 4
    while store.compact(target):
        store.vacuum()
    assert all(target / 2 <= n <= 1.5 * target for n in sizes()) and len(sizes()) < 24
    assert sorted(r["id"] for r in store.read().collect()) == list(range(20_000))
    on_disk = [f.stat().st_size for f in (tmp_path / "store/data").rglob("*.parquet")]
    assert sorted(on_disk) == sorted(sizes())  # nothing else is left
    small = 40_000  # now every file is too large
    while store.compact(small):
        store.vacuum()
    assert all(n <= 1.5 * small for n in sizes()) and store.read().count() == 20_000 and store.compact(small) is None


def test_bins_are_near_the_target():
    draw = np.random.default_rng(1)
    for _ in range(50):
        files = [(str(i), int(n)) for i, n in enumerate(draw.integers(1, 150, draw.integers(1, 40)))]
        out = [sum(n for _, n in b) for b in sharding.bins(files, 100)]
        assert sorted(f for b in sharding.bins(files, 100) for f in b) == sorted(files)
        assert max(out) <= 150 and sum(n < 50 for n in out) <= 1


def test_columns_that_differ_in_case_only_are_refused(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store")
    rows = spark.range(3).select("id", F.lit("a").alias("text"), F.lit(0).alias("arrival"))
    store.append(rows, "arrival")
    with pytest.raises(ValueError, match="case"):
        store.append(rows.withColumnRenamed("text", "Text"), "arrival")
    assert store.versions() == [1] and store.read().count() == 3
    assert len(list((tmp_path / "store/data").iterdir())) == 1


def test_sharded_documents(spark, mixed, empty, tmp_path):
    rows = sharding.shard_documents(mixed, f"file://{tmp_path}/a", arrivals=3, target=1 << 20).collect()
    want = sorted((i is not None, i or 0, (i or 0) % 3, len((t or "").encode()), None if t is None else hashlib.sha256(t.encode()).hexdigest()) for i, t,
        _ in MIXED)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["arrival"], r["n_bytes"], r["text_sha256"]) for r in rows) == want
    assert sharding.shard_documents(empty, f"file://{tmp_path}/b").count() == 0
