"""SimHash near-duplicates: fingerprints, Golay-code fuzzy keys, verified links and their components.

A 64-bit fingerprint is cut into four segments of 16 bits. Of two fingerprints that differ in three bits at
most, one segment has no error, and of any two of the other three at least one has one error at most. A key
is therefore an error-free segment followed by the Golay codeword index of another segment. The binary Golay
code (23, 12) is perfect: every word is within three bits of exactly one codeword. One side of the join
carries the index of its own nearest codeword, the other the indices of all its neighbours at one bit's
distance (one to six of them), so that words at distance one always meet. Key matches are then verified.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brickwise.llm.embed_dedup import joined_labels
from brickwise.operators.components import connected_components
from brickwise.runtime import broadcast_if_small, discard, materialize, merged_if_large

SEED = 42
#: Generator polynomial of the binary Golay code, fixed value: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY_GENERATOR = 0xC75
#: (error-free segment, segment with one error at most), in the order in which a pair is claimed.
COMBINATIONS = [(i, (i + d) % 4) for i in range(4) for d in (1, 2)]
MAX_DISTANCE = 3


def fingerprint_bytes(text: bytes, words: int = 3) -> int:
    """Signed 64-bit SimHash of the word shingles of a text; 0 without words."""
    tokens = text.lower().split()  # of bytes: A-Z only, and white space of ASCII only
    if not tokens:
        return 0
    if len(tokens) <= words:
        shingles = [b" ".join(tokens)]
    else:
        joined, ends, at = b" ".join(tokens), [], -1
        for t in tokens:
            at += len(t) + 1
            ends.append(at)
        starts = [0, *[e + 1 for e in ends[: len(tokens) - words]]]
        shingles = [joined[s:e] for s, e in zip(starts, ends[words - 1 :], strict=True)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), dtype=np.uint64, count=len(shingles))
    return _majority(hashes)


def _majority(hashes: np.ndarray) -> int:
    """The signed 64-bit number whose bits are set in over half of the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for part in np.array_split(hashes, len(hashes) // 65536 + 1):
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: Column | str, words: int = 3) -> Column:
    """Column of :func:`fingerprint_bytes`; null counts as empty."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array((fingerprint_bytes(x.as_py() or b"", words) for x in texts.cast(pa.large_binary())), pa.int64(), size=len(texts))

    return of(text)


def as_hex(fp: Column | str) -> Column:
    """A signed fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each 16-bit word: the index of its nearest codeword, and the distinct indices of all words within one bit (-1 fills up)."""

    def syndrome(word: np.ndarray) -> np.ndarray:
        word = word.copy()
        for bit in range(22, 10, -1):
            word = np.where(word >> bit & 1, word ^ (GOLAY_GENERATOR << (bit - 11)), word)
        return word

    units = [1 << i for i in range(23)]
    errors = [0, *units, *(a | b for i, a in enumerate(units) for b in units[:i])]
    errors += [a | b | c for i, a in enumerate(units) for j, b in enumerate(units[:i]) for c in units[:j]]
    errors = np.array(errors)
    leader = np.zeros(2048, dtype=np.int64)
    leader[syndrome(errors)] = errors
    words = np.arange(65536)
    padded = words << 7  # the segment takes the code's upper bits, zeros the rest
    nearest = (padded ^ leader[syndrome(padded)]) >> 11
    around = np.sort(np.stack([nearest, *(nearest[words ^ (1 << i)] for i in range(16))], axis=1), axis=1)
    around[:, 1:][around[:, 1:] == around[:, :-1]] = -1
    around = -np.sort(-around, axis=1)
    return nearest, around[:, : int((around >= 0).sum(axis=1).max())]


def _keys(fingerprints: DataFrame, probe: bool) -> DataFrame:
    """(key, fp) of distinct fingerprints; several keys for the probing side."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest, around = golay_tables()
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            segments = [fp.view(np.uint64) >> np.uint64(16 * i) & np.uint64(0xFFFF) for i in range(4)]
            for c, (i, j) in enumerate(COMBINATIONS):
                head = (c << 28) | (segments[i].astype(np.int64) << 12)
                if probe:
                    codes = around[segments[j].astype(np.int64)]
                    row, column = np.nonzero(codes >= 0)
                    key, out = head[row] | codes[row, column], fp[row]
                else:
                    key, out = head | nearest[segments[j].astype(np.int64)], fp
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(out)], ["key", "fp"])

    return fingerprints.select("fp").mapInArrow(of, "key long, fp long")


#: Fingerprints under a key that the join compares with each probe; keys of more are compared in blocks of BLOCK_ROWS by BLOCK_ROWS.
FEW, BLOCK_ROWS, TILE_ROWS = 64, 8192, 512


def _block_stars(block: pa.Table) -> pa.Table:
    """(a, b): a star for all that links of MAX_DISTANCE bits between the two sides of one block connect, never all pairs."""
    fp, side = block.column("fp").to_numpy(), block.column("side").to_numpy()
    left, right = np.unique(fp[side == 0]), np.unique(fp[side == 1])
    nodes = np.union1d(left, right)
    labels = np.arange(len(nodes))
    left_node, right_node = np.searchsorted(nodes, left), np.searchsorted(nodes, right)
    for i in range(0, len(left), TILE_ROWS):
        differing = np.bitwise_count(left[i : i + TILE_ROWS, None].view(np.uint64) ^ right[None, :].view(np.uint64))
        p, q = np.nonzero(differing <= MAX_DISTANCE)
        labels = joined_labels(labels, left_node[p + i], right_node[q])
    moved = np.nonzero(labels != np.arange(len(nodes)))[0]
    return pa.table({"a": nodes[labels[moved]], "b": nodes[moved]})


def near_links(fingerprints: DataFrame) -> DataFrame:
    """(a, b): links of the distinct fingerprints in column ``fp`` whose components are those of all pairs at 1 to 3 differing bits.

    Under a key of a few fingerprints the join emits the pairs, FEW for a probe at most. Crowded keys are dealt out in
    blocks of bounded size, each of which gives stars. So links grow with the fingerprints, also in a ball of many near ones.
    """
    index = _keys(fingerprints, probe=False)
    probe = _keys(fingerprints, probe=True)
    crowded = materialize(index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FEW), "crowded-keys")
    known = broadcast_if_small(crowded.select("key"))
    # one pass over the probes: a crowded key stands in the index once, without a fingerprint, and tells which probes ask for it
    asking = index.join(known, "key", "left_anti").withColumnRenamed("fp", "a").unionByName(crowded.select("key", F.lit(None).cast("long").alias("a")))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.expr("a ^ b")) <= MAX_DISTANCE)
    # Spark takes either side for as large as the fingerprints, not for so many keys each; a broadcast of them wouldn't fit the driver
    met = asking.join(probe.withColumnRenamed("fp", "b").hint("merge"), "key").where(F.col("a").isNull() | near)
    met = materialize(met, "met-keys")
    few = met.where("a is not null").select("a", "b")
    asked = met.where("a is null").select("key", F.col("b").alias("fp"))
    chunks = lambda n: F.ceil(n / BLOCK_ROWS).cast("int")
    probes = asked.groupBy("key").agg(F.count(F.lit(1)).alias("probes"))
    split = materialize(crowded.join(probes, "key").select("key", chunks(F.col("n")).alias("rows_n"), chunks(F.col("probes")).alias("columns_n")), "key-blocks")
    split = broadcast_if_small(split)
    number = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = index.join(split, "key").select("key", "fp", F.lit(0).alias("side"), number("rows_n").alias("i"), upto("columns_n").alias("j"))
    columns = asked.join(split, "key").select("key", "fp", F.lit(1).alias("side"), upto("rows_n").alias("i"), number("columns_n").alias("j"))
    stars = rows.unionByName(columns).groupBy("key", "i", "j").applyInArrow(_block_stars, "a long, b long")
    return few.unionByName(stars)


def group_by_fingerprint(rows: DataFrame, id_col: str = "doc_id", fp_col: str = "fp") -> DataFrame:
    """``rows`` (id, fp) with ``component_id``: the smallest id that links of 3 bits at most can reach.

    Copies (equal fingerprints) are one node, whatever their number: groups of copies are never expanded.
    """
    nodes = materialize(rows.groupBy(F.col(fp_col).alias("fp")).agg(F.min(id_col).alias("low")), "fingerprints")
    roots = connected_components(near_links(nodes))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(nodes["fp"], "low", F.coalesce("root", "fp").alias("root"))
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    named = placed.join(lowest, "root").select(F.col("fp").alias("_bw_fp"), "component_id")
    return rows.join(named, rows[fp_col] == named["_bw_fp"]).select(rows[id_col], rows[fp_col], "component_id")


def simhash_components(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fingerprint, component_id) for every row of ``documents``.

    Nulls: a null text counts as empty (fingerprint zero, linked like any other); a row with a null id
    keeps its row and never names a component unless its whole component has no id (then null).
    Repeated ids and repeated rows give one row each. An empty table gives no rows. Other columns are ignored.
    """
    rows = documents.select(F.col(id_col), fingerprint(text_col, words).alias("fp"))
    grouped = group_by_fingerprint(materialize(rows, "simhash"), id_col)
    return grouped.select(id_col, as_hex("fp").alias("fingerprint"), "component_id")


@dataclass(frozen=True)
class NearCopies:
    """When two texts are near copies: they share ``similarity`` of their distinct ``words``-word shingles (Jaccard).

    Candidates have a guarantee: put the n shingles of each text in one order that is the same for all texts. Two texts of the similarity
    share one of their first n - ceil(similarity n) + 1, and what follows the first one they share is long enough on either side.
    Any order is right; rare shingles first makes it fast. So shingles that a sample of about ``sampled`` rows repeats come last, by their
    counts there, ``listed`` of them at most.
    """

    words: int = 5
    similarity: float = 0.8
    sampled: int = 20_000
    listed: int = 200_000

    def prefix(self, n: int) -> int:
        return n - math.ceil(self.similarity * n - 1e-9) + 1 if n else 0

    def fits(self, na: Column, ia: Column, nb: Column, ib: Column) -> Column:
        """Whether sizes ``na``, ``nb`` allow the similarity if the first common shingles are at places ``ia``, ``ib``."""
        sizes = F.least(na, nb) >= self.similarity * F.greatest(na, nb) - 1e-6
        return sizes & (F.least(na - ia, nb - ib) >= self.similarity / (1 + self.similarity) * (na + nb) - 1e-6)


#: Shingles for each count of a signature, about.
SHARE_OF_COUNT = 4
#: Members of a bucket that meet the whole bucket in one task.
CHUNK = 256
#: Ids that the driver broadcasts where the other side holds texts or buckets: some 50 MB there.
MOST_IDS = 500_000


def _shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """Hashes of the distinct word shingles of a text, sorted."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    count = max(1, len(tokens) - words + 1)
    last = ends[words - 1 :] if len(tokens) >= words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[:count].tolist(), last.tolist(), strict=True)), dtype=np.uint64,
        count=count))


def signature(hashes: np.ndarray) -> bytes:
    """How many distinct hashes end in each number, a byte each, for a power of two of numbers; empty (nothing is told) if a count doesn't fit a byte."""
    size = 1 << max(0, (len(hashes) // SHARE_OF_COUNT).bit_length() - 1)
    counts = np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def may_share(a: bytes, b: bytes, similarity: float) -> bool:
    """Whether two sets of these signatures can have the similarity: they share no more than the lesser count of every ending."""
    if not a or not b:
        return True
    short, long = sorted((np.frombuffer(x, dtype=np.uint8).astype(np.int64) for x in (a, b)), key=len)
    common = int(np.minimum(short, long.reshape(-1, len(short)).sum(axis=0)).sum())
    return common >= similarity * (int(short.sum()) + int(long.sum()) - common)


def sketch_bytes(text: bytes, rule: NearCopies, common: np.ndarray, counts: np.ndarray) -> tuple[int, int, int, np.ndarray, bytes]:
    """(digest, number and fingerprint of the distinct shingles, those that come first, their signature) of a text; ``common`` are the sorted hashes that come
    last, by ``counts``."""
    hashes = _shingle_hashes(text, rule.words)
    if not len(hashes):
        return 0, 0, 0, hashes.view(np.int64), b""
    content = xxhash.xxh64_intdigest(hashes.tobytes(), SEED)
    often = np.zeros(len(hashes), dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        often = np.where(common[at] == hashes, counts[at], 0)
    first = hashes[np.argsort(often, kind="stable")][: rule.prefix(len(hashes))]
    return content - (1 << 63), len(hashes), _majority(hashes), first.view(np.int64), signature(hashes)


def near_copy_groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: NearCopies | None = None) -> DataFrame:
    """(id, root): every id that isn't the smallest of its group of copies and near copies, with that smallest id.

    Copies have the same shingles (A-Z in either case, whatever the white space). Texts whose fingerprints differ in ``MAX_DISTANCE`` bits at
    most meet first, found by their Golay keys. Near copies of more bits are found by buckets; a bucket holds the texts with one shingle among their first.
    There each text first meets the text that shares most of its own first shingles, the one with the smallest id, and its neighbour by size; then
    all texts of a bucket that aren't grouped yet meet, in chunks. So a bucket of one group costs as much as it has rows, and no pair is missed.
    Texts without words are copies of each other. Null ids are ignored; an id with several texts is linked if one of them is.
    """
    rule = rule or NearCopies()

    @F.arrow_udf("array<long>")
    def shingles(texts: pa.Array) -> pa.Array:
        return pa.array([_shingle_hashes(x.as_py() or b"", rule.words).view(np.int64) for x in texts.cast(pa.large_binary())], pa.list_(pa.int64()))

    known = documents.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    every = max(1, math.ceil(known.count() / rule.sampled))
    drawn = known.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select(F.explode(shingles("text")).alias("p"))
    top = drawn.groupBy("p").agg(F.count(F.lit(1)).alias("c")).where("c > 2").orderBy(F.desc("c"), "p").limit(rule.listed).toArrow()
    common, counts = (top.column(k).to_numpy().astype(np.int64) for k in ("p", "c"))
    sort = np.argsort(common.view(np.uint64))
    common, counts = common.view(np.uint64)[sort], counts[sort]

    @F.arrow_udf("content long, n int, fp long, first array<long>, sig binary")
    def sketch(texts: pa.Array) -> pa.Array:
        rows = [sketch_bytes(x.as_py() or b"", rule, common, counts) for x in texts.cast(pa.large_binary())]
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()),
            pa.binary()))]
        return pa.StructArray.from_arrays(columns, ["content", "n", "fp", "first", "sig"])

    @F.arrow_udf("boolean")
    def possible(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array((may_share(x.as_py(), y.as_py(), rule.similarity) for x, y in zip(a, b, strict=True)), pa.bool_(), size=len(a))

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` whose whole sets of shingles have the similarity.

        A set goes through two shuffles for each pair, and pairs grow faster than texts. Signatures, a byte for some four shingles, leave out most before.
        """
        signs = lambda end: rows.select(F.col("id").alias(end), F.col("sig").alias(f"g{end}")).hint("merge")
        likely = pairs.join(signs("a"), "a").join(signs("b"), "b").where(possible("ga", "gb")).select("a", "b").distinct()
        likely = materialize(likely, "likely-copies")
        involved = materialize(likely.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "involved")
        sets = materialize(known.join(broadcast_if_small(involved, MOST_IDS), "id", "left_semi").select("id", shingles("text").alias("s")), "shingle-sets")
        # sets that share most shingles fit few MB of Parquet, whatever they take in a broadcast
        sets_of = lambda end: sets.select(F.col("id").alias(end), F.col("s").alias(f"s{end}")).hint("merge")
        both = likely.join(sets_of("a"), "a").join(sets_of("b"), "b")
        common = F.size(F.array_intersect("sa", "sb"))
        found = materialize(both.where(common >= rule.similarity * (F.size("sa") + F.size("sb") - common)).select("a", "b"), "near-copies")
        discard(likely, involved, sets)
        return found

    sketches = materialize(known.select("id", sketch("text").alias("s")).select("id", "s.*"), "sketches")
    same = ["content", "n"]
    texts = materialize(sketches.groupBy(*same).agg(F.min("id").alias("node"), F.first("fp").alias("fp"), F.first("first").alias("first")), "texts")
    rows = materialize(sketches.select("id", "sig", *same), "rows")
    nodes = materialize(texts.select("node", "fp", *same), "nodes")
    discard(sketches)
    # by fingerprint: copies of one with the lowest of them, and these with each other
    prints = materialize(nodes.groupBy("fp").agg(F.min("node").alias("low")), "fingerprints")
    lows = merged_if_large(prints)
    equal = nodes.join(lows, "fp").where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b"))
    named = lambda end: lows.select(F.col("fp").alias(end), F.col("low").alias(f"{end}_low"))
    ends = near_links(prints).join(named("a"), "a").join(named("b"), "b")
    by_print = equal.unionByName(ends.select(F.least("a_low", "b_low").alias("a"), F.greatest("a_low", "b_low").alias("b")))
    spread = texts.select("node", "n", F.size("first").alias("k"), F.posexplode("first").alias("i", "p"))
    often = spread.groupBy("p").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("p")
    shared = spread.join(often.hint("merge"), "p").withColumn("share", F.count(F.lit(1)).over(Window.partitionBy("node")) / F.col("k"))
    buckets = materialize(shared.select("p", "node", "n", "i", "share"), "buckets")
    discard(texts)
    # each text with a few of its bucket
    member = F.struct("node", "n", "i")
    hubs = buckets.groupBy("p").agg(F.max_by(member, F.struct("share", -F.col("node"))).alias("central"), F.min(member).alias("lowest"))
    starred = merged_if_large(buckets).join(hubs, "p").select("node", "n", "i", F.explode(F.array("central", "lowest")).alias("other"))
    beside = F.lag(member).over(Window.partitionBy("p").orderBy("n", "node"))
    chained = buckets.select("node", "n", "i", beside.alias("other")).where("other is not null")
    met = starred.unionByName(chained).where(F.col("node") != F.col("other.node")).where(rule.fits(F.col("n"), F.col("i"), F.col("other.n"), F.col("other.i")))
    met = met.select(F.least("node", "other.node").alias("a"), F.greatest("node", "other.node").alias("b"))
    pairs = materialize(met.unionByName(by_print).distinct(), "candidates")
    roots = materialize(connected_components(verified(pairs)), "roots")
    # whatever isn't of the largest group of its bucket with the rest of the bucket
    grouped = buckets.select("p", "node", "n", "i").join(broadcast_if_small(roots, MOST_IDS), "node", "left").withColumn("root", F.coalesce("root", "node"))
    grouped = materialize(grouped, "grouped")
    discard(buckets)
    sizes = grouped.groupBy("p", "root").agg(F.count(F.lit(1)).alias("c"))
    split = sizes.groupBy("p").agg(F.max_by("root", F.struct("c", "root")).alias("major"),
        F.ceil((F.sum("c") - F.max("c")) / CHUNK).cast("int").alias("chunks")).where("chunks > 0")
    mixed = materialize(merged_if_large(grouped).join(split, "p"), "mixed")
    discard(grouped)
    left = mixed.where("root <> major").select("p", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"),
        *[F.col(c).alias(f"l{c}") for c in ("node", "n", "i", "root")])
    right = mixed.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    apart = (F.col("lroot") != F.col("root")) & ((F.col("root") == F.col("major")) | (F.col("lnode") < F.col("node")))
    rest = left.join(right.hint("merge"), ["p", "chunk"]).where(apart & rule.fits(F.col("ln"), F.col("li"), F.col("n"), F.col("i")))
    rest = rest.select(F.least("lnode", "node").alias("a"), F.greatest("lnode", "node").alias("b")).distinct().join(merged_if_large(pairs), ["a", "b"], "left_anti")
    more = verified(materialize(rest, "other-candidates"))
    roots = connected_components(materialize(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(more), "all-near-copies"))
    placed = merged_if_large(nodes).join(roots.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select(*same, F.coalesce("root", "node").alias("root"))
    return merged_if_large(rows.select("id", *same)).join(placed, same).where("id <> root").select("id", "root").distinct()


def keep_one_of_each_group(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: NearCopies | None = None) -> DataFrame:
    """``documents`` without copies and near copies: of each group the row with the smallest id stays, one row of each such id.

    Rows with a null id stay. All columns stay.
    """
    gone = materialize(near_copy_groups(documents, id_col, text_col, rule).select(F.col("id").alias("_bw_id")).distinct(), "gone")
    rest = documents.join(broadcast_if_small(gone, MOST_IDS), documents[id_col] == gone["_bw_id"], "left_anti")
    again = materialize(documents.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_bw_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_bw_id"), "repeated")
    few = broadcast_if_small(again, MOST_IDS)
    once = rest.join(few, rest[id_col] == few["_bw_id"], "left_anti")
    return once.unionByName(rest.join(few, rest[id_col] == few["_bw_id"], "left_semi").dropDuplicates([id_col]))
