"""I-Match document fingerprints over randomised lexicons.

The lexicon holds the terms whose inverse document frequency lies in a band. Each subset of the lexicon keeps a
term by a hash of the term and the subset's number; a document's distinct terms in a subset are sorted and
hashed. The subsets' sampling rates span short to long documents. Two fingerprints are as alike as the share of subsets,
of those in which either has a term, that give equal hashes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brickwise.functions.arrays import let
from brickwise.runtime import materialize

#: Terms that are in a share of the documents within these bounds; at most terms-per-document / LEAST_SHARE terms have
#: the lower one, whatever the number of documents, which bounds the lexicon.
LEAST_SHARE, MOST_SHARE = 0.001, 0.1
#: Of every so many terms one is kept, for each subset.
RATES = (1, 8, *[32] * 4, *[64] * 8, *[128] * 8, *[256] * 8, *[512] * 8, *[1024] * 10)
#: A lexicon of more terms than this is joined by a shuffle instead of a broadcast.
BROADCAST_TERMS = 1_000_000


def terms(text: Column) -> Column:
    """Distinct lower-cased runs of letters and digits, as 64-bit hashes."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), "")
    return F.transform(F.array_distinct(words), lambda t: F.xxhash64(t))


def subset_mask(term: Column) -> Column:
    """A bit for each subset of the lexicon that keeps a term."""
    kept = [F.when(F.pmod(F.xxhash64(term, F.lit(k)), F.lit(rate)) == 0, F.lit(1 << k)).otherwise(F.lit(0)) for k, rate in enumerate(RATES) if rate > 1]
    return reduce(lambda a, b: a.bitwiseOR(b), kept, F.lit(1).cast("long"))


def lexicon(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, mask): hashes of the terms in the band, with their subsets. In a small table a term of one document is always in it."""
    rows = texts.select(F.explode(terms(F.coalesce(F.col(text_col), F.lit("")))).alias("term"))
    counts = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = texts.count()
    return counts.where((F.col("df") >= n * LEAST_SHARE) & (F.col("df") <= max(1, int(n * MOST_SHARE)))).select("term",
        subset_mask(F.col("term")).alias("mask"))


def subset_hashes(found: Column, fallback: Column) -> Column:
    """Array with one hash for each subset of a sorted array of (term, mask), 0 where it keeps none; only the fallback's without terms."""
    digest = lambda kept: let(kept, lambda a: F.when(F.size(a) == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(a).bitwiseAND(F.lit(0xFFFFFFFF))))
    among = lambda terms, subsets: F.filter(terms, lambda x: x["mask"].bitwiseAND(F.lit(sum(1 << k for k in subsets))) != 0)
    of_rate = {r: [k for k, rate in enumerate(RATES) if rate == r] for r in RATES if r > 1}
    # subsets of one rate are looked for among the terms that are in any of them, and these among those that are in any subset
    some = F.struct(found.alias("all"), among(found, [k for ks in of_rate.values() for k in ks]).alias("some"))
    by_rate = lambda s: F.struct(s["all"].alias("r1"), *[among(s["some"], ks).alias(f"r{r}") for r, ks in of_rate.items()])
    kept = lambda s, k: s["r1"] if RATES[k] == 1 else among(s[f"r{RATES[k]}"], [k]) if len(of_rate[RATES[k]]) > 1 else s[f"r{RATES[k]}"]
    terms_of = lambda s, k: F.transform(kept(s, k), lambda x: x["term"])
    none = F.array(fallback.bitwiseAND(F.lit(0xFFFFFFFF)), *[F.lit(0).cast("long")] * (len(RATES) - 1))
    whole = let(some, lambda s: let(by_rate(s), lambda q: F.array(*[digest(terms_of(q, k)) for k in range(len(RATES))])))
    return F.when(F.size(found) == 0, none).otherwise(whole)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets in which either has a term; 1 if neither has any."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    either = F.size(F.filter(pairs, lambda p: (p["a"] != 0) | (p["b"] != 0)))
    equal = F.size(F.filter(pairs, lambda p: (p["a"] != 0) & (p["a"] == p["b"])))
    return F.when(either == 0, 1.0).otherwise(equal / either)


def as_text(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.lpad(F.hex(h), 8, "0"))), "")


def in_ranges(documents: DataFrame, id_col: str, ranges: int) -> DataFrame:
    """``documents`` with ``_bw_range``, ascending with the id, and copies of each range's first rows (``_bw_copy`` 1) at the
    end of the range before, of the very first ones (``_bw_copy`` 2) at the end of the last range. Null ids come first."""
    known = documents.agg(F.percentile_approx(id_col, [i / ranges for i in range(ranges)], 20 * ranges).alias("cuts"), F.min(id_col).alias("low"),
        F.count(F.when(F.col(id_col).isNull(), 1)).alias("nulls")).first()
    cuts = sorted({known["low"], *(known["cuts"] or [])} - {None}) or [0]
    step = max(1, int(len(cuts) ** 0.5))
    up_to = lambda values: F.size(F.filter(values, lambda c: c <= F.col(id_col)))
    coarse = up_to(F.array(*map(F.lit, cuts[::step])))
    fine = up_to(F.slice(F.array(*map(F.lit, cuts)), (coarse - 1) * step + 1, F.lit(step)))
    number = F.when(F.col(id_col).isNull(), 0).otherwise((coarse - 1) * step + fine - 1)
    first = F.get(F.array(*map(F.lit, cuts)), F.col("_bw_range")) == F.col(id_col)
    lowest = F.col(id_col).isNull() if known["nulls"] else F.coalesce(F.col(id_col) == F.lit(cuts[0]), F.lit(False))
    place = lambda number, copy: F.struct(number.cast("int").alias("_bw_range"), F.lit(copy).alias("_bw_copy"))
    own, here = place(F.col("_bw_range"), 0), F.col("_bw_range")
    places = F.concat(F.array(own), F.when(first & (here > 0), F.array(place(here - 1,
        1))).otherwise(F.array().cast("array<struct<_bw_range:int,_bw_copy:int>>")), F.when(lowest, F.array(place(F.lit(len(cuts) - 1),
            2))).otherwise(F.array().cast("array<struct<_bw_range:int,_bw_copy:int>>")))
    dealt = documents.withColumn("_bw_range", number).withColumn("_bw_place", F.explode(places)).drop("_bw_range")
    return dealt.select("*", "_bw_place.*").drop("_bw_place")


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_chars, fingerprint, and the edited text's digest and fingerprint with the likenesses.

    The edited text has the second half (rounded down) replaced by as many first characters of the next document, by ascending id; after the last
    comes the first. Null texts count as empty; null ids come first; rows that share an id are ordered by their texts. A
    text without terms in the band is fingerprinted by the set of all its terms. An empty table gives no rows; other columns
    are ignored.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    words = materialize(lexicon(docs), "lexicon")
    size = words.count()
    words = F.broadcast(words) if size <= BROADCAST_TERMS else words
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = Window.partitionBy("_bw_range").orderBy(F.col("_bw_copy") == 2, F.col("id").asc_nulls_first(), "text", "_bw_copy")
    lined = in_ranges(docs, "id", 4 * n).select("*", F.row_number().over(ordered).alias("place"), F.coalesce(F.lead("text").over(ordered),
        F.lit("")).alias("next"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next"), F.lit(1), half))
    both = lined.select("_bw_range", "_bw_copy", "place", "id", F.length("text").cast("long").alias("n_chars"), "text", edited.alias("edited"))
    # the first element of a row carries its facts, the others one term each, of the text or of the edited text; terms out of the band
    # count for the set of all terms only, which is hashed in the row
    every = lambda found: F.aggregate(found, F.lit(1).cast("long"), lambda acc, t: acc.bitwiseXOR(F.xxhash64(t)))
    kind = "struct<id:bigint,n_chars:bigint,edited_sha256:string,_bw_copy:int,all0:bigint,all1:bigint>"

    def items(s: Column) -> Column:
        facts = F.struct("id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "_bw_copy", every(s["t0"]).alias("all0"),
            every(s["t1"]).alias("all1"))
        item = lambda of, term, fact: F.struct(F.lit(of).alias("of"), term.alias("term"), fact.alias("facts"))
        listed = lambda v: F.transform(s[f"t{v}"], lambda t: item(v, t, F.lit(None).cast(kind)))
        return F.concat(F.array(item(0, F.lit(None).cast("long"), facts.cast(kind))), listed(0), listed(1))

    both = both.withColumn("items", let(F.struct(terms(F.col("text")).alias("t0"), terms(F.col("edited")).alias("t1")), items))
    spread = both.select("_bw_range", "place", F.explode("items").alias("item")).select("_bw_range", "place", "item.*")
    marked = spread.join(words.withColumnRenamed("term", "known"), F.col("term") == F.col("known"), "left").where("known is not null or facts is not null")
    # terms are distinct within a text, so that a list of them is a set
    per = lambda v: F.array_sort(F.collect_list(F.when((F.col("of") == v) & F.col("known").isNotNull(), F.struct(F.col("known").alias("term"),
        "mask")))).alias(f"found{v}")
    grouped = marked.groupBy("_bw_range", "place").agg(F.first("facts", ignorenulls=True).alias("facts"), per(0), per(1))
    hashed = grouped.select("_bw_range", "place", "facts.*", subset_hashes(F.col("found0"), F.col("facts.all0")).alias("own"), subset_hashes(F.col("found1"),
        F.col("facts.all1")).alias("other"))
    after = Window.partitionBy("_bw_range").orderBy("place")
    led = hashed.withColumn("next", F.lead("own").over(after)).where("_bw_copy = 0")
    return led.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
