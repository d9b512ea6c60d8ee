"""Mixing sources to target weights: hash-random order, running sums of sizes, and a cut at each source's budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickwise.operators.prefix import running_sums
from brickwise.runtime import materialize

SPACE = "\\x20\\x09-\\x0D"
SALT = ":mix"
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3


def word_count(text: Column | str) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def _keyed(documents: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    """The id, the source as a pair without nulls that sorts nulls last, the hash-random key and the size."""
    key = F.substring(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(SALT)).cast("binary")), 1, 16).alias("_bw_key")
    return [F.col(id_col).alias("_bw_id"), F.col(source_col).isNull().alias("_bw_none"), F.coalesce(source_col, F.lit("")).alias("_bw_source"), key,
        word_count(text_col).alias("_bw_size")]


def source_targets(sizes: DataFrame, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """One row per source: its size, and its target in words.

    The weights repeat over the sources by code point, null last. Targets share the size of all sources by weight; none exceeds
    ``max_epochs`` times its source's size, and what they leave goes to the others by weight: source i is full if its limit is
    below the common level, and the level is found where the sources, by limit over weight, stop being full.
    """
    sources = materialize(sizes.groupBy("_bw_none", "_bw_source").agg(F.sum("_bw_size").alias("source_size")).withColumn("_bw_one", F.lit(1).cast("long")),
        "sources")
    ranked = running_sums(sources, ["_bw_none", "_bw_source"], {"_bw_one": "_bw_rank"}, "source-ranks")
    cycle = F.array(*[F.lit(int(w)).cast("long") for w in weights])
    weighed = ranked.select("_bw_none", "_bw_source", "source_size", F.get(cycle, (F.col("_bw_rank") % len(weights)).cast("int")).alias("_bw_weight"))
    weighed = materialize(weighed.withColumn("_bw_limit", F.col("source_size") * max_epochs).withColumn("_bw_ratio",
        F.col("_bw_limit") / F.col("_bw_weight")), "source-weights")
    summed = running_sums(weighed, ["_bw_ratio", "_bw_none", "_bw_source"], {"_bw_limit": "_bw_limits", "_bw_weight": "_bw_weights"}, "source-limits")
    whole = weighed.agg(F.sum("source_size").alias("_bw_total"), F.sum("_bw_weight").alias("_bw_all"))
    level = (F.col("_bw_total") - F.col("_bw_limits")) / (F.col("_bw_all") - F.col("_bw_weights"))
    levels = summed.crossJoin(F.broadcast(whole)).withColumn("_bw_level", level)  # one row
    common = levels.agg(F.min(F.when(F.col("_bw_ratio") > F.col("_bw_level"), F.struct("_bw_ratio", "_bw_none", "_bw_source",
        "_bw_level")))["_bw_level"].alias("_bw_level"))
    limit = F.col("_bw_limit").cast("double")
    target = F.coalesce(F.least(limit, F.col("_bw_level") * F.col("_bw_weight")), limit)
    return weighed.crossJoin(F.broadcast(common)).select("_bw_none", "_bw_source", "source_size", target.alias("target"))


class Mix:
    """A mix of one table: the sources' targets and the place in the order of each source where its budget ends.

    The budget of a source is its target in whole words: so many whole epochs, then the documents in the order of their
    keys as far as the rest goes; the document at the cut gives its first words only. Reruns agree: the key is a hash of the id.
    Rows that share source and id form one place in the order; at the cut they share its words by size.
    """

    def __init__(self, documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS,
        max_epochs: int = MAX_EPOCHS):
        self.documents, self.columns = documents, (id_col, text_col, source_col)
        self.sizes = materialize(documents.select(*_keyed(documents, *self.columns)), "sizes")
        targets = materialize(source_targets(self.sizes, weights, max_epochs), "source-targets")
        places = self.sizes.groupBy("_bw_none", "_bw_source", "_bw_key", "_bw_id").agg(F.sum("_bw_size").alias("_bw_words"))
        summed = running_sums(places, ["_bw_key", "_bw_id"], {"_bw_words": "_bw_before"}, "places", ["_bw_none", "_bw_source"])
        budget = F.floor("target").cast("long")
        rest = F.when(F.col("source_size") > 0, budget % F.col("source_size")).otherwise(0)
        epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
        parts = targets.select("*", epochs.alias("_bw_epochs"), rest.alias("_bw_rest"))
        at = summed.join(parts.select("_bw_none", "_bw_source", "_bw_rest"), ["_bw_none",
            "_bw_source"]).where("_bw_before <= _bw_rest and _bw_rest < _bw_before + _bw_words")
        cut = at.select("_bw_none", "_bw_source", F.struct("_bw_key", "_bw_id").alias("_bw_cut"), "_bw_words",
            (F.col("_bw_rest") - F.col("_bw_before")).alias("_bw_left"))
        self.sources = materialize(parts.join(cut, ["_bw_none", "_bw_source"], "left"), "source-cuts")

    def _partial(self) -> Column:
        place = F.struct("_bw_key", "_bw_id")
        share = F.floor(F.col("_bw_left").cast("double") * F.col("_bw_size") / F.col("_bw_words")).cast("long")
        return F.when(place < F.col("_bw_cut"), F.col("_bw_size")).when(place == F.col("_bw_cut"), share).otherwise(0)

    def plan(self) -> DataFrame:
        """Per row: id, size, source_size, target, and the words that the mix takes of it, repeats counted.

        A null text has size 0 and nothing is taken of it; null sources are one source; ids may be null or repeated; an empty
        table gives no rows.
        """
        joined = self.sizes.join(self.sources, ["_bw_none", "_bw_source"])
        taken = F.col("_bw_epochs") * F.col("_bw_size") + self._partial()
        return joined.select(F.col("_bw_id").alias(self.columns[0]), F.col("_bw_size").alias("size"), "source_size", "target", taken.alias("taken"))

    def rows(self) -> DataFrame:
        """The mixed table: each row of the documents as often as it is taken; the one at the cut has its first words only.

        All columns stay. Rows without words go, as no word of them is taken.
        """
        id_col, text_col, source_col = self.columns
        kept = self.documents.columns
        keyed = self.documents.select("*", *_keyed(self.documents, *self.columns)).join(self.sources, ["_bw_none", "_bw_source"])
        counted = keyed.withColumn("_bw_part", self._partial())
        copies = F.col("_bw_epochs") * (F.col("_bw_size") > 0).cast("long") + (F.col("_bw_part") > 0).cast("long")
        spread = counted.where(copies > 0).withColumn("_bw_copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
        first = F.call_function("regexp_extract", F.col(text_col), F.concat(F.lit(f"^(?:[{SPACE}]*+[^{SPACE}]++){{"), F.col("_bw_part").cast("string"),
            F.lit("}+")), F.lit(0))
        cut = (F.col("_bw_copy") > F.col("_bw_epochs")) & (F.col("_bw_part") < F.col("_bw_size"))
        return spread.withColumn(text_col, F.when(cut, first).otherwise(F.col(text_col))).select(*kept)
