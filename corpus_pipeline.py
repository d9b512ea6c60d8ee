"""Corpus pipeline: quality filter, near-duplicate removal, redaction, mixing and byte-level BPE, one written stage after another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickwise.llm import bpe, ebm, mixing, pii, simhash
from brickwise.runtime import materialize
from brickwise.sources.tables import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Rows of whole texts that a Python worker holds at a time: some MB instead of the default's tenfold.
BATCH_ROWS = 1000


def _small_batches(spark: SparkSession) -> None:
    """For the session from here on, as stages are run after they return."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    _small_batches(spark)
    model = ebm.learn(docs, table(spark, sf_dir, "labels"))
    return docs.where(ebm.score(model, "text") >= ebm.THRESHOLD)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    _small_batches(spark)
    return simhash.keep_one_of_each_group(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.Mix(docs).rows().withColumn("n_chars", F.length("text").cast("long"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's id, source, token ids, their number, and digests of the ids and of their decoded bytes."""
    _small_batches(spark)
    return docs.select("doc_id", "source", bpe.ByteBpe().round_trip("text", with_ids=True).alias("coded")).select("doc_id", "source", "coded.*")


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("PII redaction", redact_pii),
    ("mixing to target weights", mix_sources),
    ("byte-level BPE", encode),
]

#: The stages hold a trained model, fuzzy links and a tokenizer: SQL can't express them.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over ``documents``; each but the last is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
