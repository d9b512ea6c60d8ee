"""Registered queries of the training-data operations and their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickwise.llm import bpe, chat, ebm, embed_dedup, imatch, merkle, mixing, negatives, pii, sharding, simhash, topk, url_rules
from brickwise.runtime import scratch_root
from brickwise.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """The words that a mix of all documents takes of each."""
    return mixing.Mix(table(spark, folder, "documents")).plan()


OP1_SQL = """
WITH docs AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM docs GROUP BY source
), weighed AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sources
), summed AS (
  SELECT *, CAST(3 * source_size AS DOUBLE) / weight AS ratio,
    coalesce(sum(3 * source_size) OVER before, 0) AS limits, coalesce(sum(weight) OVER before, 0) AS weights,
    sum(source_size) OVER () AS total, sum(weight) OVER () AS everything
  FROM weighed
  WINDOW before AS (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT *, CAST(total - limits AS DOUBLE) / CAST(everything - weights AS DOUBLE) AS level FROM summed
), common AS (
  SELECT arg_min(level, ratio) AS level FROM levels WHERE ratio > level
), targets AS (
  SELECT l.source, l.source_size, coalesce(least(CAST(3 * l.source_size AS DOUBLE), c.level * l.weight), CAST(3 * l.source_size AS DOUBLE)) AS target
  FROM levels l LEFT JOIN common c ON true
), placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY substr(md5(CAST(d.doc_id AS VARCHAR) || ':mix'), 1, 16), d.doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - ahead)) END AS BIGINT) AS taken
FROM placed
"""


def op2_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links, components and representatives of all embeddings at a cosine of 0.9."""
    return embed_dedup.near_duplicates(table(spark, folder, "embeddings"))


def op3_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts and digests of all documents, encoded and decoded again."""
    return bpe.bpe_digests(table(spark, folder, "documents"))


def op4_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in all documents: counts, the digest of the base spans, all spans."""
    return pii.pii_report(table(spark, folder, "documents"))


def op5_imatch(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, with likenesses."""
    return imatch.fingerprints(table(spark, folder, "documents"))


def op6_chat(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, and one more whose texts hold control strings, formatted and read back."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    own = "</s>[INST] ok [/INST]"
    trap = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0,
        "user").otherwise("assistant").alias("role"), F.lit(own).alias("text"))
    return chat.digests(chat.format_records(chat.records_of(rows.unionByName(trap))))


OP6_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|turn|><|text|><|end|>') + length(replace(replace(role, '\', '\e'), '<|', '\l|')) + length(replace(replace(text, '\', '\e'), '<|',
  '\l|'))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""


def op7_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The verdict on every page's URL."""
    return url_rules.judge(table(spark, folder, "pages"), url_rules.rule_table(spark, url_rules.RULES))


OP7_SQL = r"""
WITH parts AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), rules(rule_host, rule_path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fits AS (
  SELECT page_id, host, path, max({'n': length(rule_host || rule_path), 'rule': rule_host || rule_path, 'verdict': verdict}) FILTER (WHERE rule_host IS NOT NULL) AS best
  FROM parts LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id, host, path
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM fits
"""


def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as read from a store that took them in as arrivals and compacted them."""
    return sharding.shard_documents(table(spark, folder, "documents"), f"{scratch_root(spark)}/shards-{uuid.uuid4().hex}")


OP8_SQL = """
SELECT doc_id, CAST(doc_id % 32 AS BIGINT) AS arrival, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes, sha256(text) AS text_sha256 FROM documents
"""


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality scores of all documents, learnt from the labels."""
    return ebm.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all documents and the components of their links at 3 bits at most."""
    return simhash.simhash_components(table(spark, folder, "documents"))


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every anchor and positive among all embeddings."""
    return negatives.hard_negatives(table(spark, folder, "embeddings"))


_USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

OP11_SQL = f"""
WITH taken AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND {_USABLE}
), pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM taken a JOIN taken b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), fitting AS (
  SELECT p.*, n.vec_id AS negative_id, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS rank
  FROM positives p JOIN pairs n ON p.anchor_id = n.anchor_id AND NOT n.same AND 30 * positive_score <= 100 * n.score AND 100 * n.score <= 90 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM fitting WHERE rank <= 10
"""


def op12_merkle(spark: SparkSession, folder: str) -> DataFrame:
    """Leaf, roots and proof of every document, and what proofs fold to after some texts were tampered with."""
    return merkle.document_manifest(table(spark, folder, "documents"))


#: Levels that the SQL below spells out: sources of up to 16^5 documents, up to 16^3 sources.
SQL_LEVELS, SQL_TOP_LEVELS = 5, 3


def _merkle_sql() -> str:
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    leaf = lambda text: f"sha256({' || '.join([field('doc_id'), field('source'), field('lang'), field('n_chars'), field(text)])})"
    bits = "list_reduce(list_prepend(xor(c, b), [1, 2, 3, 4, 5, 6, 7, 8]), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)"
    codes = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: xor(c >> 8, {bits.replace('xor(c, b)', '(xor(c, b) & 255)')})), 4294967295)"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [f"""rows AS (
  SELECT doc_id, source, {leaf('text')} AS leaf, {leaf('changed')} AS now
  FROM (SELECT *, CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN {lower} ELSE text END AS changed FROM documents)
), leaves AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM rows
), s0 AS (SELECT tree, place, leaf AS digest FROM leaves)"""]  # fmt: skip

    def climb(name: str, levels: int) -> None:
        """A single node stays as it is; else every run of 16 becomes a node."""
        for h in range(levels):
            parts.append(f"""{name}{h + 1} AS (
  SELECT tree, place // 16 AS place, CASE WHEN any_value(nodes) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY place)) END AS digest
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS nodes FROM {name}{h}) GROUP BY tree, place // 16
)""")

    climb("s", SQL_LEVELS)
    parts.append(f"t0 AS (SELECT 0 AS tree, tree AS place, digest FROM s{SQL_LEVELS})")
    climb("t", SQL_TOP_LEVELS)
    siblings, fold = [], "now"
    for name, levels, tree, place in (("s", SQL_LEVELS, "tree", "place"), ("t", SQL_TOP_LEVELS, "0", "tree")):
        for h in range(levels):
            at = f"({place} // {16**h})"
            run = f"coalesce((SELECT list({{'p': n.place, 'd': n.digest}} ORDER BY n.place) FROM {name}{h} n WHERE n.tree = f.{tree} AND n.place // 16 = f.{place} // {16 ** (h + 1)}), [])"
            siblings.append((run.replace("f.0", "0"), at, f"(SELECT count(*) FROM {name}{h} n WHERE n.tree = f.{tree})".replace("f.0", "0")))
    columns = ", ".join(f"{run} AS run{i}, {count} AS nodes{i}" for i, (run, _, count) in enumerate(siblings))
    parts.append(f"runs AS (SELECT f.*, {columns} FROM leaves f)")
    others = " || ".join(f"CASE WHEN nodes{i} = 1 THEN '' ELSE coalesce(array_to_string(list_transform(list_filter(run{i}, lambda x: x.p <> {at}), lambda x: x.d), ''), '') END"
        for i, (_, at, _) in enumerate(siblings))
    steps = [f"f0 AS (SELECT *, now AS folded0, sha256({others}) AS proof_sha256 FROM runs)"]
    for i, (_, at, _) in enumerate(siblings):
        digest = f"CASE WHEN x.p = {at} THEN folded{i} ELSE x.d END"
        steps.append(f"f{i + 1} AS (SELECT *, CASE WHEN nodes{i} = 1 THEN folded{i} ELSE sha256(array_to_string(list_transform(run{i}, lambda x: {digest}), '')) END AS folded{i + 1} FROM f{i})")
    return f"""WITH {', '.join(parts + steps)}
SELECT doc_id, leaf, s.digest AS subroot, r.digest AS root, proof_sha256, folded{len(siblings)} AS folded_root, folded{len(siblings)} = r.digest AS verified
FROM f{len(siblings)} f JOIN s{SQL_LEVELS} s ON s.tree = f.tree CROSS JOIN t{SQL_TOP_LEVELS} r"""


def op13_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten highest inner products of every hundredth embedding with all others."""
    return topk.nearest_rows(table(spark, folder, "embeddings"))


OP13_SQL = f"""
WITH taken AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE {_USABLE}
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM taken q JOIN taken c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
QUALIFY rank <= 10
"""


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_mixing, op2_embedding_dedup, op3_byte_bpe, op4_pii, op5_imatch, op6_chat, op7_url_rules, op8_sharding, op9_quality,
        op10_simhash, op11_hard_negatives, op12_merkle, op13_exact_topk)}


def oracle_sql() -> dict[str, str]:
    """Where SQL can express a query."""
    return {"op1_mixing": OP1_SQL, "op6_chat": OP6_SQL, "op7_url_rules": OP7_SQL, "op8_sharding": OP8_SQL, "op11_hard_negatives": OP11_SQL,
        "op12_merkle": _merkle_sql(), "op13_exact_topk": OP13_SQL}
