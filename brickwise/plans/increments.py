"""Queries on resumable builds, marker logs, event windows, catalogs and configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brickwise.plans.catalog import register
from brickwise.sources.tables import table
from brickwise.streaming import incremental


@register("resume_antijoin", """WITH plan AS (SELECT DISTINCT CAST(l_suppkey % 50 AS INT) AS z0, CAST(l_partkey % 40 AS INT) AS y0 FROM lineitem),
  done AS (SELECT DISTINCT CAST(l_suppkey % 50 AS INT) AS z0, CAST(l_partkey % 40 AS INT) AS y0 FROM lineitem WHERE l_linestatus = 'F' AND l_linenumber = 1
  AND l_quantity > 30)
SELECT z0, count(*) AS n FROM (SELECT * FROM plan EXCEPT SELECT * FROM done) GROUP BY z0""")
def resume_antijoin(spark: SparkSession, folder: str) -> DataFrame:
    keys = [(F.col("l_suppkey") % 50).cast("int").alias("z0"), (F.col("l_partkey") % 40).cast("int").alias("y0")]
    rows = table(spark, folder, "lineitem")
    plan = rows.select(*keys).distinct()
    done = rows.where("l_linestatus = 'F' and l_linenumber = 1 and l_quantity > 30").select(*keys)
    return incremental.pending(plan, done, ["z0", "y0"]).groupBy("z0").agg(F.count(F.lit(1)).alias("n"))


@register("complete_bricks", """WITH d AS (SELECT DISTINCT l_suppkey % 20 AS brick, l_linenumber AS channel FROM lineitem WHERE l_quantity > 45) SELECT brick
  FROM d GROUP BY brick HAVING count(*) = 7""")
def complete_bricks(spark: SparkSession, folder: str) -> DataFrame:
    done = table(spark, folder, "lineitem").where("l_quantity > 45").select((F.col("l_suppkey") % 20).alias("brick"), F.col("l_linenumber").alias("channel"))
    return incremental.complete_bricks(done, ["brick"], 7)


_MARKERS_SQL = """m AS (SELECT event_id AS line_no, CAST(user_id % 12 AS VARCHAR) AS region, CASE user_id % 3 WHEN 0 THEN 'bands' WHEN 1 THEN 'teachers' ELSE 'labels' END AS stage, CASE event_type WHEN 'click' THEN 'START' WHEN 'purchase' THEN 'DONE' ELSE 'FAILED' END AS event FROM events WHERE event_type IN ('click', 'purchase', 'error'))"""


@register("marker_last_state", f"WITH {_MARKERS_SQL} SELECT 'r' || region AS region, stage, arg_max(event, line_no) AS event FROM m GROUP BY region, stage")
def marker_last_state(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").where("event_type in ('click', 'purchase', 'error')")
    stage = F.element_at(F.array(F.lit("bands"), F.lit("teachers"), F.lit("labels")), (F.col("user_id") % 3 + 1).cast("int"))
    event = F.when(F.col("event_type") == "click", "START").when(F.col("event_type") == "purchase", "DONE").otherwise("FAILED")
    lines = rows.select(F.col("event_id").alias("line_no"), F.format_string("at %s PREP_r%d_%s_%s note", F.col("ts").cast("string"), F.col("user_id") % 12,
        stage, event).alias("line"))
    return incremental.last_states(incremental.markers(lines))


@register("tumbling_events", """SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events
  WHERE ts IS NOT NULL GROUP BY 1, 2""")
def tumbling_events(spark: SparkSession, folder: str) -> DataFrame:
    found = incremental.tumbling(table(spark, folder, "events"), "ts", "1 day")
    return found.withColumn("total", F.round("total", 4))


@register("session_events", """WITH f AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1
  ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id
    ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM f)
SELECT user_id, count(DISTINCT s) AS sessions, count(*) AS n FROM s GROUP BY user_id""")
def session_events(spark: SparkSession, folder: str) -> DataFrame:
    found = incremental.sessions(table(spark, folder, "events"), "ts", "30 minutes")
    return found.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("n"))


@register("catalog_lookup", """SELECT n_name, r_name, count(DISTINCT s_suppkey) AS suppliers, count(DISTINCT c_custkey) AS customers FROM nation JOIN region
  ON r_regionkey = n_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name, r_name""")
def catalog_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Counts per store of a catalog; each side is counted before it's joined, so nothing multiplies."""
    suppliers = table(spark, folder, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.countDistinct("s_suppkey").alias("suppliers"))
    customers = table(spark, folder, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.countDistinct("c_custkey").alias("customers"))
    nations = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return nations.join(suppliers, "n_nationkey", "left").join(customers, "n_nationkey", "left").select("n_name", "r_name", zero("suppliers"),
        zero("customers"))


@register("manifest_diff", """WITH k AS (SELECT event_type, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, lag(json_extract_string(props,
  '$.k')) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT event_type, count(*) FILTER (WHERE k IS DISTINCT
  FROM before) AS changed, count(*) AS n FROM k GROUP BY event_type""")
def manifest_diff(spark: SparkSession, folder: str) -> DataFrame:
    """How often a manifest's value differs from the one before."""
    before = F.lag("k").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, folder, "events").withColumn("k", F.get_json_object("props", "$.k")).withColumn("before", before)
    return rows.groupBy("event_type").agg(F.count(F.when(~F.col("k").eqNullSafe(F.col("before")), 1)).alias("changed"), F.count(F.lit(1)).alias("n"))


@register("schema_digest", """SELECT r_name, sha256(r_name || '|' || CAST(r_regionkey AS VARCHAR)) AS digest FROM region""")
def schema_digest(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "region").select("r_name", F.sha2(F.concat_ws("|", "r_name", F.col("r_regionkey").cast("string")).cast("binary"),
        256).alias("digest"))


@register("empty_tile_skipping", """WITH b AS (SELECT vec_id, list_max(embedding) AS top FROM embeddings) SELECT count(*) FILTER (WHERE top > 0.3) AS kept,
  count(*) FILTER (WHERE top <= 0.3) AS skipped FROM b""")
def empty_tile_skipping(spark: SparkSession, folder: str) -> DataFrame:
    top = F.array_max("embedding")
    return table(spark, folder, "embeddings").agg(F.count(F.when(top > 0.3, 1)).alias("kept"), F.count(F.when(top <= 0.3, 1)).alias("skipped"))
