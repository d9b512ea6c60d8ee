"""URL filters: prefix rules as intervals of reversed-host keys, matched by a sorted sweep over nested intervals.

The key of a host and path is the host's labels from the last to the first, a low separator and the path, so that all paths below a rule's path are one
interval of keys, and intervals of rules are nested or apart. A URL is looked up at those suffixes of its host that have as many labels as some rule's host.
The sweep goes through starts, ends and look-ups in key order and knows the top of the stack of open intervals: a start puts its own rule there, an end its
parent.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brickwise.runtime import materialize, range_table

#: Rules as (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DEFAULT_VERDICT = "allow"


def host_of(url: Column | str) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    url = F.col(url) if isinstance(url, str) else url
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column | str) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    url = F.col(url) if isinstance(url, str) else url
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def _key(host: Column, path: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "\u0001"), F.lit("\u0000"), path).cast("binary")


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) of rules given in the program, as literals of the plan; longer lists are read from a table."""
    rows = [F.struct(*[F.lit(v).alias(n) for n, v in zip(("host", "path", "verdict"), r, strict=True)]) for r in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _with_parents(rules: DataFrame) -> DataFrame:
    """Rules (key, path, rule, verdict) with the struct of the innermost rule around each: the longest proper prefix of its path that is a rule of its host."""
    named = rules.select("host", "path", "verdict", F.concat("host", "path").alias("rule")).groupBy("host", "path",
        "rule").agg(F.min("verdict").alias("verdict"))
    lengths = named.groupBy("host").agg(F.collect_set(F.length("path")).alias("lengths"))  # only lengths that the host's rules have
    inside = named.join(lengths, "host").select("host", F.col("path").alias("whole"), F.explode("lengths").alias("n")).where("n < length(whole)")
    prefixes = inside.select("host", "whole", F.expr("substring(whole, 1, n)").alias("path"), "n")
    found = prefixes.join(named, ["host", "path"]).groupBy("host", "whole").agg(F.max_by(F.struct("rule", "verdict"), "n").alias("parent"))
    return named.join(found.withColumnRenamed("whole", "path"), ["host", "path"], "left").select(_key(F.col("host"), F.col("path")).alias("key"),
        F.struct("rule", "verdict").alias("self"), "parent")


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """Per row: id, host, path, the longest rule that fits (null without one) and its verdict, or the default.

    A rule fits its host (not an empty one) and all subdomains if the path starts with its path; of two rules of a row the longer one wins.
    A null URL, or one without ``://``, has an empty host and path, which no rule fits. Where one host and path has several verdicts, ``allow`` wins.
    Ids may be null or repeated: each row is judged on its own. Other columns are ignored; empty tables give no rows.
    """
    judged = pages.select(F.col(id_col).alias("_bw_id"), host_of(url_col).alias("host"), path_of(url_col).alias("path"))
    rows, hostless = judged.where("host <> ''"), judged.where("host = ''")
    # one look-up for each distinct host and path, however often it is repeated
    urls = rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("_bw_n")).select("host", "path")
    labels = F.split("host", r"\.", -1)
    lengths = rules.agg(F.coalesce(F.collect_set(F.size(F.split("host", r"\.", -1))), F.array().cast("array<int>")).alias("lengths"))  # one row
    split = urls.crossJoin(F.broadcast(lengths)).select("host", "path", labels.alias("labels"),
        F.explode("lengths").alias("n")).where(F.col("n") <= F.size("labels"))
    lookups = split.select("host", "path", F.array_join(F.slice("labels", F.size("labels") - F.col("n") + 1, F.col("n")), ".").alias("suffix"))
    asked = lookups.select(_key(F.col("suffix"), F.col("path")).alias("key"), F.lit(1).alias("kind"), "host", "path",
        F.lit(None).cast("struct<rule:string,verdict:string>").alias("top"))
    nested = _with_parents(rules)
    none = F.lit(None).cast("string")
    absent = F.struct(none.alias("rule"), none.alias("verdict"))
    starts = nested.select("key", F.lit(0).alias("kind"), none.alias("host"), none.alias("path"), F.col("self").alias("top"))
    ends = nested.select(F.concat("key", F.lit(bytearray(b"\xff"))).alias("key"), F.lit(0).alias("kind"), none.alias("host"), none.alias("path"),
        F.coalesce("parent", absent).alias("top"))
    swept = range_table(asked.unionByName(starts).unionByName(ends), ["key", "kind", "host", "path"], "url-sweep")
    # the top of the stack where each range begins: the last start or end before it
    last = swept.where("kind = 0").groupBy("_bw_part").agg(F.max_by("top", "key").alias("last"))
    parts = swept.select("_bw_part").distinct().join(last, "_bw_part", "left")
    before = Window.orderBy("_bw_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    begins = parts.select("_bw_part", F.last("last", ignorenulls=True).over(before).alias("begin"))
    sofar = Window.partitionBy("_bw_part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    topped = swept.withColumn("seen", F.last("top", ignorenulls=True).over(sofar)).where("kind = 1").join(begins, "_bw_part")
    fits = topped.select("host", "path", F.coalesce("seen", "begin").alias("fit"))
    best = fits.groupBy("host", "path").agg(F.max(F.when(F.col("fit.rule").isNotNull(), F.struct(F.length("fit.rule").alias("n"), "fit.rule",
        "fit.verdict"))).alias("best"))
    best = materialize(best.select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict")), "url-verdicts")
    found = rows.join(best, ["host", "path"]).select("_bw_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
    found = found.unionByName(hostless.withColumn("rule", none).withColumn("verdict", F.lit(default)))
    return found.withColumnRenamed("_bw_id", id_col)
