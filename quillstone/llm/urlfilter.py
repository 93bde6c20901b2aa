"""URL allow and block rules by a sort-merge range join.

A url's host is cut at its last 1..k labels (k: the labels of the longest rule host) and reversed, so that a rule
(host, path) is the interval from (reversed host, path) to (reversed host, path + 0xFF) in byte order, and rules of
one host nest. Urls and rule ends are dealt out by key range together (equal keys of a hot host are split by row),
written once, and swept in order. The stack of active rules is kept by depth: a rule that opens at depth d is the top
of the stack for each later position of depth d, until the next rule opens there. Depths and stacks are first swept
inside each range, then carried over the ranges, of which there are as many as shuffle partitions.

Cases: a null url, or one without ://, has an empty host and path and fits no rule, as does an empty host; repeated
page ids and urls give one result for each row; an empty table gives an empty result; no rules at all give the
default verdict for all rows; of rules that fit equally long the one with the longer host wins, then the later one in
the given list does not matter because (host, path) must be distinct. Other columns of the input are not carried.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm.common import default_parallelism, literal_rows, materialize, release


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str


RULES = (
    UrlRule("allow", "org", "/"),
    UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
)
DEFAULT = "allow"
OPEN, PAGE, CLOSE = 1, 2, 0


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _reversed(labels: Column) -> Column:
    return F.encode(F.array_join(F.reverse(labels), "."), "UTF-8")


def rules_frame(spark: SparkSession, rules: tuple[UrlRule, ...]) -> DataFrame:
    """Rules as rows (verdict, host, path); any DataFrame of that form will do."""
    if len({(r.host, r.path) for r in rules}) < len(rules):
        raise ValueError("two rules have the same host and path")
    return literal_rows(spark, [(r.verdict, r.host, r.path) for r in rules], "verdict string, host string, path string")


def _top_of_stack(events: DataFrame) -> DataFrame:
    """events: range (in key order), key columns k1, k2, kind, uid; rule set on OPEN. Adds top: the innermost rule active at each row."""
    within = Window.partitionBy("range").orderBy("k1", "k2", "kind", "width", "uid")
    step = F.when(F.col("kind") == OPEN, 1).when(F.col("kind") == CLOSE, -1).otherwise(0)
    # One row a range: how far each one raises the depth. Bounded by the number of ranges.
    rise = events.groupBy("range").agg(F.sum(step).alias("rise"))
    before = rise.select("range", (F.sum("rise").over(Window.orderBy("range")) - F.col("rise")).alias("base"))
    local = events.join(F.broadcast(before), "range").select("*", (F.col("base") + F.sum(step).over(within)).cast("int").alias("depth"))
    # The last rule opened at each depth of the ranges before: at most ranges x depths rows.
    opened = local.groupBy("range", "depth").agg(F.max_by("rule", F.when(F.col("kind") == OPEN, F.struct("k1", "k2"))).alias("rule"))
    earlier = Window.partitionBy("depth").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = opened.select("range", "depth", F.last("rule", ignorenulls=True).over(earlier).alias("carried"))
    here = F.last(F.when(F.col("kind") == OPEN, F.col("rule")), ignorenulls=True).over(
        Window.partitionBy("range", "depth").orderBy("k1", "k2", "kind", "width", "uid"))
    swept = local.select("*", here.alias("here")).filter((F.col("kind") == PAGE) & (F.col("depth") > 0))
    return swept.join(F.broadcast(carried), ["range", "depth"], "left").select("*", F.coalesce("here", "carried").alias("top"))


def url_filter(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, url: str = "url", page_id: str = "page_id") -> DataFrame:
    """page_id, host, path, rule (null if none fits) and verdict for every row of pages."""
    spark, n = pages.sparkSession, default_parallelism(pages.sparkSession)
    pages = materialize(pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"),
                                     F.monotonically_increasing_id().alias("uid")))
    rules = rules.select("verdict", "host", "path", F.split("host", "[.]").alias("labels"))
    depths = [r[0] for r in rules.select(F.size("labels")).distinct().collect()]  # as many as label counts of rules
    labels = F.split("host", "[.]")
    levels = pages.filter(F.col("host") != "").select("uid", "path", labels.alias("labels"),
        F.explode(F.array(*map(F.lit, depths)) if depths else F.array().cast("array<int>")).alias("k"))
    levels = levels.filter(F.size("labels") >= F.col("k")).select(
        _reversed(F.slice("labels", -F.col("k"), F.col("k"))).alias("k1"), F.encode("path", "UTF-8").alias("k2"),
        F.lit(PAGE).alias("kind"), F.lit(0).alias("width"), "uid",
        F.lit(None).cast("struct<verdict:string,host:string,path:string>").alias("rule"))
    rule, lo = F.struct("verdict", "host", "path"), F.encode("path", "UTF-8")
    opens = rules.select(_reversed(F.col("labels")).alias("k1"), lo.alias("k2"), F.lit(OPEN).alias("kind"), F.length("path").alias("width"),
        F.lit(-1).cast("long").alias("uid"), rule.alias("rule"))
    closes = rules.select(_reversed(F.col("labels")).alias("k1"), F.concat(lo, F.lit(bytearray(b"\xff"))).alias("k2"),
        F.lit(CLOSE).alias("kind"), (-F.length("path")).alias("width"), F.lit(-1).cast("long").alias("uid"), rule.alias("rule"))
    events = levels.unionByName(opens).unionByName(closes)
    dealt = materialize(events.repartitionByRange(n, "k1", "k2", "kind", "width", "uid").withColumn("range", F.spark_partition_id()))
    top = _top_of_stack(dealt)
    longest = F.struct((F.length("top.host") + F.length("top.path")).alias("n"), F.length("top.host").alias("h"))
    best = top.groupBy("uid").agg(F.max_by("top", longest).alias("best"))
    return pages.join(best, "uid", "left").select(
        "page_id", "host", "path", F.concat("best.host", "best.path").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def oracle(rules: tuple[UrlRule, ...] = RULES, default: str = DEFAULT) -> str:
    values = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in rules)
    return rf"""
WITH p AS (SELECT page_id, row_number() OVER () AS u, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(verdict, rhost, rpath) AS (VALUES {values}),
best AS (SELECT u, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY u)
SELECT page_id, host, path, rule, coalesce(verdict, '{default}') AS verdict FROM p LEFT JOIN best USING (u)"""
