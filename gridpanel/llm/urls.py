"""URL rules as a sort-merge range join, in DataFrame operations only.

A host's canonical key has its labels in reverse, each with a point behind
(``en.example.org`` -> ``org.example.en.``). So a rule's host and all its subdomains
are the keys that begin with the rule's key: one interval, and intervals of rules lie
in one another or apart. Each interval start and end is a boundary that carries the
stack of rules active from there on. Urls and boundaries are sorted together, the
sweep hands each url the stack of the last boundary before it, and the longest rule
on the stack whose path begins the url's path wins (equal length: ``block``).

Rows are dealt by ranges of (key, path, page), so one host's pages spread over tasks;
a task starts its sweep from the last stack of the tasks before it. The rules are
never broadcast, and only one stack a task meets in one place.

Null urls, and urls without ``://``, have empty host and path. A rule with an empty
host fits every host. No rule: ``default``. Repeated rows and null page ids are judged
like any other; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridpanel.sources.scratch import landed

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STACK = "array<struct<size:int,rule:string,verdict:string,path:string>>"


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``verdict, host, path`` from (verdict, host, path) triples."""
    if not rules:
        return spark.createDataFrame([], "verdict string, host string, path string")
    names = ("verdict", "host", "path")
    each = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, rule)]) for rule in rules]
    return spark.range(1).select(F.inline(F.array(*each)))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, SMALL), F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.concat_ws(".", F.reverse(F.split(host, "\\."))), F.lit("."))


def boundaries(rules: DataFrame) -> DataFrame:
    """``key, stack``: from each interval's start and end on, the rules that are active."""
    host = F.translate(F.coalesce("host", F.lit("")), UPPER, SMALL)
    path = F.coalesce("path", F.lit(""))
    named = rules.select(host.alias("host"), path.alias("path"), "verdict").withColumn(
        "key", F.when(F.col("host") == "", F.lit("")).otherwise(host_key(F.col("host")))
    )
    rule = F.concat("host", "path")
    own = named.groupBy("key").agg(
        F.collect_set(F.struct(F.length(rule).alias("size"), rule.alias("rule"), "verdict", "path")).alias("own")
    )
    above = F.expr(
        "transform(sequence(0, size(split(key, '[.]')) - 1), "
        "n -> if(n = 0, '', concat(substring_index(key, '.', n), '.')))"
    )
    pairs = own.select("key", F.explode(F.array_distinct(above)).alias("above"))
    pairs = pairs.join(own.select(F.col("key").alias("above"), "own"), "above")
    stacks = pairs.groupBy("key").agg(
        F.flatten(F.collect_list("own")).alias("starts"),
        F.flatten(F.collect_list(F.when(F.col("above") != F.col("key"), F.col("own")))).alias("ends"),
    )
    after = F.concat(F.expr("left(key, length(key) - 1)"), F.lit("/"))
    starts = stacks.select("key", F.col("starts").cast(STACK).alias("stack"))
    return starts.unionByName(
        stacks.where("key <> ''").select(after.alias("key"), F.col("ends").cast(STACK).alias("stack"))
    )


def judge(
    pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow"
) -> DataFrame:
    """``page, host, path, rule, verdict`` of every page."""
    host, path = url_parts(F.col(f"`{url}`").cast("string"))
    urls = pages.select(F.col(f"`{key}`").alias("page"), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("key", host_key(F.col("host")))
    marks = boundaries(rules)
    events = urls.withColumn("stack", F.lit(None).cast(STACK)).unionByName(marks, allowMissingColumns=True)
    is_url = F.col("stack").isNull()
    dealt = events.withColumn("turn", is_url.cast("int")).repartitionByRange("key", "turn", "path", "page")
    stored = landed(dealt.withColumn("part", F.spark_partition_id()), "url-events")

    last = stored.groupBy("part").agg(F.max_by("stack", F.when(F.col("turn") == 0, F.col("key"))).alias("stack"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    carried = last.select("part", F.last("stack", ignorenulls=True).over(before).alias("carried"))
    sweep = Window.partitionBy("part").orderBy("key", "turn").rowsBetween(Window.unboundedPreceding, 0)
    swept = stored.withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).where("turn = 1")
    active = F.coalesce("stack", "carried", F.array().cast(STACK))
    fitting = F.filter(active, lambda r: F.col("path").startswith(r["path"]))
    won = swept.join(carried, "part").withColumn("won", F.array_max(fitting))
    return won.select(
        "page", "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict")
    )
