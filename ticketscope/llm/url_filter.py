"""URL rules by host suffix and path prefix. DataFrame functions only.

Every URL is expanded into expressions: each suffix of its host's labels joined with each prefix
of its path that ends in "/" (and the empty prefix). A rule has one key of the same form: its host
and its path up to the last "/". Expressions and keys are equi-joined on the first `PREFIX` hex
digits of their SHA-256; the full digest and the rest of the rule's path are then confirmed, and
the longest rule wins (of equally long ones that with the longer host, then block). URLs expand no
deeper than the deepest rule, whose depth is one row of statistics, so a long URL costs no more
expressions than the rules can match. Each distinct (host, path) is judged once.

A host is what follows the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; a path what
follows up to "?", "#" or the end. A rule fits its host and all its subdomains if the path starts
with the rule's path. URLs without a rule get the default verdict. A null or malformed URL has an
empty host and path and meets no rule but one of an empty host. Rows that repeat are judged each;
an empty table gives an empty result, an empty rule table gives every URL the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketscope.llm.common import ascii_lower, store

PREFIX = 8
DEFAULT_VERDICT = "allow"

#: The rules of the contract: (action, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """(action, rule) from literals."""
    rows = F.array(*(F.struct(F.lit(a).alias("action"), F.lit(r).alias("rule")) for a, r in rules))
    return spark.range(1).select(F.inline(rows))


def _keyed(rules: DataFrame) -> DataFrame:
    slash = F.instr("rule", "/")
    host = F.when(slash > 0, F.substring("rule", F.lit(1), slash - 1)).otherwise(F.col("rule"))
    parsed = rules.filter(F.col("rule").isNotNull()).select(
        "action", "rule", ascii_lower(host).alias("rule_host"),
        F.when(slash > 0, F.expr("substring(rule, instr(rule, '/'))")).otherwise(F.lit("")).alias("rule_path"))
    key = F.concat("rule_host", F.regexp_extract("rule_path", r"(?s)^(.*/)?", 0))
    return (parsed.withColumn("digest", F.sha2(key, 256)).withColumn("short", F.substring("digest", 1, PREFIX))
            .withColumn("labels", F.size(F.split("rule_host", r"\.")))
            .withColumn("slashes", F.length("rule_path") - F.length(F.replace("rule_path", F.lit("/")))))


def _steps(n: Column) -> Column:
    """1..n, empty for n under 1."""
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def expressions(host: Column, path: Column, labels: int, slashes: int) -> Column:
    """Host suffixes of at most `labels` labels times path prefixes of at most `slashes` slashes."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    hosts = F.transform(_steps(F.least(n, F.lit(labels))),
                        lambda k: F.array_join(F.slice(parts, n - k + 1, k), "."))
    pieces = F.split(path, "/", slashes + 1)
    dirs = F.transform(_steps(F.size(pieces) - 1),
                       lambda k: F.concat(F.array_join(F.slice(pieces, 1, k), "/"), F.lit("/")))
    prefixes = F.concat(F.array(F.lit("")), dirs)
    return F.flatten(F.transform(hosts, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT) -> DataFrame:
    """Per page: page_id, host, path, rule and verdict."""
    keyed = store(_keyed(rules), "url-rules")  # its true size decides on a broadcast
    deepest = keyed.agg(F.max("labels"), F.max("slashes")).first()
    labels, slashes = (x or 0 for x in deepest)
    located = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    places = located.select("host", "path").distinct()
    asked = (places.withColumn("digest", F.explode(F.transform(
        expressions(F.col("host"), F.col("path"), labels, slashes), lambda e: F.sha2(e, 256))))
        .withColumn("short", F.substring("digest", 1, PREFIX)))
    matches = (asked.join(keyed.withColumnRenamed("digest", "full"), "short")
               .filter((F.col("digest") == F.col("full")) & F.startswith("path", "rule_path")))
    rank = F.struct(F.length("rule"), F.length("rule_host"), F.col("action") == "block", "rule")
    best = (matches.groupBy("host", "path").agg(F.max_by(F.struct("rule", "action"), rank).alias("best"))
            .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.action").alias("action")))
    return located.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict"))
