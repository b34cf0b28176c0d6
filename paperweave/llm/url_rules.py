"""Operator 3: URL filters by host-suffix and path-prefix expressions, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweave.llm.common import ASCII_LOWER, ASCII_UPPER, table

RULES = (
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
)
PREFIX_HEX = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty when null or without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    cut = lambda c, marks: cut(F.substring_index(c, marks[0], 1), marks[1:]) if marks else c
    host = cut(rest, "/?#")
    path = cut(rest.substr(F.length(host) + 1, F.length(rest)), "?#")
    return F.translate(host, ASCII_UPPER, ASCII_LOWER), path


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules as (rule_host, rule_path, verdict)."""
    return spark.createDataFrame(list(rules), "rule_host string, rule_path string, verdict string")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws(" ", host, path), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict): one row per row of `pages` (page_id, url).

    A rule (host, path) fits its host and every subdomain of it where the URL's
    path starts with the rule's path; the longest rule (host and path together)
    wins, then the longer host, then block before allow. Without a rule the
    verdict is `default`.

    Each distinct (host, path) is expanded into the host suffixes and path
    prefixes of the sizes that rules have, an equi-join on the first
    `PREFIX_HEX` hex digits of the expression's digest finds candidates, and
    the full digest confirms them. Expansion per URL is bounded by the rules'
    distinct sizes, not by the URL. Rules are a DataFrame of any size: Spark
    broadcasts them only while their measured size allows it.

    Null, empty or scheme-less URLs have empty host and path and meet no rule;
    repeated rows each get their row; other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", F.col("url")).select("page_id", host.alias("host"), path.alias("path"))
    rules = rules.dropDuplicates(["rule_host", "rule_path", "verdict"])
    sizes = rules.agg(
        F.collect_set(F.size(F.split("rule_host", "\\."))).alias("labels"),
        F.collect_set(F.length("rule_path")).alias("chars"),
    ).first()
    suffixes = F.array_compact(F.array(*[
        F.when(F.size(F.split("host", "\\.")) >= n, F.substring_index("host", ".", -n)) for n in sorted(sizes["labels"])
    ])) if sizes["labels"] else F.array().cast("array<string>")
    prefixes = F.array_compact(F.array(*[
        F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(sizes["chars"])
    ])) if sizes["chars"] else F.array().cast("array<string>")
    distinct = urls.select("host", "path").distinct()
    expanded = (
        distinct.withColumn("suffix", F.explode(suffixes)).withColumn("prefix", F.explode(prefixes))
        .withColumn("digest", _digest(F.col("suffix"), F.col("prefix")))
        .select("host", "path", "digest", F.substring("digest", 1, PREFIX_HEX).alias("short"))
    )
    listed = rules.withColumn("full", _digest(F.col("rule_host"), F.col("rule_path"))).withColumn(
        "short", F.substring("full", 1, PREFIX_HEX)
    )
    order = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("size"), F.length("rule_host").alias("of_host"),
        F.col("verdict"),
    )
    found = (
        expanded.join(listed, "short").where(F.col("digest") == F.col("full"))
        .groupBy("host", "path")
        .agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict"), order).alias("best"))
    )
    return urls.join(found, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rule_table(spark, RULES))


SQL = """
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(rh, rp, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                        ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u AS (SELECT DISTINCT host, path FROM p),
m AS (
  SELECT host, path, rh || rp AS rule, v,
         row_number() OVER (PARTITION BY host, path ORDER BY length(rh || rp) DESC, length(rh) DESC, v DESC) AS k
  FROM u JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, p.host, p.path, rule, coalesce(v, 'allow') AS verdict
FROM p LEFT JOIN m ON p.host = m.host AND p.path = m.path AND k = 1
"""
