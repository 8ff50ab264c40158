"""URL filters: host-suffix and path-prefix expressions against a rule list.

Each URL is cut into host and path. Its host suffixes times its path prefixes (only lengths that some rule has) are
the expressions a rule could be written as. They meet the rules in an equi-join on a short prefix of their digest;
the full digest confirms, and the longest rule wins (ties: the longer host, then block before allow, then the
smaller rule string).

Everything is DataFrame functions. The join runs over distinct (host, path) pairs, so a URL that fills a third of
the table is expanded once. Rules are broadcast only while they are at most ``broadcast_rules`` rows of bounded
length; beyond that the same equi-join shuffles.

Defined cases: a null URL or one without ``://`` has an empty host and path and gets the default verdict; repeated
rows are judged alike and all returned; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.work import literal_table, read

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORT = 8  # hex digits of the digest that the join uses

RULES = [
    {"rule_host": "com", "rule_path": "/en/", "verdict": "block"},
    {"rule_host": "example.com", "rule_path": "/en/7", "verdict": "allow"},
    {"rule_host": "net", "rule_path": "/de/", "verdict": "allow"},
    {"rule_host": "example.net", "rule_path": "/de/8", "verdict": "block"},
    {"rule_host": "org", "rule_path": "/es/", "verdict": "block"},
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    form = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, form, 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, form, 2), F.lit(""))


def judge_urls(pages: DataFrame, rules: DataFrame, *, key: str = "page_id", url: str = "url", default: str = "allow", broadcast_rules: int = 20_000, longest_rule: int = 2_048) -> DataFrame:
    """One row per row of ``pages``: the key, host, path, winning rule (or null) and verdict.

    ``rules`` has rule_host, rule_path and verdict; rows with a null in them are no rules.
    """
    rules = rules.select("rule_host", "rule_path", "verdict").dropna().distinct()
    # One row: how deep hosts go and which path lengths occur. Both are bounded by the longest rule.
    shape = rules.agg(F.max(F.size(F.split("rule_host", r"\."))).alias("depth"), F.collect_set(F.length("rule_path")).alias("lengths"), F.count("*").alias("n"), F.max(F.length("rule_host") + F.length("rule_path")).alias("longest")).first()
    named = rules.select(F.concat("rule_host", "rule_path").alias("rule"), F.length("rule_host").alias("host_length"), "verdict")
    named = named.withColumn("digest", F.sha2("rule", 256)).withColumn("short", F.substring("digest", 1, SHORT))
    if shape["n"] <= broadcast_rules and (shape["longest"] or 0) <= longest_rule:
        named = F.broadcast(named)

    host, path = host_and_path(F.col(url))
    slim = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.expr(f"transform(sequence(1, least(size(labels), {shape['depth'] or 1})), i -> array_join(slice(labels, size(labels) - i + 1, i), '.'))")
    lengths = F.array(*(F.lit(x) for x in sorted(shape["lengths"]))).cast("array<int>")
    tried = (
        slim.select("host", "path").distinct()
        .withColumn("labels", labels).withColumn("suffix", F.explode(suffixes))
        .withColumn("cut", F.explode(lengths)).where("length(path) >= cut")
        .select("host", "path", F.concat("suffix", F.expr("substring(path, 1, cut)")).alias("tried"))
        .withColumn("tried_digest", F.sha2("tried", 256)).withColumn("short", F.substring("tried_digest", 1, SHORT))
    )
    met = tried.join(named, "short").where((F.col("tried_digest") == F.col("digest")) & (F.col("tried") == F.col("rule")))
    rank = F.struct(-F.length("rule"), -F.col("host_length"), F.when(F.col("verdict") == "block", 0).otherwise(1), F.col("rule"), F.col("verdict").alias("verdict"))
    won = met.groupBy("host", "path").agg(F.min(rank).alias("best")).select("host", "path", "best.rule", "best.verdict")
    return slim.join(won, ["host", "path"], "left").select(key, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op1_url_filters(spark, sf_dir: str) -> DataFrame:
    rules = literal_table(spark, RULES, "rule_host string, rule_path string, verdict string")
    return judge_urls(read(spark, sf_dir, "pages"), rules)


ORACLE = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), named AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(rule_host, rule_path, verdict) AS (
  VALUES {", ".join(f"('{r['rule_host']}', '{r['rule_path']}', '{r['verdict']}')" for r in RULES)}
), met AS (
  SELECT n.*, r.rule_host || r.rule_path AS rule, r.verdict,
         row_number() OVER (PARTITION BY n.page_id, n.host, n.path ORDER BY length(r.rule_host || r.rule_path) DESC NULLS LAST) AS place
  FROM named n LEFT JOIN rules r
    ON (n.host = r.rule_host OR n.host LIKE '%.' || r.rule_host) AND starts_with(n.path, r.rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM met WHERE place = 1
"""
