"""URL filters by hashed host-suffix and path-prefix expressions.

A rule is (host, path, verdict). It fits a URL whose host is the rule's host or a subdomain of it and whose path starts
with the rule's path. A URL is expanded into the expressions that some rule could equal, each expression is hashed, and
an equi-join on the first 8 hex digits of the hash finds candidate rules; the full SHA-256 digest then confirms. Of the
rules that fit, the longest host + path wins.

Which expressions to make follows from the rules: a rule of k host labels and a path of n characters can only equal the
expression (last k labels, first n characters). So a URL meets, by its label counts, the path lengths that rules of so
many labels have. They bound the expansion of any URL, however long its host or path is, and rules of any number of
shapes are followed.

Defined results: a null URL, or one without "://", has empty host and path, fits no rule with a host, and gets the
default verdict with a null rule. Of two verdicts for the same host and path, block wins. Rules with a null host or
path are left out. Repeated rows of pages give repeated rows. An empty rule table gives every page the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chiasma.llm.common import ascii_lower, repeated

NAME = "op1_url_filter"
#: (host, path, verdict)
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Rule tables of up to this many rows (under 64 MB) are broadcast; larger ones are joined by a shuffle with salted keys.
BROADCAST_RULES = 200_000
SALTS = 32
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def hashed_rules(rules: DataFrame) -> DataFrame:
    """One row per (host, path): its string, digest, digest prefix and shape."""
    return (
        rules.where("host IS NOT NULL AND path IS NOT NULL")
        .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block > allow
        .select(
            F.concat("host", "path").alias("rule"), "verdict", _labels(F.col("host")).alias("k"), F.length("path").alias("n"),
            F.sha2(F.concat("host", "path"), 256).alias("digest"),
        )
        .withColumn("prefix", F.substring("digest", 1, 8))
    )


def url_filter(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow",
               broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """id_col, host, path, rule, verdict of every row of pages. rules: host, path, verdict ('allow' or 'block')."""
    hashed = hashed_rules(rules)
    # A row for each number of labels that a rule has, with path lengths: no larger than the longest rules.
    shapes = F.broadcast(hashed.groupBy(F.col("k").alias("rule_k")).agg(F.collect_set("n").alias("ns")))
    most = hashed.agg(F.max("k")).first()[0] or 0
    u = pages.select(F.col(f"`{id_col}`").alias("id"), host_of(F.col(f"`{url_col}`")).alias("host"), path_of(F.col(f"`{url_col}`")).alias("path"))
    # The expression "" of no labels stands for the row itself: it carries the row through the grouping and counts repeated rows.
    labels = F.when(F.col("host") != "", F.least(_labels(F.col("host")), F.lit(most))).otherwise(0)
    e = u.withColumn("k", F.explode(F.sequence(F.lit(0), labels))).join(shapes, F.col("k") == F.col("rule_k"), "left")
    lengths = F.when(F.col("k") == 0, F.array(F.lit(0))).otherwise(F.filter("ns", lambda n: n <= F.length("path")))
    e = (
        e.withColumn("n", F.explode(lengths))
        .withColumn("expr", F.when(F.col("k") == 0, "").otherwise(F.expr("concat(substring_index(host, '.', -k), substring(path, 1, n))")))
        .withColumn("x_digest", F.when(F.col("k") > 0, F.sha2("expr", 256)))
        .withColumn("prefix", F.substring("x_digest", 1, 8))
        .drop("k", "rule_k", "ns", "n")
    )
    r = hashed.select("rule", "verdict", "digest", "prefix")
    if r.limit(broadcast_rules + 1).count() <= broadcast_rules:
        hit = e.join(F.broadcast(r), "prefix", "left")
    else:
        salted = r.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        # Rows themselves have no digest and stay out of the join, where they would be one key.
        met = e.where(F.col("expr") != "").withColumn("salt", F.pmod(F.xxhash64("id", "host", "path"), F.lit(SALTS)).cast("int")).join(salted, ["prefix", "salt"]).drop("salt")
        own = e.where(F.col("expr") == "").withColumns({c: F.lit(None).cast("string") for c in ("rule", "verdict", "digest")})
        hit = met.unionByName(own)
    fits = F.col("digest") == F.col("x_digest")
    best = F.max(F.when(fits, F.struct(F.length("rule").alias("len"), F.col("rule"), F.col("verdict"))))
    judged = hit.where((F.col("expr") == "") | fits).groupBy("id", "host", "path").agg(F.count(F.when(F.col("expr") == "", 1)).alias("copies"), best.alias("best"))
    return repeated(judged, "copies").select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


ORACLE_SQL = """
WITH rules(rhost, rpath, rverdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
    ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (
  SELECT row_number() OVER () AS k, page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
m AS (
  SELECT u.*, rhost || rpath AS rule, rverdict,
    row_number() OVER (PARTITION BY k ORDER BY length(rhost || rpath) DESC NULLS LAST) AS i
  FROM u LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM m WHERE i = 1
"""
