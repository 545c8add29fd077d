"""Claims, pages and specs made from the driver's tables, with the SQL that makes the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item claims its return flag as its part's colour; a supplier is a domain and a copy cluster."""
    l = table(spark, sf_dir, "lineitem")
    s = lambda c: F.col(c).cast("string")
    return l.select(
        s("l_partkey").alias("product_id"), F.lit("generic").alias("category"), (F.col("l_orderkey").cast("long") * 8 + F.col("l_linenumber")).alias("ord"), F.lit("color").alias("field"),
        F.lit(None).cast("double").alias("num"), F.col("l_returnflag").alias("str"), F.lit(None).cast("boolean").alias("bool"), F.lit(None).cast("array<string>").alias("list"), F.lit(None).cast("string").alias("unit"),
        F.col("l_returnflag").alias("raw"), F.concat(F.lit("color: "), "l_returnflag").alias("span"), F.lit(None).cast("string").alias("context"),
        F.concat(F.lit("u"), s("l_orderkey"), F.lit("-"), s("l_linenumber")).alias("url"), F.concat(F.lit("s"), s("l_suppkey")).alias("domain"),
        F.substring(F.lit("ABCDE"), (F.col("l_suppkey") % 5 + 1).cast("int"), F.lit(1)).alias("tier"), F.lit("kv").alias("extractor"),
        F.when(F.col("l_linenumber") % 3 == 0, 0.95).when(F.col("l_linenumber") % 3 == 1, 0.85).otherwise(0.9).alias("extractor_confidence"),
        F.when(F.col("l_orderkey") % 3 == 0, 1.0).when(F.col("l_orderkey") % 3 == 1, 0.9).otherwise(0.7).alias("entity_match"), F.when(F.col("l_orderkey") % 2 == 0, 1.0).otherwise(0.6).alias("page_specificity"),
        F.concat(F.lit("s"), s("l_suppkey")).alias("cluster"), F.lit("sha256:0").alias("snapshot"), F.lit("2026-01-01T00:00:00Z").alias("fetched_at"),
    )


LINE_CLAIMS = """
claims AS (
  SELECT CAST(l_partkey AS VARCHAR) AS p, l_returnflag AS v, 's' || CAST(l_suppkey AS VARCHAR) AS d, 'u' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS url,
         CAST(l_orderkey AS BIGINT) * 8 + l_linenumber AS ord, substr('ABCDE', CAST(l_suppkey % 5 AS INTEGER) + 1, 1) AS tier,
         CASE CAST(l_suppkey % 5 AS INTEGER) WHEN 0 THEN CAST(1.0 AS DOUBLE) WHEN 1 THEN 0.75 WHEN 2 THEN 0.45 WHEN 3 THEN 0.25 ELSE 0.15 END AS prior,
         CAST(CASE l_linenumber % 3 WHEN 0 THEN 0.95 WHEN 1 THEN 0.85 ELSE 0.9 END AS DOUBLE) AS ec,
         CAST(CASE l_orderkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 ELSE 0.7 END AS DOUBLE) AS em, CAST(CASE l_orderkey % 2 WHEN 0 THEN 1.0 ELSE 0.6 END AS DOUBLE) AS sp
  FROM lineitem
), weighed AS (SELECT *, prior * em * ec * sp AS w FROM claims)"""

CELLS = LINE_CLAIMS + """, cells AS (
  SELECT p, d, v, count(*) AS n, max(w) AS w, bool_or(tier = 'A') AS a, min([-prior, CAST(ord AS DOUBLE)]) AS leader FROM weighed GROUP BY p, d, v
), sw1 AS (SELECT DISTINCT p, d, CAST(1.0 AS DOUBLE) AS weight, FALSE AS settled FROM cells)"""


def round_sql(i: int) -> str:
    """Decision of round i with the weights sw{i}."""
    return f""", g{i} AS (
  SELECT p, v, sum(c.w * s.weight * (1 + 0.1 * ln(n))) AS score, count(*) AS votes, sum(n) AS claims, bool_or(a) AS a, min(leader) AS leader FROM cells c JOIN sw{i} s USING (p, d) GROUP BY p, v
), r{i} AS (
  SELECT *, row_number() OVER (PARTITION BY p ORDER BY round(score, 12) DESC, leader) AS k, sum(score) OVER (PARTITION BY p) AS total, count(*) OVER (PARTITION BY p) AS groups FROM g{i}
), m{i} AS (
  SELECT p, max(v) FILTER (k = 1) AS winner, max(votes) FILTER (k = 1) AS votes, bool_or(a) FILTER (k = 1) AS a_in, coalesce(bool_or(a) FILTER (k > 1), FALSE) AS a_against, max(groups) AS groups,
         (max(score) FILTER (k = 1) - coalesce(max(score) FILTER (k = 2), 0)) / max(total) AS margin FROM r{i} GROUP BY p
), f{i} AS (
  SELECT *, least(0.99, 0.5 + 0.5 * margin) * CASE WHEN votes >= 2 OR a_in THEN 1.0 ELSE 0.8 END AS conf, a_in AND NOT a_against AND margin >= 0.3 AS by_a,
         votes >= 2 AND margin >= 0.6 AND NOT a_against AS by_votes, groups = 1 AND votes = 1 AS single FROM m{i}
), dec{i} AS (
  SELECT p, winner, votes, margin, CASE WHEN by_a OR by_votes THEN 'verified' WHEN single THEN 'single_source' ELSE 'conflict' END AS status,
         CASE WHEN by_a THEN greatest(conf, CASE WHEN votes >= 2 THEN 0.9 ELSE 0.86 END) WHEN by_votes THEN greatest(conf, 0.85) WHEN single THEN least(conf, 0.8) ELSE conf * 0.6 END AS confidence,
         CASE WHEN by_a AND votes = 1 THEN 'tier_a_override' ELSE 'weighted_vote' END AS method FROM f{i}
)"""


def next_weights_sql(i: int) -> str:
    return f""", y{i} AS (
  SELECT c.p, c.d, sum(CASE WHEN c.v = x.winner THEN n ELSE 0 END) AS yes, sum(n) AS every FROM cells c JOIN dec{i} x ON c.p = x.p AND x.status <> 'conflict' GROUP BY c.p, c.d
), n{i} AS (
  SELECT s.*, CASE WHEN every IS NOT NULL AND NOT settled THEN 2 * (1 + yes) / CAST(2 + every AS DOUBLE) ELSE weight END AS new FROM sw{i} s LEFT JOIN y{i} USING (p, d)
), t{i} AS (SELECT p, max(abs(new - weight)) < 1e-3 AS stop FROM n{i} GROUP BY p),
sw{i + 1} AS (SELECT p, d, CASE WHEN stop THEN weight ELSE new END AS weight, settled OR stop AS settled FROM n{i} JOIN t{i} USING (p))"""


def supplier_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation is a product; its suppliers are pages of eight facts that depend on the supplier's key by thirds."""
    s = table(spark, sf_dir, "supplier")
    facts = F.explode(F.sequence(F.lit(1), F.lit(8)))
    return s.select(F.col("s_nationkey").cast("string").alias("product_id"), F.concat(F.lit("https://w"), F.col("s_suppkey").cast("string"), F.lit(".example/p")).alias("url"),
                    F.concat(F.lit("w"), F.col("s_suppkey").cast("string"), F.lit(".example")).alias("domain"), "s_suppkey", facts.alias("i")).select(
        "product_id", "url", "domain", F.concat(F.lit("f"), "i").alias("field"), F.concat(F.lit("value "), (F.col("s_suppkey") % 3 * 100 + F.col("i")).cast("string")).alias("raw"), F.col("i").cast("long").alias("ord"))
