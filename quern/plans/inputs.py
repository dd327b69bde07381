"""Catalogue-shaped inputs derived from the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as devices: a line is the second word of a name, a modifier its first, the size a generation."""
    p = table(spark, sf_dir, "part")
    word = F.split("p_name", " ")
    support = F.when(F.col("p_type") == "ECONOMY", "not_supported").when(F.col("p_type") == "PROMO", "conditional").otherwise("supported")
    confidence = F.when(F.col("p_size") % 5 == 0, "verified").when(F.col("p_size") % 5 == 1, "quarantined").when(F.col("p_size") % 5 == 2, "unverified").otherwise("derived")
    return p.select(F.col("p_partkey").alias("id"), F.lower("p_brand").alias("brand"), word[1].alias("family"), word[0].alias("modifier"), F.col("p_size").alias("generation"), F.col("p_name").alias("name"), support.alias("support"), confidence.alias("confidence"), F.concat(F.lit("SM-"), (F.col("p_partkey") % 1500).cast("string")).alias("code"), F.col("p_retailprice").alias("price"))


#: devices() in SQL.
DEVICES = """devices AS (
  SELECT p_partkey AS id, lower(p_brand) AS brand, split_part(p_name, ' ', 2) AS family, split_part(p_name, ' ', 1) AS modifier,
    p_size AS generation, p_name AS name,
    CASE p_type WHEN 'ECONOMY' THEN 'not_supported' WHEN 'PROMO' THEN 'conditional' ELSE 'supported' END AS support,
    CASE p_size % 5 WHEN 0 THEN 'verified' WHEN 1 THEN 'quarantined' WHEN 2 THEN 'unverified' ELSE 'derived' END AS confidence,
    'SM-' || CAST(p_partkey % 1500 AS VARCHAR) AS code, p_retailprice AS price FROM part)"""


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as votes of suppliers on devices; the first of each (device, supplier) counts."""
    v = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    said = F.when(F.col("l_quantity") <= 24, "supported").when(F.col("l_quantity") <= 40, "unknown").when(F.col("l_quantity") <= 46, "not_supported").otherwise("conditional")
    return v.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", said.alias("support"))


VOTES = """said AS (
  SELECT l_partkey, l_suppkey, CASE WHEN l_quantity <= 24 THEN 'supported' WHEN l_quantity <= 40 THEN 'unknown'
    WHEN l_quantity <= 46 THEN 'not_supported' ELSE 'conditional' END AS support,
    row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber,
      CASE WHEN l_quantity <= 24 THEN 'supported' WHEN l_quantity <= 40 THEN 'unknown' WHEN l_quantity <= 46 THEN 'not_supported' ELSE 'conditional' END) AS rn FROM lineitem),
votes AS (SELECT l_partkey, l_suppkey, support FROM said WHERE rn = 1)"""
