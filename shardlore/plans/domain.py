"""The cluster's tables as views of the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardlore.functions import scoring
from shardlore.sources import tables

#: The moment the cluster is looked at, in seconds.
NOW = 1_000_000
GROUPS = 256


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, family, weight, storage, liveness and strikes of each node."""
    s = tables.read(spark, sf_dir, "supplier")
    uid = F.col("s_suppkey")
    total = (1 + uid % 120) * F.lit(scoring.GIB)
    return s.select(
        uid.alias("uid"),
        F.col("s_nationkey").cast("bigint").alias("family"),
        scoring.between(F.col("s_acctbal").cast("bigint"), 10, 2000).alias("weight"),
        total.alias("total_storage"),
        (total * (uid % 11) / 10).cast("bigint").alias("available_storage"),
        (uid % 17 == 0).alias("draining"),
        (F.lit(NOW) - uid * 13 % 1000).alias("last_seen"),
        (F.lit(NOW) - uid * 7919 % 200_000).alias("registered"),
        (uid * 101 % 3000).alias("heartbeats"),
        (uid % 4).alias("strikes"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, owner, 64-digit hash, size in bytes and cluster epoch of each file."""
    o = tables.read(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("file_id"),
        F.col("o_custkey").alias("owner"),
        F.sha2(F.col("o_orderkey").cast("string"), 256).alias("file_hash"),
        (F.col("o_totalprice") * 1000).cast("bigint").alias("size"),
        (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("bigint").alias("epoch"),
        F.col("o_orderstatus").alias("status"),
    )


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, idx, holder uid and bytes of each shard."""
    li = tables.read(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("file_id"),
        F.col("l_linenumber").cast("bigint").alias("idx"),
        F.col("l_suppkey").alias("uid"),
        F.col("l_quantity").cast("bigint").alias("bytes"),
        F.col("l_partkey").alias("part"),
        F.col("l_returnflag").alias("flag"),
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports about nodes: id, second, uid, kind and value."""
    e = tables.read(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.unix_timestamp(F.date_trunc("second", "ts")).alias("ts"),
        F.col("user_id").alias("uid"),
        F.col("event_type").alias("kind"),
        "value",
        "props",
    )


SQL = f"""
WITH nodes AS (
  SELECT s_suppkey AS uid, CAST(s_nationkey AS BIGINT) AS family, least(greatest(CAST(trunc(s_acctbal) AS BIGINT), 10), 2000) AS weight,
    (1 + s_suppkey % 120) * {scoring.GIB} AS total_storage,
    CAST(trunc((1 + s_suppkey % 120) * {scoring.GIB} * (s_suppkey % 11) / 10) AS BIGINT) AS available_storage,
    s_suppkey % 17 = 0 AS draining, {NOW} - s_suppkey * 13 % 1000 AS last_seen, {NOW} - s_suppkey * 7919 % 200000 AS registered,
    s_suppkey * 101 % 3000 AS heartbeats, s_suppkey % 4 AS strikes
  FROM supplier),
files AS (
  SELECT o_orderkey AS file_id, o_custkey AS owner, sha256(CAST(o_orderkey AS VARCHAR)) AS file_hash, CAST(trunc(o_totalprice * 1000) AS BIGINT) AS size,
    CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS epoch, o_orderstatus AS status
  FROM orders),
shards AS (
  SELECT l_orderkey AS file_id, CAST(l_linenumber AS BIGINT) AS idx, l_suppkey AS uid, CAST(trunc(l_quantity) AS BIGINT) AS bytes, l_partkey AS part,
    l_returnflag AS flag
  FROM lineitem),
reports AS (
  SELECT event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, user_id AS uid, event_type AS kind, value, props FROM events)
"""


def hash60(sql: str) -> str:
    """The SQL of functions.scoring.portable_hash."""
    return f"CAST('0x' || substr(sha256({sql}), 1, 15) AS BIGINT)"
