"""Queries beyond SQL: exact placement, erasure coding, bundle checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardlore.functions import codec, exact
from shardlore.operators import merkle
from shardlore.plans.domain import nodes, shards
from shardlore.plans.registry import query
from shardlore.sources import tables


def _exact(spark: SparkSession, d: str, method) -> DataFrame:
    groups = spark.range(256).select(F.concat(F.lit("pg:"), F.col("id").cast("string")).alias("name"), F.lit(0).alias("stripe"))
    return exact.placements(groups.repartition(8), nodes(spark, d).filter("not draining"), 6, method)


@query()
def placement_exact(spark: SparkSession, d: str) -> DataFrame:
    """Straw placement of the placement groups."""
    return _exact(spark, d, exact.Straws)


@query()
def placement_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Weighted-wheel placement of the placement groups."""
    return _exact(spark, d, exact.Wheel)


@query("SELECT doc_id AS id, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS digest FROM documents", views=False)
def stripe_codec(spark: SparkSession, d: str) -> DataFrame:
    """Every document by the way of its shards."""
    return _recoded(tables.read(spark, d, "documents"))


def _recoded(docs: DataFrame) -> DataFrame:
    """Texts encoded to 4 + 2 shards, two of them lost, and decoded again."""
    data = docs.select(F.col("doc_id").alias("id"), F.encode("text", "UTF-8").alias("data"))
    left = codec.encode_stripes(data, 4, 2).filter((F.col("idx") != F.col("id") % 6) & (F.col("idx") != (F.col("id") + 2) % 6))
    back = codec.decode_stripes(left, data.select("id", F.octet_length("data").alias("size")), 4, 2)
    return back.select("id", F.octet_length("data").cast("bigint").alias("size"), F.sha2("data", 256).alias("digest"))


@query("SELECT file_id, true AS sound, CAST(count(*) AS BIGINT) AS leaves FROM (SELECT DISTINCT file_id, idx FROM shards) GROUP BY file_id")
def bundle_verify(spark: SparkSession, d: str) -> DataFrame:
    """Every leaf's proof against its bundle's root."""
    s = shards(spark, d).select("file_id", "idx").distinct()
    leaf = F.sha2(F.concat_ws(":", F.col("file_id").cast("string"), F.col("idx").cast("string")), 256)
    lists = s.withColumn("h", leaf).groupBy("file_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "h"))), lambda x: F.unhex(x["h"])).alias("leaves"))
    rooted = lists.withColumn("root", merkle.root(F.col("leaves")))
    each = rooted.select("file_id", "root", "leaves", F.posexplode("leaves").alias("at", "leaf"))
    checked = each.select("file_id", merkle.verify(F.col("leaf"), merkle.proof(F.col("leaves"), F.col("at")), F.col("root")).alias("ok"))
    return checked.groupBy("file_id").agg(F.every("ok").alias("sound"), F.count("*").alias("leaves"))
