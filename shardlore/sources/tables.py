"""Readers. Columns and filters reach the files, since everything above them is declared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRIPE = T.StructType([T.StructField("size", T.LongType()), T.StructField("k", T.IntegerType()), T.StructField("m", T.IntegerType())])
SHARD = T.StructType([T.StructField("index", T.IntegerType()), T.StructField("blob_hash", T.StringType())])
MANIFEST = T.StructType(
    [
        T.StructField("file_hash", T.StringType()),
        T.StructField("placement_version", T.IntegerType()),
        T.StructField("placement_epoch", T.LongType()),
        T.StructField("size", T.LongType()),
        T.StructField("stripe", STRIPE),
        T.StructField("shards", T.ArrayType(SHARD)),
        T.StructField("filename", T.StringType()),
        T.StructField("content_type", T.StringType()),
    ]
)
#: Keys of a key-value dump that hold no manifest. Fixed values.
RESERVED = ("cluster_map", "sync_index", "blacklist", "cooldowns")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def manifests(pairs: DataFrame) -> DataFrame:
    """Manifests out of (key, value) rows: reserved keys, tombstones and values of another shape are left out.

    Missing optional fields get their defaults; a manifest with more shards than its stripes hold is refused.
    """
    reserved = F.lit(False)
    for prefix in RESERVED:
        reserved = reserved | F.col("key").startswith(prefix)
    parsed = pairs.filter(~reserved & (F.col("value") != "DELETED")).select("key", F.from_json("value", MANIFEST).alias("m"))
    good = parsed.filter(F.col("m.file_hash").isNotNull() & F.col("m.size").isNotNull())
    stripe = F.coalesce("m.stripe.size", F.lit(8 << 20))
    each = F.coalesce("m.stripe.k", F.lit(10)) + F.coalesce("m.stripe.m", F.lit(20))
    most = F.greatest(F.ceil(F.col("m.size") / stripe), F.lit(1)) * each
    return good.filter(F.coalesce(F.size("m.shards"), F.lit(0)) <= most).select(
        "key",
        F.col("m.file_hash").alias("file_hash"),
        F.col("m.size").alias("size"),
        F.coalesce("m.placement_version", F.lit(1)).alias("placement_version"),
        F.coalesce("m.placement_epoch", F.lit(0)).cast("bigint").alias("placement_epoch"),
        F.col("m.shards").alias("shards"),
    )


def blobs(spark: SparkSession, folder: str) -> DataFrame:
    """hash and bytes of every .bin file below a folder, in the flat or the two-level layout; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.bin").load(folder)
    return found.select(F.regexp_extract("path", r"([^/]+)\.bin$", 1).alias("hash"), F.col("length").alias("bytes"))


def family_pages(pages: DataFrame) -> DataFrame:
    """node and family out of (family, main_node, child_nodes) rows."""
    nodes = F.array_compact(F.concat(F.array("main_node"), F.coalesce("child_nodes", F.array().cast("array<string>"))))
    return pages.select("family", F.explode(nodes).alias("node")).distinct()


def newest(rows: DataFrame, block: str = "at_block") -> DataFrame:
    """The rows of the newest block; none without a block."""
    last = rows.agg(F.max(block).alias("__newest"))
    return rows.join(F.broadcast(last), F.col(block) == F.col("__newest")).drop("__newest")  # last is one row


def snapshots(spark: SparkSession, folder: str, schema: T.StructType, block: str = "at_block") -> DataFrame:
    """Registry snapshots as JSON with a given schema; the newest block wins. Rows that don't parse are left out."""
    return newest(spark.read.schema(schema).option("mode", "DROPMALFORMED").json(folder), block)
