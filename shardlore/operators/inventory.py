"""What should be held against what is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reconcile(listed: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Every key of a listing and a table, with what has to be done: keep, add or drop."""
    a, b = listed.select(key).distinct().withColumn("a", F.lit(True)), known.select(key).distinct().withColumn("b", F.lit(True))
    action = F.when(F.col("a") & F.col("b"), "keep").when(F.col("a"), "add").otherwise("drop")
    return a.join(b, key, "full_outer").select(key, action.alias("action"))


def missing(expected: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(held, keys, "left_anti")


def purge(trashed: DataFrame, now: int, ttl: int, most_bytes: int) -> DataFrame:
    """Trashed blobs that go: those past the time limit, then the oldest until the rest fits.

    trashed: hash, trashed_at, bytes. Bytes newer than a blob are a running sum by slots of ten minutes, then within the slot, so no task sorts all rows.
    """
    alive = trashed.withColumn("expired", F.lit(now) - F.col("trashed_at") >= ttl)
    slot = F.floor(F.col("trashed_at") / 600)
    left = alive.filter(~F.col("expired")).withColumn("slot", slot)
    slots = left.groupBy("slot").agg(F.sum("bytes").alias("slot_bytes"))
    newer = F.coalesce(F.sum("slot_bytes").over(Window.orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum("bytes").over(Window.partitionBy("slot").orderBy(F.desc("trashed_at"), "hash"))
    kept = left.join(slots.select("slot", newer.alias("newer")), "slot").withColumn("upto", F.col("newer") + inside)
    evicted = kept.filter(F.col("upto") > most_bytes).select("hash", F.lit("size").alias("reason"))
    return alive.filter("expired").select("hash", F.lit("age").alias("reason")).unionByName(evicted)


def needing_recovery(shards: DataFrame, out: DataFrame) -> DataFrame:
    """Files with a shard on a node that is out."""
    return shards.join(out.select("uid"), "uid", "left_semi").select("file_id").distinct()


def survivors(shards: DataFrame, out: DataFrame, k: int) -> DataFrame:
    """Shards left of each damaged file, and whether they suffice to rebuild it."""
    marked = shards.join(out.select("uid", F.lit(True).alias("gone")), "uid", "left")
    counts = marked.groupBy("file_id").agg(F.count_if(F.col("gone").isNull()).alias("alive"), F.count_if("gone").alias("lost"))
    return counts.filter("lost > 0").select("file_id", "alive", "lost", (F.col("alive") >= F.least(F.lit(k), F.col("alive") + F.col("lost"))).alias("repairable"))
