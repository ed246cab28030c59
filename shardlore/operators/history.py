"""Epoch histories, submissions and configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
DEFAULTS = {"pg_count": 16384, "ec_k": 10, "ec_m": 20}
MAX_JUMP = 100


def chained(epochs: DataFrame) -> DataFrame:
    """Each epoch with whether it follows its predecessor: ok, gap, or broken. epochs: epoch, hash, previous. One row per epoch, so a cluster's history is short."""
    before = epochs.select((F.col("epoch") + 1).alias("epoch"), F.col("hash").alias("expected"))
    joined = epochs.join(before, "epoch", "left")
    state = F.when(F.col("expected").isNull(), "gap").when(F.col("previous").eqNullSafe(F.col("expected")), "ok").otherwise("broken")
    return joined.select("epoch", state.alias("state"))


def acceptable(maps: DataFrame, last: Column, jump: int = MAX_JUMP) -> DataFrame:
    """Maps newer than the last one that don't jump too far."""
    return maps.filter((F.col("epoch") > last) & (F.col("epoch") <= last + jump))


def submission(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Per epoch: whether uids ascend strictly in the submitted order, and how many rows aren't actively registered in their family.

    rows: epoch, position, uid, family; registry: uid, family, active.
    """
    w = Window.partitionBy("epoch").orderBy("position")
    known = registry.filter("active").select("uid", "family", F.lit(True).alias("known"))
    checked = rows.withColumn("rises", F.coalesce(F.col("uid") > F.lag("uid").over(w), F.lit(True))).join(known, ["uid", "family"], "left")
    return checked.groupBy("epoch").agg(F.every("rises").alias("ascending"), F.count_if(F.col("known").isNull()).alias("unregistered"))


def probing(version: Column) -> Column:
    """Placement versions to try, the tagged one first."""
    v = version.cast("int")
    return F.when(v == 3, F.array(F.lit(3), F.lit(2), F.lit(1))).when(v == 2, F.array(F.lit(2), F.lit(1))).when(v == 1, F.array(F.lit(1), F.lit(2))).otherwise(
        F.array_distinct(F.array(v, F.lit(2), F.lit(1)))
    )


def with_defaults(config: DataFrame) -> DataFrame:
    """Zeros replaced by the defaults; the number of groups rounded up to a power of two."""
    out = config
    for name, value in DEFAULTS.items():
        out = out.withColumn(name, F.when(F.coalesce(F.col(name), F.lit(0)) == 0, value).otherwise(F.col(name)))
    return out.withColumn("pg_count", F.pow(F.lit(2.0), F.ceil(F.log2("pg_count"))).cast("bigint"))


def sources(nodes: DataFrame, validator: Column) -> DataFrame:
    """Where to sync from: the validator first, then seeders by uid."""
    rank = F.when(validator, 0).when(F.col("seeder"), 1)
    return nodes.withColumn("rank", rank).filter("rank is not null").withColumn("place", F.row_number().over(Window.orderBy("rank", "uid")).cast("bigint"))


def recovered(progress: DataFrame) -> DataFrame:
    """Upload progress after a restart: what was still processing has failed."""
    return progress.withColumn("status", F.when(F.col("status") == "Processing", "Failed: Interrupted").otherwise(F.col("status")))


def allowed(pubkey: Column, allow: list[str]) -> Column:
    """An empty list allows everybody."""
    return pubkey.isin(*allow) if allow else F.lit(True)


def resting(nodes: DataFrame, until: DataFrame, now: DataFrame) -> DataFrame:
    """Whether each node still rests: now is before the moment until which it does. until: uid, until; now: one row."""
    joined = nodes.join(until, "uid", "left").join(F.broadcast(now))  # now is one row
    return joined.select("uid", F.coalesce(F.col("now") < F.col("until"), F.lit(False)).alias("resting"))


def sync_index(files: DataFrame) -> DataFrame:
    """One row that tells a set of files from another: their number, bytes, an order-free digest of hashes and sizes, and the newest epoch.

    files: file_hash, size, epoch. The list itself stays a table; see sources.sinks.append_epoch.
    """
    each = F.conv(F.substring(F.sha2(F.concat_ws(":", "file_hash", F.col("size").cast("string")), 256), 1, 15), 16, 10).cast("bigint")
    return files.agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.bit_xor(each).alias("digest"), F.max("epoch").alias("epoch"))


def needs_rebuild(listed: DataFrame, known: DataFrame) -> bool:
    """Whether an index holds less than nine tenths of the files listed."""
    return known.count() * 10 < listed.count() * 9
