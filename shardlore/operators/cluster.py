"""Cluster operators: who holds what, listings, pages and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardlore.functions import scoring


def totals_by_holder(shards: DataFrame) -> DataFrame:
    """shard_count and stored_bytes of each holder."""
    return shards.groupBy("uid").agg(F.count("*").alias("shard_count"), F.sum("bytes").alias("stored_bytes"))


def node_totals(nodes: DataFrame, shards: DataFrame) -> DataFrame:
    """Shards and bytes per node; nodes that hold nothing are listed with zeros. Shards are summed before the join."""
    return nodes.select("uid").join(totals_by_holder(shards), "uid", "left").select(
        "uid", F.coalesce("shard_count", F.lit(0)).alias("shard_count"), F.coalesce("stored_bytes", F.lit(0)).alias("stored_bytes")
    )


def shard_detail(shards: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Each shard with its holder's family, DATA or PARITY, and its file's numbers of holders and families."""
    held = shards.join(nodes.select("uid", "family"), "uid")
    spread = held.groupBy("file_id").agg(F.count_distinct("uid").alias("holders"), F.count_distinct("family").alias("families"))
    kind = F.when(F.col("idx") <= k, "DATA").otherwise("PARITY")
    return held.join(spread, "file_id").select("file_id", "idx", "uid", "family", kind.alias("kind"), "holders", "families")


def lists_by_holder(shards: DataFrame) -> DataFrame:
    """The ordered shards of each holder."""
    return shards.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("file_id", "idx", "part"))).alias("held"))


def group_index(files: DataFrame, groups: int, page_size: int = 1000) -> DataFrame:
    """The distinct file hashes of each placement group, in order and in pages, so that no value grows with the group.

    Hashes are numbered within the slices of a group that their first three digits make; the slices' sizes, at most 4,096 of a group, are summed before them.
    """
    rows = files.select(scoring.placement_group(F.col("file_hash"), groups).alias("pg"), "file_hash").distinct().withColumn("slice", F.substring("file_hash", 1, 3))
    sizes = rows.groupBy("pg", "slice").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("pg").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("pg", "slice").orderBy("file_hash")) - 1
    placed = rows.withColumn("own", own).join(sizes.select("pg", "slice", before.alias("before")), ["pg", "slice"])
    page = F.floor((F.col("before") + F.col("own")) / page_size)
    return placed.groupBy("pg", page.alias("page")).agg(F.sort_array(F.collect_list("file_hash")).alias("files"))


def group_pages(files: DataFrame, groups: int, group: int, page_size: int, pages: int) -> DataFrame:
    """The first pages of one group's ordered files; only that group is sorted, and only as far as needed."""
    mine = files.filter(scoring.placement_group(F.col("file_hash"), groups) == group).select("file_hash")
    first = mine.orderBy("file_hash").limit(page_size * pages)
    return first.select("file_hash", F.floor((F.row_number().over(Window.orderBy("file_hash")) - 1) / page_size).alias("page"))


def keyset_page(rows: DataFrame, key: str, after, size: int, most: int = 200_000) -> DataFrame:
    """The next rows after a key."""
    return rows.filter(F.col(key) > after).orderBy(key).limit(min(max(size, 1), most))


def prefixed_counters(pairs: DataFrame, prefix: str) -> DataFrame:
    """Sum of the counters under a key prefix, by the rest of the key; rests that are no number are left out."""
    mine = pairs.filter(F.col("key").startswith(prefix))
    uid = F.substr("key", F.lit(len(prefix) + 1)).try_cast("bigint")
    value = F.from_json("value", "v bigint")["v"]
    return mine.select(uid.alias("uid"), value.alias("v")).filter("uid is not null and v is not null").groupBy("uid").agg(F.sum("v").alias("total"), F.count("*").alias("n"))


def failures(reports: DataFrame, integrity: str) -> DataFrame:
    """Failures of each node, and how many of them were of integrity and so raise a strike."""
    bad = F.count_if(F.col("kind") == integrity)
    return reports.groupBy("uid").agg(F.count("*").alias("failures"), bad.alias("integrity"), bad.alias("strikes"))


def from_cursor(rows: DataFrame, order: list[str], cursor: int, size: int, width: int = 4096) -> DataFrame:
    """`size` rows from a cursor in the ordered list, around its end.

    The first column of the order is a number: slices of `width` of it are counted, the counts are summed (one row for each slice), and only
    rows of the slices that the wanted places lie in are sorted.
    """
    sliced = rows.withColumn("__slice", F.floor(F.col(order[0]) / width))
    counts = sliced.groupBy("__slice").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.withColumns({"__before": before, "__all": F.sum("__n").over(Window.partitionBy())})
    # Places of a slice, from the cursor: it is wanted if it begins among the wanted ones, or holds the cursor.
    ahead = F.pmod(F.col("__before") - cursor, F.col("__all"))
    wanted = placed.filter((ahead < size) | (ahead + F.col("__n") > F.col("__all")))
    number = F.col("__before") + F.row_number().over(Window.partitionBy("__slice").orderBy(*order)) - 1
    found = sliced.join(wanted.drop("__n"), "__slice").withColumn("__rn", number)
    return found.filter(F.pmod(F.col("__rn") - cursor, F.col("__all")) < size).drop("__slice", "__before", "__all", "__rn")
