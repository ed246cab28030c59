"""Overrides, repair and download plans, and byte keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardlore.functions import naming
from shardlore.operators import placement
from shardlore.plans.changes import PGS, SLOTS, _placed
from shardlore.plans.domain import files, nodes, shards
from shardlore.plans.registry import query


@query(f"""WITH {_placed('p')},
o AS (SELECT pg, pos, uid FROM (SELECT CAST(pg AS BIGINT) AS pg, unnest(range(0, 8)) AS pos, pg * 3 + 1 + unnest(range(0, 8)) AS uid FROM (SELECT unnest(range(0, {PGS}, 8)) AS pg)) WHERE uid IN (SELECT uid FROM nodes WHERE uid % 10 <> 3)),
g AS (SELECT pg, row_number() OVER (PARTITION BY pg ORDER BY pos) - 1 AS slot, uid, count(*) OVER (PARTITION BY pg) AS n FROM o)
SELECT CAST(pg AS BIGINT) AS pg, slot, uid FROM p WHERE pg NOT IN (SELECT pg FROM g WHERE n >= {SLOTS}) UNION ALL SELECT pg, slot, uid FROM g WHERE n >= {SLOTS} AND slot < {SLOTS}""")
def pg_overrides(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    groups = spark.range(0, PGS, 8).withColumnRenamed("id", "pg")
    uids = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.col("pg") * 3 + 1 + k)
    return placement.with_overrides(placement.group_placement(n, PGS, SLOTS), groups.select("pg", uids.alias("uids")), n.filter("uid % 10 <> 3"), SLOTS)


@query("""
WITH f AS (SELECT file_id, file_id % 3 AS stripe, idx, uid, part % 50 AS epoch FROM shards),
b AS (SELECT file_id, stripe, idx, arg_max(uid, (epoch, -uid)) AS uid FROM f GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY file_id, stripe ORDER BY idx) AS turn, count(*) OVER (PARTITION BY file_id, stripe) AS n FROM b)
SELECT file_id, stripe, idx, uid, n >= 3 AS repairable FROM r WHERE turn <= 3""")
def repair_plan(spark: SparkSession, d: str) -> DataFrame:
    """The shards to repair each stripe of all files from."""
    found = shards(spark, d).select("file_id", (F.col("file_id") % 3).alias("stripe"), "idx", "uid", (F.col("part") % 50).alias("epoch"))
    pieces = files(spark, d).select("file_id", (F.col("file_id") % 3).alias("stripe"))
    return placement.repair_plan(pieces, found, 3)


@query("""
WITH q AS (SELECT file_id, file_id % 7 * 1000 AS start, file_id % 7 * 1000 + 2500 AS stop FROM files),
s AS (SELECT file_id, unnest(range(start // 2000, stop // 2000 + 1)) AS stripe FROM q),
o AS (SELECT DISTINCT file_id, idx % 4 AS stripe, idx, uid FROM shards WHERE uid % 9 <> 4),
m AS (SELECT s.file_id, s.stripe, idx, uid, row_number() OVER (PARTITION BY s.file_id, s.stripe ORDER BY CASE WHEN uid % 3 > 0 THEN uid % 100 END NULLS LAST, idx, uid) AS turn FROM s JOIN o USING (file_id, stripe))
SELECT file_id, stripe, idx, uid FROM m WHERE turn <= 2""")
def download_plan(spark: SparkSession, d: str) -> DataFrame:
    """The shards to read a range of each file from."""
    low = F.col("file_id") % 7 * 1000
    requests = files(spark, d).select("file_id", low.alias("start"), (low + 2500).alias("stop"))
    owners = shards(spark, d).select("file_id", (F.col("idx") % 4).alias("stripe"), "idx", "uid").distinct()
    n = nodes(spark, d).select("uid")
    known = n.filter("uid % 3 > 0").select("uid", (F.col("uid") % 100).alias("ms"))
    return placement.download_plan(requests, owners, known, n.filter("uid % 9 = 4"), 2, 2000)


@query("""SELECT file_id, lower(hex(unhex(substr(file_hash, 1, 64)))) = file_hash AS whole, sha256('seed|' || file_id || '|' || epoch) AS seed, substr(file_hash, 1, 12) AS short FROM files""")
def byte_keys(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("file_hash")
    return files(spark, d).select(
        "file_id", (F.lower(F.hex(naming.account_bytes(h))) == h).alias("whole"), naming.seed("seed", F.col("file_id"), F.col("epoch")).alias("seed"), naming.truncated(h, 12).alias("short")
    )
