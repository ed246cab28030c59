"""Cluster statistics, listings and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shardlore.functions import naming, scoring
from shardlore.operators import cluster

from shardlore.plans.domain import GROUPS, NOW, files, hash60, nodes, reports, shards
from shardlore.plans.registry import query
from shardlore.sources import sinks, tables

K = 4


@query("""
SELECT n.uid, CAST(count(s.uid) AS BIGINT) AS shard_count, CAST(coalesce(sum(s.bytes), 0) AS BIGINT) AS stored_bytes
FROM nodes n LEFT JOIN shards s ON s.uid = n.uid GROUP BY n.uid""")
def network_stats(spark: SparkSession, d: str) -> DataFrame:
    return cluster.node_totals(nodes(spark, d), shards(spark, d))


@query("""
SELECT CAST((SELECT count(*) FROM nodes) AS BIGINT) AS n_nodes, CAST((SELECT count(*) FROM shards) AS BIGINT) AS n_shards,
  CAST((SELECT sum(bytes) FROM shards) AS BIGINT) AS stored_bytes, CAST((SELECT sum(weight) FROM nodes) AS BIGINT) AS total_weight,
  CAST((SELECT sum(CAST(trunc(value * 100) AS BIGINT)) FROM reports) AS BIGINT) AS moved""")
def network_totals(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d).agg(F.count("*").alias("n_nodes"), F.sum("weight").alias("total_weight"))
    s = shards(spark, d).agg(F.count("*").alias("n_shards"), F.sum("bytes").alias("stored_bytes"))
    r = reports(spark, d).agg(F.sum((F.col("value") * 100).cast("bigint")).alias("moved"))
    return n.join(s).join(r)  # one row each


@query("""
WITH st AS (SELECT uid, count(*) AS n, sum(bytes) AS b FROM shards GROUP BY uid)
SELECT n.uid, CAST(c_custkey AS BIGINT) AS child, CAST(coalesce(st.n, 0) AS BIGINT) AS shard_count, CAST(coalesce(st.b, 0) AS BIGINT) AS stored_bytes,
  CASE WHEN greatest(1000000 - last_seen, 0) > 120 THEN 0 ELSE 1000 END AS uptime_permille
FROM nodes n JOIN customer ON c_custkey = n.uid LEFT JOIN st ON st.uid = n.uid""")
def quality_join(spark: SparkSession, d: str) -> DataFrame:
    registry = tables.read(spark, d, "customer").select(F.col("c_custkey").alias("child"))
    held = cluster.totals_by_holder(shards(spark, d))
    n = nodes(spark, d)
    return n.join(registry, n.uid == registry.child).join(held, "uid", "left").select(
        "uid", "child",
        F.coalesce("shard_count", F.lit(0)).alias("shard_count"),
        F.coalesce("stored_bytes", F.lit(0)).alias("stored_bytes"),
        F.when(scoring.is_offline(F.col("last_seen"), NOW), 0).otherwise(1000).alias("uptime_permille"),
    )


@query(f"""
SELECT s.file_id, s.idx, s.uid, n.family, CASE WHEN s.idx <= {K} THEN 'DATA' ELSE 'PARITY' END AS kind, nu.holders, nu.families
FROM shards s JOIN nodes n USING (uid) JOIN (
  SELECT file_id, CAST(count(DISTINCT uid) AS BIGINT) AS holders, CAST(count(DISTINCT family) AS BIGINT) AS families FROM shards JOIN nodes USING (uid) GROUP BY file_id) nu USING (file_id)""")
def file_shard_detail(spark: SparkSession, d: str) -> DataFrame:
    return cluster.shard_detail(shards(spark, d), nodes(spark, d), K)


@query("""
SELECT uid, CAST(count(*) AS BIGINT) AS n, md5(string_agg(file_id || ':' || idx, ',' ORDER BY file_id, idx, part)) AS digest FROM shards GROUP BY uid""")
def holder_shard_lists(spark: SparkSession, d: str) -> DataFrame:
    lists = cluster.lists_by_holder(shards(spark, d))
    joined = F.array_join(F.transform("held", lambda x: F.concat_ws(":", x["file_id"].cast("string"), x["idx"].cast("string"))), ",")
    return lists.select("uid", F.size("held").cast("bigint").alias("n"), F.md5(joined).alias("digest"))


@query(f"""
SELECT pg, (k - 1) // 1000 AS page, CAST(count(*) AS BIGINT) AS n_files, md5(string_agg(file_hash, '' ORDER BY file_hash)) AS digest FROM (
  SELECT pg, file_hash, row_number() OVER (PARTITION BY pg ORDER BY file_hash) AS k FROM (SELECT DISTINCT {hash60('file_hash')} % {GROUPS} AS pg, file_hash FROM files)) GROUP BY 1, 2""")
def pg_index(spark: SparkSession, d: str) -> DataFrame:
    index = cluster.group_index(files(spark, d), GROUPS)
    return index.select("pg", "page", F.size("files").cast("bigint").alias("n_files"), F.md5(F.array_join("files", "")).alias("digest"))


@query(f"""SELECT file_hash, page FROM (SELECT file_hash, CAST((row_number() OVER (ORDER BY file_hash) - 1) // 10 AS BIGINT) AS page
FROM files WHERE {hash60('file_hash')} % {GROUPS} = 7) WHERE page < 3""")
def pg_files_limit(spark: SparkSession, d: str) -> DataFrame:
    return cluster.group_pages(files(spark, d), GROUPS, 7, page_size=10, pages=3)


@query("""SELECT doc_id FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 200""", views=False)
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    return cluster.keyset_page(tables.read(spark, d, "documents").select("doc_id"), "doc_id", 100, 200)


@query("""SELECT epoch, CAST(count(*) AS BIGINT) AS n_files, max(file_id) AS newest, arg_max(status, file_id) AS newest_status FROM files GROUP BY epoch""")
def latest_per_epoch(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d)
    counts = f.groupBy("epoch").agg(F.count("*").alias("n_files"))
    last = sinks.latest(f.select("epoch", "file_id", "status"), "epoch", "file_id")
    return counts.join(last, "epoch").select("epoch", "n_files", F.col("file_id").alias("newest"), F.col("status").alias("newest_status"))


@query("""
WITH kv AS (SELECT 'stats:bw:' || uid AS key, CAST(trunc(value * 100) AS BIGINT) AS v FROM reports WHERE uid IS NOT NULL)
SELECT CAST(substr(key, 10) AS BIGINT) AS uid, CAST(sum(v) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS n FROM kv GROUP BY 1""")
def parse_keyed_json(spark: SparkSession, d: str) -> DataFrame:
    """Counters stored as key and JSON value, read back by prefix and schema."""
    r = reports(spark, d).filter("uid is not null")
    pairs = r.select(F.concat(F.lit("stats:bw:"), "uid").alias("key"), F.to_json(F.struct((F.col("value") * 100).cast("bigint").alias("v"))).alias("value"))
    noise = spark.createDataFrame([("cluster_map", "{}"), ("sync_index", "[]"), ("stats:bw:x", "{}")], "key string, value string")
    return cluster.prefixed_counters(pairs.union(noise), "stats:bw:")


@query("""
SELECT file_id, CAST(ceil(size / 8388608.0) AS BIGINT) AS stripes, least(greatest(size - 8388608 * 0, 0), 8388608) AS first_bytes,
  greatest(least(size - 8388608 * (greatest(CAST(ceil(size / 8388608.0) AS BIGINT), 1) - 1), 8388608), 0) AS last_bytes,
  (greatest(least(size - 8388608 * (greatest(CAST(ceil(size / 8388608.0) AS BIGINT), 1) - 1), 8388608), 0) + 9) // 10 AS last_shard_bytes FROM files""")
def stripe_math(spark: SparkSession, d: str) -> DataFrame:
    stripes = F.ceil(F.col("size") / scoring.STRIPE_BYTES)
    last = scoring.stripe_bytes(F.col("size"), F.greatest(stripes, F.lit(1)) - 1)
    return files(spark, d).select(
        "file_id", stripes.cast("bigint").alias("stripes"), scoring.stripe_bytes(F.col("size"), F.lit(0)).alias("first_bytes"),
        last.alias("last_bytes"), scoring.shard_bytes(last).alias("last_shard_bytes"),
    )


@query("""SELECT kind, CAST(count(*) AS BIGINT) AS n FROM reports WHERE kind IN ('error', 'purchase') GROUP BY kind""")
def failure_counts(spark: SparkSession, d: str) -> DataFrame:
    return reports(spark, d).filter(F.col("kind").isin("error", "purchase")).groupBy("kind").agg(F.count("*").alias("n"))


@query("""
SELECT uid, CAST(count(*) AS BIGINT) AS failures, CAST(count(*) FILTER (kind = 'error') AS BIGINT) AS integrity, CAST(count(*) FILTER (kind = 'error') AS BIGINT) AS strikes
FROM reports WHERE kind IN ('error', 'click') GROUP BY uid""")
def failure_reports(spark: SparkSession, d: str) -> DataFrame:
    return cluster.failures(reports(spark, d).filter(F.col("kind").isin("error", "click")), "error")


@query("""SELECT uid, ts // 30 * 30 AS window_start, CAST(sum(CAST(trunc(value * 100) AS BIGINT)) AS BIGINT) AS bytes, CAST(count(*) AS BIGINT) AS n FROM reports GROUP BY 1, 2""")
def bandwidth_windows(spark: SparkSession, d: str) -> DataFrame:
    r = reports(spark, d).withColumn("bytes", (F.col("value") * 100).cast("bigint"))
    w = F.window(F.timestamp_seconds("ts"), "30 seconds")
    return r.groupBy("uid", w.alias("w")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).select("uid", F.unix_timestamp("w.start").alias("window_start"), "bytes", "n")


@query(f"""SELECT uid, greatest({NOW} - last_seen, 0) > 120 AS offline, greatest({NOW} - last_seen, 0) > 600 AS is_out FROM nodes""")
def offline_nodes(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).select(
        "uid", scoring.is_offline(F.col("last_seen"), NOW).alias("offline"), scoring.is_offline(F.col("last_seen"), NOW, scoring.OUT_SECS).alias("is_out")
    )


@query("""SELECT file_id, epoch, epoch > 23970 AS late FROM (SELECT file_id, epoch, row_number() OVER (PARTITION BY epoch ORDER BY file_id) AS k FROM files) WHERE k <= 10""")
def map_history(spark: SparkSession, d: str) -> DataFrame:
    """The first ten entries of each epoch, and whether the epoch is newer than the last one seen."""
    w = Window.partitionBy("epoch").orderBy("file_id")
    f = files(spark, d).withColumn("k", F.row_number().over(w)).filter("k <= 10")
    return f.select("file_id", "epoch", (F.col("epoch") > 23970).alias("late"))


@query("""
SELECT ts // 3600 AS bucket, CAST(count(*) AS BIGINT) AS n FROM reports
WHERE ts // 3600 >= (SELECT max(ts // 3600) FROM reports) - 100 GROUP BY 1""")
def bucket_prune(spark: SparkSession, d: str) -> DataFrame:
    """Buckets within the retention."""
    r = reports(spark, d).withColumn("bucket", scoring.epoch_of(F.col("ts"), 3600))
    newest = r.agg(F.max("bucket").alias("newest"))
    return r.join(F.broadcast(newest)).filter("bucket >= newest - 100").groupBy("bucket").agg(F.count("*").alias("n"))  # newest is one row


@query("""SELECT file_id, file_hash, substr(file_hash, 1, 2) || '/' || substr(file_hash, 3, 2) || '/' || file_hash || '.bin' AS path,
  regexp_matches(file_hash, '^[0-9a-fA-F]{64}$') AS valid, 'cluster_map_epoch:' || epoch AS epoch_key FROM files""")
def storage_keys(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("file_hash")
    return files(spark, d).select("file_id", "file_hash", naming.sharded_path(h).alias("path"), naming.is_file_hash(h).alias("valid"), naming.epoch_key(F.col("epoch")).alias("epoch_key"))


@query("""SELECT CAST(count(*) FILTER (status = 'O') AS BIGINT) AS active, CAST(count(*) AS BIGINT) AS total,
  CAST(count(*) FILTER (status = 'O' AND epoch < 23970) AS BIGINT) AS stale FROM files""")
def upload_progress(spark: SparkSession, d: str) -> DataFrame:
    """Uploads in progress, and those that an interrupted run would mark failed."""
    return files(spark, d).agg(
        F.count_if(F.col("status") == "O").alias("active"), F.count("*").alias("total"), F.count_if((F.col("status") == "O") & (F.col("epoch") < 23970)).alias("stale")
    )


