"""Scores, folds, sampling and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardlore.functions import scoring
from shardlore.operators import cluster, folds, merkle
from shardlore.plans.domain import NOW, files, nodes, reports, shards
from shardlore.plans.registry import query
from shardlore.sources import tables

RESULT = "CASE kind WHEN 'error' THEN 'Failed' WHEN 'purchase' THEN 'Timeout' ELSE 'Passed' END"


def _audits(spark: SparkSession, d: str) -> DataFrame:
    result = F.when(F.col("kind") == "error", "Failed").when(F.col("kind") == "purchase", "Timeout").otherwise("Passed")
    return reports(spark, d).withColumn("result", result)


@query(f"""
SELECT uid, n, round(least(greatest(CASE WHEN due = 0 OR elapsed < 60 THEN 1.0 ELSE CAST(n AS DOUBLE) / due END, 0.0), 1.0), 6) AS score,
  CASE WHEN s >= 0.95 THEN 1.5 WHEN s >= 0.8 THEN 1.2 WHEN s >= 0.5 THEN 1.0 ELSE 0.5 END AS multiplier
FROM (SELECT *, least(greatest(CASE WHEN due = 0 OR elapsed < 60 THEN 1.0 ELSE CAST(n AS DOUBLE) / due END, 0.0), 1.0) AS s FROM (
  SELECT uid, CAST(count(*) AS BIGINT) AS n, max(ts) - min(ts) AS elapsed, (max(ts) - min(ts)) // 30 AS due FROM reports GROUP BY uid))""")
def uptime_score(spark: SparkSession, d: str) -> DataFrame:
    seen = reports(spark, d).groupBy("uid").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    score = scoring.uptime_score(F.col("n"), F.col("first"), F.col("last"))
    return seen.select("uid", "n", F.round(score, 6).alias("score"), scoring.uptime_multiplier(score).alias("multiplier"))


_UPTIME = f"""least(greatest(CASE WHEN registered = 0 OR greatest({NOW} - registered, 0) < 60 OR greatest({NOW} - registered, 0) // 30 = 0 THEN 1.0
  ELSE CAST(heartbeats AS DOUBLE) / (greatest({NOW} - registered, 0) // 30) END, 0.0), 1.0)"""


_WEIGHT = f"""
w0 AS (SELECT *, {_UPTIME} AS up, CASE WHEN total_storage = 0 THEN 0 ELSE 1.0 - CAST(available_storage AS DOUBLE) / total_storage END AS used FROM nodes),
w AS (SELECT *, CASE WHEN uid % 13 = 0 THEN weight ELSE least(greatest(CAST(floor(
  least(greatest((total_storage // {scoring.GIB}) * 10.0, 10.0), 1000.0) * CASE WHEN up >= 0.95 THEN 1.5 WHEN up >= 0.8 THEN 1.2 WHEN up >= 0.5 THEN 1.0 ELSE 0.5 END
  * CASE WHEN total_storage = 0 THEN 1.0 WHEN used < 0.5 THEN 1.2 WHEN used < 0.75 THEN 1.0 WHEN used < 0.9 THEN 0.8 ELSE 0.5 END
  * least(0.5 + 0.5 * greatest({NOW} - registered, 0) / 86400.0, 1.0)) AS BIGINT), 10), 2000) END AS new_weight FROM w0)"""


def _weighed(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    new = scoring.node_weight(c("total_storage"), c("available_storage"), c("heartbeats"), c("registered"), NOW, c("uid") % 13 == 0, c("weight"))
    return nodes(spark, d).withColumn("new_weight", new)


@query(f"""WITH {_WEIGHT} SELECT uid, new_weight, round(least(greatest(exp(-0.767 * strikes), 0.1), 1.0), 6) AS reputation,
  CASE strikes WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.5 ELSE 0.1 END AS strike_multiplier FROM w""")
def node_weight(spark: SparkSession, d: str) -> DataFrame:
    strikes = F.col("strikes")
    return _weighed(spark, d).select(
        "uid", "new_weight", F.round(scoring.reputation_multiplier(strikes), 6).alias("reputation"), scoring.strike_multiplier(strikes).alias("strike_multiplier")
    )


@query(f"""WITH {_WEIGHT} SELECT uid, weight, new_weight FROM w WHERE abs(new_weight - weight) * 100 // greatest(weight, 1) >= 20""")
def weight_changes(spark: SparkSession, d: str) -> DataFrame:
    change = F.floor(F.abs(F.col("new_weight") - F.col("weight")) * 100 / F.greatest("weight", F.lit(1)))
    return _weighed(spark, d).filter(change >= 20).select("uid", "weight", "new_weight")


@query(f"""
WITH st AS (SELECT uid, sum(bytes) AS b FROM shards GROUP BY uid)
SELECT n.uid, greatest(least(((length(bin(total_storage + 1)) - 1) * 500 + (length(bin(CAST(coalesce(b, 0) AS BIGINT) + 1)) - 1) * 500) // 1000 * 100, 65535)
  * CASE WHEN greatest({NOW} - last_seen, 0) > 120 THEN 0 ELSE 1000 END // 1000 - least(strikes * 50 + uid % 3 * 100, 65535), 0) AS quality
FROM nodes n LEFT JOIN st USING (uid)""")
def node_quality_weight(spark: SparkSession, d: str) -> DataFrame:
    held = cluster.node_totals(nodes(spark, d), shards(spark, d))
    up = F.when(scoring.is_offline(F.col("last_seen"), NOW), 0).otherwise(1000)
    quality = scoring.quality_weight(F.col("total_storage"), F.col("stored_bytes"), up, F.col("strikes"), F.col("uid") % 3)
    return nodes(spark, d).join(held, "uid").select("uid", quality.alias("quality"))


_FOLD = """
WITH RECURSIVE r AS (SELECT family, w, row_number() OVER (PARTITION BY family ORDER BY w DESC) AS k FROM (SELECT family, least(weight, 1500) AS w FROM nodes) WHERE w > 0),
f AS (SELECT family, k, CAST(1000 AS BIGINT) AS factor, CAST(w AS BIGINT) AS total FROM r WHERE k = 1
  UNION ALL SELECT f.family, r.k, f.factor * 800 // 1000, CAST(f.total + r.w * (f.factor * 800 // 1000) // 1000 AS BIGINT) FROM f JOIN r ON r.family = f.family AND r.k = f.k + 1 WHERE r.k <= 5),
t AS (SELECT family, least(max(total), 10000) AS raw FROM f GROUP BY family)"""


@query(_FOLD.replace("WITH RECURSIVE", "WITH") + " SELECT family, raw FROM t")
def family_weight_topn(spark: SparkSession, d: str) -> DataFrame:
    weights = nodes(spark, d).withColumn("w", F.least("weight", F.lit(1500))).filter("w > 0").groupBy("family").agg(F.collect_list("w").alias("ws"))
    return weights.select("family", scoring.ranked_sum(F.col("ws")).alias("raw"))


@query(_FOLD.replace("WITH RECURSIVE", "WITH") + """
SELECT family, least(least(greatest((1000 * 700 + greatest(raw, 200) * 300) // 1000, 900), 1100), 10000) AS weight FROM t WHERE family % 2 = 0""")
def family_weight_smooth(spark: SparkSession, d: str) -> DataFrame:
    """Only touched families; a newcomer's floor first, then the moving average, then the clamp."""
    raw = family_weight_topn(spark, d).filter("family % 2 = 0")
    return raw.select("family", scoring.smoothed_weight(F.lit(1000), F.greatest("raw", F.lit(200))).alias("weight"))


@query("""SELECT file_id, CASE WHEN epoch % 40 // 6 = 0 THEN size ELSE greatest(100000000, size // CAST(2 ** (epoch % 40 // 6) AS BIGINT)) END AS deposit FROM files""")
def deposit_halving(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("file_id", scoring.halved(F.col("size"), F.lit(100_000_000), F.col("epoch") % 40, 6).cast("bigint").alias("deposit"))


@query("""
WITH RECURSIVE s AS (SELECT uid, value, row_number() OVER (PARTITION BY uid ORDER BY ts, id) AS k FROM reports WHERE value IS NOT NULL),
e AS (SELECT uid, k, value AS c FROM s WHERE k = 1 UNION ALL SELECT e.uid, s.k, e.c + 0.2 * (s.value - e.c) FROM e JOIN s ON s.uid = e.uid AND s.k = e.k + 1)
SELECT uid, CAST(max(k) AS BIGINT) AS n, round(arg_max(c, k), 4) AS latency FROM e GROUP BY uid""".replace("WITH RECURSIVE", "WITH"))
def latency_ema(spark: SparkSession, d: str) -> DataFrame:
    smooth = folds.ema(reports(spark, d).filter("value is not null"), "uid", ["ts", "id"], "value")
    return smooth.select("uid", "n", F.round("ema", 4).alias("latency")).orderBy("latency")


@query(f"""
WITH a AS (SELECT uid, ts, id, {RESULT} AS result FROM reports),
i AS (SELECT *, sum(CASE WHEN result <> 'Passed' THEN 1 ELSE 0 END) OVER (PARTITION BY uid ORDER BY ts, id) AS island FROM a),
p AS (SELECT *, sum(CASE WHEN result = 'Passed' THEN 1 ELSE 0 END) OVER (PARTITION BY uid, island ORDER BY ts, id) AS streak FROM i),
t AS (SELECT *, round(sum(CASE result WHEN 'Failed' THEN 1.0::DOUBLE WHEN 'Timeout' THEN 0.3::DOUBLE ELSE CASE WHEN streak >= 10 THEN -0.05::DOUBLE ELSE 0.0::DOUBLE END END)
  OVER (PARTITION BY uid ORDER BY ts, id), 6) AS total FROM p),
l AS (SELECT uid, count(*) AS n, arg_max(total, (ts, id)) AS total, arg_max(streak, (ts, id)) AS passes, min(total) AS least FROM t GROUP BY uid)
SELECT uid, CAST(n AS BIGINT) AS n, round(total - least(least, 0.0), 4) AS score, CAST(passes AS BIGINT) AS passes,
  CAST(floor(round(total - least(least, 0.0), 4)) AS BIGINT) AS strikes, round(total - least(least, 0.0), 4) >= 3.0 AS banned FROM l""")
def reputation_scores(spark: SparkSession, d: str) -> DataFrame:
    return folds.reputation(_audits(spark, d))


@query("""
WITH k AS (SELECT uid, ts, row_number() OVER (PARTITION BY uid ORDER BY ts, id) AS k FROM reports WHERE kind = 'error' AND value < 20),
b AS (SELECT uid, min(ts) FILTER (k = 3) AS banned_at FROM k GROUP BY uid),
fam AS (SELECT DISTINCT family FROM nodes JOIN b USING (uid) WHERE banned_at IS NOT NULL)
SELECT n.uid, n.family, b.banned_at IS NOT NULL AS own_ban, fam.family IS NOT NULL AS banned
FROM nodes n LEFT JOIN b USING (uid) LEFT JOIN fam ON fam.family = n.family""")
def strikes_bans(spark: SparkSession, d: str) -> DataFrame:
    bans = folds.strikes(reports(spark, d).filter("kind = 'error' and value < 20"), ["ts", "id"])
    return folds.banned(nodes(spark, d), bans)


@query("""SELECT ts // 3600 AS epoch, CAST(count(*) AS BIGINT) AS kept FROM (
  SELECT DISTINCT ts // 3600 * 3600 AS ts, uid, kind FROM reports) GROUP BY 1""")
def attestation_dedup(spark: SparkSession, d: str) -> DataFrame:
    """One report of each (epoch, node, kind), counted by epoch."""
    r = reports(spark, d).withColumn("epoch", scoring.epoch_of(F.col("ts"), 3600))
    return r.dropDuplicates(["epoch", "uid", "kind"]).groupBy("epoch").agg(F.count("*").alias("kept"))


@query(f"""
SELECT ts // 36000 AS epoch, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT uid) AS BIGINT) AS wardens,
  sha256(string_agg(CAST(id AS VARCHAR) || ':' || {RESULT}, ',' ORDER BY sha256(CAST(id AS VARCHAR)), ts, id)) AS digest FROM reports GROUP BY 1""")
def epoch_bundle(spark: SparkSession, d: str) -> DataFrame:
    """Each epoch's attestations in their fixed order, digested."""
    a = _audits(spark, d).withColumn("epoch", scoring.epoch_of(F.col("ts"), 36_000))
    leaf = F.struct(F.sha2(F.col("id").cast("string"), 256).alias("h"), "ts", "id", F.concat_ws(":", F.col("id").cast("string"), "result").alias("leaf"))
    bundles = a.groupBy("epoch").agg(F.count("*").alias("n"), F.count_distinct("uid").alias("wardens"), F.sort_array(F.collect_list(leaf)).alias("leaves"))
    return bundles.select("epoch", "n", "wardens", F.sha2(F.array_join(F.transform("leaves", lambda x: x["leaf"]), ","), 256).alias("digest"))


@query("""
SELECT uid, file_id, idx FROM (SELECT uid, file_id, idx, row_number() OVER (PARTITION BY uid ORDER BY sha256('7:' || uid || ':' || file_id || ':' || idx), part) AS k FROM shards) WHERE k <= 100""")
def sample_per_node(spark: SparkSession, d: str) -> DataFrame:
    rank = F.sha2(F.concat_ws(":", F.lit("7"), F.col("uid").cast("string"), F.col("file_id").cast("string"), F.col("idx").cast("string")), 256)
    return folds.hash_sample(shards(spark, d).withColumn("rank", rank), "uid", F.struct("rank", "part"), 100).select("uid", "file_id", "idx")


@query("""
WITH c AS (SELECT file_id, count(*) AS n FROM shards GROUP BY file_id),
k AS (SELECT file_id, n, CAST(least(n, greatest(3, ceil(n * 100 / 3840.0))) AS BIGINT) AS want FROM c)
SELECT file_id, CAST(n AS BIGINT) AS n, want, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx) AS chosen FROM (
  SELECT s.file_id, k.n, k.want, s.idx, row_number() OVER (PARTITION BY s.file_id ORDER BY sha256(s.file_id || '/' || s.idx)) AS r FROM shards s JOIN k USING (file_id)) WHERE r <= want GROUP BY file_id, n, want""")
def commitment_counts(spark: SparkSession, d: str) -> DataFrame:
    s = shards(spark, d)
    n = s.groupBy("file_id").agg(F.count("*").alias("n")).withColumn("want", scoring.commitment_count(F.col("n")))
    rank = F.sha2(F.concat_ws("/", F.col("file_id").cast("string"), F.col("idx").cast("string")), 256)
    chosen = folds.hash_sample(s.withColumn("rank", rank).join(n, "file_id"), "file_id", F.col("rank"), F.col("want"))
    lists = chosen.groupBy("file_id", "n", "want").agg(F.sort_array(F.collect_list("idx")).alias("c"))
    return lists.select("file_id", "n", "want", F.array_join("c", ",").alias("chosen"))


@query("""
SELECT file_id, idx, string_agg(CAST(chunk AS VARCHAR), ',' ORDER BY chunk) AS chunks FROM (
  SELECT file_id, idx, chunk, row_number() OVER (PARTITION BY file_id, idx ORDER BY sha256(file_id || ':' || idx || ':' || chunk)) AS r
  FROM (SELECT file_id, idx, greatest(max(bytes), 1) AS n FROM shards GROUP BY file_id, idx), LATERAL (SELECT unnest(range(0, n)) AS chunk)) WHERE r <= 4 GROUP BY file_id, idx""")
def challenge_indices(spark: SparkSession, d: str) -> DataFrame:
    """Four distinct chunks (or all) of each shard."""
    s = shards(spark, d).groupBy("file_id", "idx").agg(F.greatest(F.max("bytes"), F.lit(1)).alias("n"))

    def rank(chunk):
        return F.struct(F.sha2(F.concat_ws(":", F.col("file_id").cast("string"), F.col("idx").cast("string"), chunk.cast("string")), 256).alias("h"), chunk.alias("c"))

    first = F.slice(F.array_sort(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1), rank)), 1, 4)
    return s.select("file_id", "idx", F.array_join(F.array_sort(F.transform(first, lambda x: x["c"])), ",").alias("chunks"))


@query("""
SELECT file_id, idx FROM (SELECT file_id, idx, row_number() OVER (ORDER BY file_id, idx, part) - 1 AS rn, count(*) OVER () AS n FROM shards)
WHERE (rn - 137 + n) % n < 50""")
def round_robin_audit(spark: SparkSession, d: str) -> DataFrame:
    """The next 50 shards from a cursor, around the end of the list."""
    return cluster.from_cursor(shards(spark, d), ["file_id", "idx", "part"], 137, 50).select("file_id", "idx")


@query(f"""SELECT id, retries FROM (SELECT id, ts, id % 8 AS retries FROM reports WHERE kind = 'error')
WHERE retries < 10 AND ts + least(30 * CAST(2 ** retries AS BIGINT), 3600) <= (SELECT max(ts) FROM reports) - 864000""")
def retry_due(spark: SparkSession, d: str) -> DataFrame:
    """Queued reports whose backoff has passed."""
    r = reports(spark, d)
    now = r.agg((F.max("ts") - 864_000).alias("now"))
    queued = r.filter("kind = 'error'").select("id", "ts", (F.col("id") % 8).alias("retries"))
    due = F.col("ts") + F.least(30 * F.pow(F.lit(2.0), "retries").cast("bigint"), F.lit(3600))
    return queued.join(F.broadcast(now)).filter((F.col("retries") < 10) & (due <= F.col("now"))).select("id", "retries")  # now is one row


@query("""
WITH c AS (SELECT doc_id, k, sha256(text[k * 1024 + 1 : (k + 1) * 1024]) AS h FROM (
  SELECT doc_id, encode(text) AS text, unnest(range(0, greatest((strlen(text) + 1023) // 1024, 1))) AS k FROM documents))
SELECT doc_id, CAST(count(*) AS BIGINT) AS chunks, sha256(string_agg(h, '' ORDER BY k)) AS digest FROM c GROUP BY doc_id""", views=False)
def chunk_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of 1,024 bytes and digest of every document."""
    docs = tables.read(spark, d, "documents")
    hashes = F.transform(merkle.chunks(F.encode("text", "UTF-8"), 1024), lambda h: F.lower(F.hex(h)))
    return docs.select("doc_id", hashes.alias("h")).select("doc_id", F.size("h").cast("bigint").alias("chunks"), F.sha2(F.array_join("h", ""), 256).alias("digest"))


@query(r"""
WITH RECURSIVE l0 AS (
  SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY idx) - 1 AS k, sha256('\x00'::BLOB || unhex(sha256(file_id || ':' || idx))) AS h FROM (SELECT DISTINCT file_id, idx FROM shards)),
n AS (SELECT file_id, count(*) AS n, max(k) AS last, CAST(2 ** ceil(log2(count(*))) AS BIGINT) AS width FROM l0 GROUP BY file_id),
p AS (SELECT n.file_id, n.width, g.k, l0.h FROM n, LATERAL (SELECT unnest(range(0, n.width)) AS k) g JOIN l0 ON l0.file_id = n.file_id AND l0.k = least(g.k, n.last)),
t AS (SELECT file_id, width, k, h FROM p
  UNION ALL SELECT a.file_id, a.width // 2, a.k // 2, sha256('\x01'::BLOB || unhex(a.h) || unhex(a.next)) FROM (
    SELECT file_id, width, k, h, lead(h) OVER (PARTITION BY file_id, width ORDER BY k) AS next FROM t WHERE width > 1) a WHERE a.k % 2 = 0)
SELECT file_id, h AS root FROM t WHERE width = 1""".replace("WITH RECURSIVE", "WITH"))
def merkle_root(spark: SparkSession, d: str) -> DataFrame:
    """The Merkle root of each file's shard hashes; leaves and inner nodes have tags of their own, the last leaf pads."""
    s = shards(spark, d).select("file_id", "idx").distinct()
    hashes = s.withColumn("h", F.sha2(F.concat_ws(":", F.col("file_id").cast("string"), F.col("idx").cast("string")), 256))
    lists = hashes.groupBy("file_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "h"))), lambda x: F.unhex(x["h"])).alias("leaves"))
    return lists.select("file_id", F.lower(F.hex(merkle.root(F.col("leaves")))).alias("root"))


