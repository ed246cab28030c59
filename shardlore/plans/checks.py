"""Histories, submissions, configuration, keys and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardlore.functions import naming, scoring
from shardlore.operators import folds, history, placement
from shardlore.plans.changes import PGS, SLOTS, _placed
from shardlore.plans.domain import files, hash60, nodes, reports, shards
from shardlore.plans.registry import query
from shardlore.sources import tables


@query("""
WITH e AS (SELECT DISTINCT epoch FROM files WHERE epoch % 9 <> 0),
h AS (SELECT epoch, sha256(CAST(epoch AS VARCHAR)) AS hash, sha256(CAST(CASE WHEN epoch % 11 = 0 THEN 0 ELSE epoch - 1 END AS VARCHAR)) AS previous FROM e)
SELECT a.epoch, CASE WHEN b.epoch IS NULL THEN 'gap' WHEN a.previous = b.hash THEN 'ok' ELSE 'broken' END AS state FROM h a LEFT JOIN h b ON b.epoch = a.epoch - 1""")
def epoch_chain(spark: SparkSession, d: str) -> DataFrame:
    e = files(spark, d).select("epoch").distinct().filter("epoch % 9 <> 0")
    before = F.when(F.col("epoch") % 11 == 0, F.lit(0)).otherwise(F.col("epoch") - 1)
    return history.chained(e.withColumns({"hash": F.sha2(F.col("epoch").cast("string"), 256), "previous": F.sha2(before.cast("string"), 256)}))


@query("SELECT DISTINCT epoch FROM files WHERE epoch > 23970 AND epoch <= 23970 + 20")
def epochs_accepted(spark: SparkSession, d: str) -> DataFrame:
    return history.acceptable(files(spark, d).select("epoch").distinct(), F.lit(23970), 20)


@query("""
WITH r AS (SELECT c_custkey AS uid, c_nationkey AS family, c_acctbal > 0 AS active FROM customer),
s AS (SELECT uid % 7 AS epoch, CASE WHEN uid % 7 = 3 THEN -uid ELSE uid END AS position, uid, family FROM nodes),
k AS (SELECT s.*, coalesce(uid > lag(uid) OVER (PARTITION BY epoch ORDER BY position), true) AS rises, EXISTS (SELECT 1 FROM r WHERE r.uid = s.uid AND r.family = s.family AND active) AS known FROM s)
SELECT epoch, bool_and(rises) AS ascending, CAST(count(*) FILTER (NOT known) AS BIGINT) AS unregistered FROM k GROUP BY epoch""")
def map_submissions(spark: SparkSession, d: str) -> DataFrame:
    registry = tables.read(spark, d, "customer").select(F.col("c_custkey").alias("uid"), F.col("c_nationkey").cast("bigint").alias("family"), (F.col("c_acctbal") > 0).alias("active"))
    epoch = F.col("uid") % 7
    rows = nodes(spark, d).select(epoch.alias("epoch"), F.when(epoch == 3, -F.col("uid")).otherwise(F.col("uid")).alias("position"), "uid", "family")
    return history.submission(rows, registry)


@query("""SELECT file_id, CASE file_id % 5 WHEN 3 THEN '3,2,1' WHEN 2 THEN '2,1' WHEN 1 THEN '1,2' ELSE (file_id % 5) || ',2,1' END AS versions FROM files""")
def placement_versions(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("file_id", F.array_join(history.probing(F.col("file_id") % 5), ",").alias("versions"))


@query("""
SELECT uid, CAST(2 ** ceil(log2(CASE WHEN uid % 4 = 0 THEN 16384 ELSE uid END)) AS BIGINT) AS pg_count, CASE WHEN uid % 3 = 0 THEN 10 ELSE uid % 3 END AS ec_k, CAST(CASE WHEN uid % 2 = 0 THEN 20 ELSE 1 END AS BIGINT) AS ec_m FROM nodes""")
def config_defaults(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    uid = F.col("uid")
    return history.with_defaults(n.select("uid", F.when(uid % 4 == 0, 0).otherwise(uid).alias("pg_count"), (uid % 3).alias("ec_k"), (uid % 2).alias("ec_m")))


@query("""SELECT uid, rank, row_number() OVER (ORDER BY rank, uid) AS place FROM (SELECT uid, CASE WHEN uid = 42 THEN 0 WHEN uid % 10 = 0 THEN 1 END AS rank FROM nodes) WHERE rank IS NOT NULL""")
def sync_sources(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d).select("uid", (F.col("uid") % 10 == 0).alias("seeder"))
    return history.sources(n, F.col("uid") == 42).select("uid", "rank", "place")


@query("""SELECT status, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN status = 'O' THEN 'Failed: Interrupted' ELSE status END AS status FROM files) GROUP BY status""")
def progress_recovered(spark: SparkSession, d: str) -> DataFrame:
    p = files(spark, d).withColumn("status", F.when(F.col("status") == "O", "Processing").otherwise(F.col("status")))
    return history.recovered(p).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""WITH {_placed('p')} SELECT file_id FROM files WHERE regexp_matches(file_hash, '^[0-9a-fA-F]{{64}}$') AND {hash60('file_hash')} % {PGS} IN (SELECT pg FROM p WHERE uid = 5)""")
def own_files(spark: SparkSession, d: str) -> DataFrame:
    """Files whose group one node owns: by a semi-join on the placement table."""
    mine = placement.group_placement(nodes(spark, d), PGS, SLOTS).filter("uid = 5").select("pg")
    f = files(spark, d).filter(naming.is_file_hash(F.col("file_hash"))).withColumn("pg", scoring.placement_group(F.col("file_hash"), PGS))
    return f.join(mine, "pg", "left_semi").select("file_id")


@query("""SELECT doc_id FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 10) WHERE doc_id NOT IN (SELECT doc_id FROM labels)""", views=False)
def index_integrity(spark: SparkSession, d: str) -> DataFrame:
    """The first ten indexed keys that have no record."""
    first = tables.read(spark, d, "documents").select("doc_id").orderBy("doc_id").limit(10)
    return first.join(tables.read(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("""SELECT sha256(CAST(file_id AS VARCHAR)) || ':' || uid || ':' || lower(hex(CAST(idx AS VARCHAR))) AS key, CAST(count(*) AS BIGINT) AS n FROM shards GROUP BY 1""")
def attestation_keys(spark: SparkSession, d: str) -> DataFrame:
    """Shards by their key."""
    key = naming.dedup_key(F.sha2(F.col("file_id").cast("string"), 256), F.col("uid"), F.lower(F.hex(F.col("idx").cast("string"))))
    return shards(spark, d).groupBy(key.alias("key")).agg(F.count("*").alias("n"))


@query("""SELECT id // 1000 AS batch, CAST(count(*) FILTER (kind <> 'error') AS BIGINT) AS passed, CAST(count(*) FILTER (kind = 'error') AS BIGINT) AS failed,
  coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (kind = 'error'), '') AS failed_ids FROM reports GROUP BY 1""")
def batch_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each batch of 1,000 reports and its failed ids."""
    bad = F.sort_array(F.collect_list(F.when(F.col("kind") == "error", F.col("id"))))
    return reports(spark, d).groupBy(F.floor(F.col("id") / 1000).alias("batch")).agg(
        F.count_if(F.col("kind") != "error").alias("passed"), F.count_if(F.col("kind") == "error").alias("failed"), F.array_join(bad, ",").alias("failed_ids")
    )


@query("""
WITH r AS (SELECT id, ts, uid, CASE WHEN id % 10 = 9 THEN id - 1 ELSE id END AS audit, value IS NULL OR value >= 2 AS allowed, EXISTS (SELECT 1 FROM nodes WHERE nodes.uid = reports.uid) AS known,
  CASE kind WHEN 'error' THEN 'Failed' WHEN 'purchase' THEN 'Timeout' ELSE 'Passed' END AS result FROM reports),
o AS (SELECT *, CASE WHEN NOT allowed THEN 'invalid' WHEN coalesce(sum(CASE WHEN allowed AND known THEN 1 ELSE 0 END) OVER (PARTITION BY audit ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0
  THEN 'duplicate' WHEN NOT known THEN 'invalid' ELSE 'processed' END AS outcome FROM r),
i AS (SELECT *, sum(CASE WHEN result <> 'Passed' THEN 1 ELSE 0 END) OVER (PARTITION BY uid ORDER BY ts, id) AS island FROM o WHERE outcome = 'processed'),
p AS (SELECT *, sum(CASE WHEN result = 'Passed' THEN 1 ELSE 0 END) OVER (PARTITION BY uid, island ORDER BY ts, id) AS streak FROM i),
t AS (SELECT *, round(sum(CASE result WHEN 'Failed' THEN 1.0::DOUBLE WHEN 'Timeout' THEN 0.3::DOUBLE ELSE CASE WHEN streak >= 10 THEN -0.05::DOUBLE ELSE 0.0::DOUBLE END END)
  OVER (PARTITION BY uid ORDER BY ts, id), 6) AS total FROM p),
s AS (SELECT *, round(total - least(min(total) OVER (PARTITION BY uid ORDER BY ts, id), 0.0), 4) AS score FROM t)
SELECT outcome, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (coalesce(s.score, 0) >= 3.0) AS BIGINT) AS at_ban FROM o LEFT JOIN s USING (id) GROUP BY outcome""".replace("o LEFT JOIN s USING (id) GROUP BY outcome", "(SELECT o.id, o.outcome, s.score FROM o LEFT JOIN s ON s.id = o.id) s GROUP BY outcome"))
def audit_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of each report of a batch, and how many leave their node at the ban limit or above."""
    result = F.when(F.col("kind") == "error", "Failed").when(F.col("kind") == "purchase", "Timeout").otherwise("Passed")
    r = reports(spark, d).select("id", "ts", "uid", F.when(F.col("id") % 10 == 9, F.col("id") - 1).otherwise(F.col("id")).alias("audit"), F.expr("value is null or value >= 2").alias("allowed"), result.alias("result"))
    done = folds.outcomes(r, nodes(spark, d).select("uid"))
    return done.groupBy("outcome").agg(F.count("*").alias("n"), F.count_if(F.col("banned")).alias("at_ban"))


@query(f"""
WITH c AS (SELECT uid, max(ts) + 600 AS until FROM reports WHERE kind = 'error' GROUP BY uid)
SELECT n.uid, coalesce(c.until > (SELECT max(ts) FROM reports) - 86400, false) AS resting FROM nodes n LEFT JOIN c USING (uid)""")
def cooldowns(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that rest until a moment after their last failure."""
    r = reports(spark, d)
    until = r.filter("kind = 'error'").groupBy("uid").agg((F.max("ts") + 600).alias("until"))
    now = r.agg((F.max("ts") - 86_400).alias("now"))
    return history.resting(nodes(spark, d).select("uid"), until, now)


@query("""SELECT CAST(count(*) AS BIGINT) AS files, CAST(sum(size) AS BIGINT) AS bytes, CAST(bit_xor(CAST('0x' || substr(sha256(file_hash || ':' || size), 1, 15) AS BIGINT)) AS BIGINT) AS digest, CAST(max(epoch) AS BIGINT) AS epoch FROM files""")
def sync_index(spark: SparkSession, d: str) -> DataFrame:
    """What a replica compares before it asks for the list of files."""
    return history.sync_index(files(spark, d))


@query("""SELECT uid, CAST(max(ts) AS BIGINT) AS last_seen, CAST(count(*) AS BIGINT) AS heartbeats FROM (
  SELECT uid, ts, ts - lag(ts) OVER (PARTITION BY uid ORDER BY ts, id) AS gap FROM reports WHERE kind IN ('view', 'click')) WHERE gap IS NULL OR gap >= 10 GROUP BY uid""")
def heartbeats(spark: SparkSession, d: str) -> DataFrame:
    """Heartbeats that keep the rate limit of ten seconds to the one before."""
    from pyspark.sql import Window

    gap = F.col("ts") - F.lag("ts").over(Window.partitionBy("uid").orderBy("ts", "id"))
    kept = reports(spark, d).filter("kind in ('view', 'click')").withColumn("gap", gap).filter("gap is null or gap >= 10")
    return kept.groupBy("uid").agg(F.max("ts").alias("last_seen"), F.count("*").alias("heartbeats"))


@query("""SELECT uid, CAST(max(k) AS BIGINT) AS total FROM (SELECT uid, row_number() OVER (PARTITION BY uid ORDER BY sha256('w' || id)) AS k FROM reports WHERE uid % 2 = 0) WHERE k <= 20 GROUP BY uid""")
def capped_reports(spark: SparkSession, d: str) -> DataFrame:
    """At most twenty reports of each allowed warden, picked by a hash: the feature is the cap."""
    r = reports(spark, d).filter(history.allowed(F.col("uid") % 2, [0])).withColumn("h", F.sha2(F.concat(F.lit("w"), F.col("id").cast("string")), 256))
    return folds.hash_sample(r, "uid", F.col("h"), 20).groupBy("uid").agg(F.count("*").alias("total"))
