"""Placement, rebalance, recovery, reconciliation and registry queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardlore.functions import naming, scoring
from shardlore.operators import folds, inventory, placement
from shardlore.plans.domain import NOW, files, hash60, nodes, reports, shards
from shardlore.plans.registry import query
from shardlore.sources import tables

PGS, SLOTS = 64, 6


def _placed(name: str, where: str = "true", version: int = 3) -> str:
    return f"""
{name} AS (SELECT pg, CAST(slot AS BIGINT) AS slot, uid FROM (SELECT pg, uid, row_number() OVER (PARTITION BY pg ORDER BY turn, straw DESC, uid) - 1 AS slot FROM (
  SELECT *, row_number() OVER (PARTITION BY pg, family ORDER BY straw DESC, uid) AS turn FROM (
    SELECT pg, uid, family, round(CASE WHEN weight > 0 THEN ln(({hash60(f"'v{version}:' || pg || ':' || uid")} % 65536 + 1) / 65537.0::DOUBLE) / weight ELSE '-inf'::DOUBLE END, 12) AS straw
    FROM nodes, (SELECT unnest(range(0, {PGS})) AS pg) WHERE NOT draining AND {where}))) WHERE slot < {SLOTS})"""


_PIECES = f"pieces AS (SELECT file_id, idx, file_id % 3 AS stripe, {hash60('CAST(file_id AS VARCHAR)')} % {PGS} AS pg FROM (SELECT DISTINCT file_id, idx FROM shards))"


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    s = shards(spark, d).select("file_id", "idx").distinct()
    return s.withColumns({"stripe": F.col("file_id") % 3, "pg": scoring.placement_group(F.col("file_id").cast("string"), PGS)})


@query(f"WITH {_placed('p')} SELECT * FROM p")
def straw2_topk(spark: SparkSession, d: str) -> DataFrame:
    return placement.group_placement(nodes(spark, d), PGS, SLOTS)


@query(f"WITH {_placed('p')}, {_PIECES} SELECT file_id, idx, uid FROM pieces JOIN p ON p.pg = pieces.pg AND p.slot = (pieces.idx + pieces.stripe) % {SLOTS}")
def shard_owners(spark: SparkSession, d: str) -> DataFrame:
    return placement.owners(_pieces(spark, d), placement.group_placement(nodes(spark, d), PGS, SLOTS), SLOTS).select("file_id", "idx", "uid")


@query(f"""WITH {_placed('p')}, {_placed('q', 'uid % 19 <> 1')},
a AS (SELECT pg, list_sort(list(uid)) AS u FROM p GROUP BY pg), b AS (SELECT pg, list_sort(list(uid)) AS u FROM q GROUP BY pg)
SELECT CAST(pg AS BIGINT) AS pg FROM a FULL JOIN b USING (pg) WHERE a.u IS DISTINCT FROM b.u""")
def changed_pgs(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    return placement.changed_groups(*(placement.group_placement(x, PGS, SLOTS) for x in (n, n.filter("uid % 19 <> 1"))))


@query(f"""WITH {_placed('p')}, {_placed('q', 'uid % 19 <> 1')}, {_PIECES}
SELECT file_id, idx, p.uid AS source, q.uid AS target FROM pieces JOIN p ON p.pg = pieces.pg AND p.slot = (idx + stripe) % {SLOTS} JOIN q ON q.pg = p.pg AND q.slot = p.slot WHERE p.uid <> q.uid""")
def shard_moves(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    old, new = (placement.group_placement(x, PGS, SLOTS) for x in (n, n.filter("uid % 19 <> 1")))
    return placement.moves(_pieces(spark, d), old, new, SLOTS).select("file_id", "idx", "source", "target")


@query(f"""WITH {_placed('p')}, {_placed('q', 'uid % 19 <> 1')}, {_PIECES},
m AS (SELECT pieces.pg, file_id, idx FROM pieces JOIN p ON p.pg = pieces.pg AND p.slot = (idx + stripe) % {SLOTS} JOIN q ON q.pg = p.pg AND q.slot = p.slot WHERE p.uid <> q.uid),
t AS (SELECT pg, count(*) AS total, count(*) FILTER ((file_id + idx) % 5 < 4) AS done FROM m GROUP BY pg)
SELECT CAST(g.pg AS BIGINT) AS pg, CAST(coalesce(total, 0) AS BIGINT) AS total, CAST(coalesce(done, 0) AS BIGINT) AS done, coalesce(done = total, true) AS settled
FROM (SELECT unnest(range(0, {PGS})) AS pg) g LEFT JOIN t USING (pg)""")
def rebalance_progress(spark: SparkSession, d: str) -> DataFrame:
    """Moves confirmed of each group; a group without moves is settled."""
    n = nodes(spark, d)
    old, new = (placement.group_placement(x, PGS, SLOTS) for x in (n, n.filter("uid % 19 <> 1")))
    done = F.count_if((F.col("file_id") + F.col("idx")) % 5 < 4)
    counts = placement.moves(_pieces(spark, d), old, new, SLOTS).groupBy("pg").agg(F.count("*").alias("total"), done.alias("done"))
    groups = spark.range(PGS).withColumnRenamed("id", "pg").join(counts, "pg", "left")
    zero = F.lit(0).cast("bigint")
    return groups.select("pg", F.coalesce("total", zero).alias("total"), F.coalesce("done", zero).alias("done"), F.coalesce(F.col("done") == F.col("total"), F.lit(True)).alias("settled"))


@query(f"WITH {_placed('p')}, {_placed('q', 'true', 2)} SELECT DISTINCT uid, CAST(pg AS BIGINT) AS pg FROM (SELECT * FROM p UNION ALL SELECT * FROM q)")
def owned_pgs(spark: SparkSession, d: str) -> DataFrame:
    """The groups that a node owns under either version of placement."""
    n = nodes(spark, d)
    both = placement.group_placement(n, PGS, SLOTS).unionByName(placement.group_placement(n, PGS, SLOTS, version=2))
    return both.select("uid", "pg").distinct()


@query(f"""WITH {_placed('p')}, fr AS (SELECT pg, uid, row_number() OVER (PARTITION BY pg ORDER BY uid) - 1 AS rn, count(*) OVER (PARTITION BY pg) AS n
  FROM (SELECT g.pg, nodes.uid FROM nodes, (SELECT DISTINCT pg FROM p) g WHERE weight > 0 AND NOT draining AND NOT EXISTS (SELECT 1 FROM p WHERE p.pg = g.pg AND p.uid = nodes.uid)))
SELECT CAST(pg AS BIGINT) AS pg, CAST(((rn - pg * 7 % n) % n + n) % n AS BIGINT) AS spare, uid FROM fr WHERE ((rn - pg * 7 % n) % n + n) % n < {SLOTS - 1}""")
def fallback_owners(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    return placement.spares(placement.group_placement(n, PGS, SLOTS), n, SLOTS - 1)


@query("""
WITH s AS (SELECT n.uid, n.weight, coalesce(1.0 - (n.uid % 10) / 10.0::DOUBLE, 1.0) AS score FROM nodes n WHERE NOT draining)
SELECT uid, CASE WHEN (SELECT count(*) FROM s WHERE score >= 0.2) >= 10 THEN greatest(1, CAST(floor(weight * score) AS BIGINT)) ELSE weight END AS weight
FROM s WHERE score >= 0.2 OR (SELECT count(*) FROM s WHERE score >= 0.2) < 10""")
def reliability_filter(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d).filter("not draining")
    scores = n.select("uid", (F.lit(1.0) - (F.col("uid") % 10) / 10.0).alias("score"))
    return placement.reliable(n.select("uid", "weight"), scores, 0.2, 10)


@query(f"""WITH ep AS (SELECT file_id, epoch, {hash60('CAST(file_id AS VARCHAR)')} % {PGS} AS pg FROM files),
own AS (SELECT g.pg, e.seen, (g.pg * 31 + e.seen * 7) % 97 + 1 AS uid FROM (SELECT unnest(range(0, {PGS})) AS pg) g, (SELECT DISTINCT epoch AS seen FROM files) e),
m AS (SELECT file_id, uid, max(seen) AS seen FROM ep JOIN own ON own.pg = ep.pg AND seen BETWEEN epoch - 3 AND epoch GROUP BY file_id, uid)
SELECT file_id, uid, seen, row_number() OVER (PARTITION BY file_id ORDER BY seen DESC, uid) AS rank FROM m""")
def owner_lookback(spark: SparkSession, d: str) -> DataFrame:
    """Owners of every file's group within three epochs, the latest first."""
    f = files(spark, d)
    pieces = f.select("file_id", "epoch", scoring.placement_group(F.col("file_id").cast("string"), PGS).alias("pg"))
    epochs = f.select(F.col("epoch").alias("seen")).distinct().join(F.broadcast(spark.range(PGS).withColumnRenamed("id", "pg")))
    owned = epochs.select("pg", "seen", ((F.col("pg") * 31 + F.col("seen") * 7) % 97 + 1).alias("uid"))
    return placement.lookback(pieces, owned, 3)


@query(f"SELECT DISTINCT file_id FROM shards JOIN nodes USING (uid) WHERE greatest({NOW} - last_seen, 0) > 600 AND uid % 7 = 0")
def files_needing_recovery(spark: SparkSession, d: str) -> DataFrame:
    return inventory.needing_recovery(shards(spark, d), _out(spark, d))


def _out(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).filter(scoring.is_offline(F.col("last_seen"), NOW, scoring.OUT_SECS) & (F.col("uid") % 7 == 0))


@query(f"""WITH s AS (SELECT file_id, count(*) FILTER (NOT gone) AS alive, count(*) FILTER (gone) AS lost FROM (
  SELECT file_id, greatest({NOW} - last_seen, 0) > 600 AND uid % 7 = 0 AS gone FROM shards JOIN nodes USING (uid)) GROUP BY file_id)
SELECT file_id, CAST(alive AS BIGINT) AS alive, CAST(lost AS BIGINT) AS lost, alive >= least(4, alive + lost) AS repairable FROM s WHERE lost > 0""")
def stripe_survivors(spark: SparkSession, d: str) -> DataFrame:
    return inventory.survivors(shards(spark, d), _out(spark, d), 4)


@query("""SELECT DISTINCT uid, file_id, idx FROM shards e WHERE flag <> 'X' AND NOT EXISTS (
  SELECT 1 FROM shards h WHERE h.uid = e.uid AND h.file_id = e.file_id AND h.idx = e.idx AND h.flag <> 'R')""")
def expected_vs_held(spark: SparkSession, d: str) -> DataFrame:
    s = shards(spark, d)
    held = s.filter("flag <> 'R'").select("uid", "file_id", "idx")
    return inventory.missing(s.select("uid", "file_id", "idx").distinct(), held, ["uid", "file_id", "idx"])


@query("""SELECT doc_id, CASE WHEN l.id IS NULL THEN 'add' WHEN d.id IS NULL THEN 'drop' ELSE 'keep' END AS action
FROM (SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.doc_id AS id, l.doc_id AS lid FROM (SELECT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)) d
  LEFT JOIN (SELECT DISTINCT doc_id AS id FROM labels) l ON l.id = d.lid""", views=False)
def inventory_reconcile(spark: SparkSession, d: str) -> DataFrame:
    return inventory.reconcile(tables.read(spark, d, "documents"), tables.read(spark, d, "labels"), "doc_id")


@query("""WITH t AS (SELECT doc_id AS hash, doc_id * 7919 % 1000000 AS trashed_at, n_chars AS bytes FROM documents),
l AS (SELECT *, sum(bytes) OVER (ORDER BY trashed_at DESC, hash) AS upto FROM t WHERE 1000000 - trashed_at < 800000)
SELECT hash, 'age' AS reason FROM t WHERE 1000000 - trashed_at >= 800000 UNION ALL SELECT hash, 'size' FROM l WHERE upto > 500000""", views=False)
def trash_purge(spark: SparkSession, d: str) -> DataFrame:
    docs = tables.read(spark, d, "documents")
    trashed = docs.select(F.col("doc_id").alias("hash"), (F.col("doc_id") * 7919 % 1_000_000).alias("trashed_at"), F.col("n_chars").alias("bytes"))
    return inventory.purge(trashed, NOW, 800_000, 500_000)


@query("""SELECT doc_id AS hash FROM documents ORDER BY doc_id * 7919 % 1000000, doc_id LIMIT 100""", views=False)
def trash_oldest(spark: SparkSession, d: str) -> DataFrame:
    return tables.read(spark, d, "documents").orderBy(F.col("doc_id") * 7919 % 1_000_000, "doc_id").limit(100).select(F.col("doc_id").alias("hash"))


@query("""SELECT substr(h, 1, 2) AS prefix, CAST(count(*) AS BIGINT) AS blobs, CAST(sum(n) AS BIGINT) AS bytes FROM (
  SELECT sha256(CAST(doc_id AS VARCHAR)) AS h, n_chars AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) GROUP BY 1""", views=False)
def incremental_backup(spark: SparkSession, d: str) -> DataFrame:
    """Blobs not backed up yet, by the folder they go to."""
    new = inventory.missing(tables.read(spark, d, "documents"), tables.read(spark, d, "labels").select("doc_id"), ["doc_id"])
    blob = F.sha2(F.col("doc_id").cast("string"), 256)
    return new.groupBy(F.substring(blob, 1, 2).alias("prefix")).agg(F.count("*").alias("blobs"), F.sum("n_chars").alias("bytes"))


@query("""SELECT c_custkey AS node, n_name AS family, c_custkey % 25 = c_nationkey AS claim_holds FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 0""", views=False)
def registry_family(spark: SparkSession, d: str) -> DataFrame:
    """Active registrations with their family, and whether a claimed family is the actual one."""
    c = tables.read(spark, d, "customer").filter("c_acctbal > 0")
    n = tables.read(spark, d, "nation")
    joined = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)  # a nation table has 25 rows
    return joined.select(F.col("c_custkey").alias("node"), F.col("n_name").alias("family"), (F.col("c_custkey") % 25 == F.col("c_nationkey")).alias("claim_holds"))


@query("""SELECT c_custkey AS child, NOT EXISTS (SELECT 1 FROM customer b WHERE b.c_custkey = a.c_custkey + 1 AND b.c_nationkey = a.c_nationkey) AS unique_claim,
  (SELECT count(*) FROM customer b WHERE b.c_nationkey = a.c_nationkey) <= 60 AS room, c_acctbal > 0 AS active, c_custkey * 37 % 1000 <= 500 AS released FROM customer a""", views=False)
def registration_checks(spark: SparkSession, d: str) -> DataFrame:
    """Checks before a registration: no rival claim, room in the family, active, unbonding over."""
    c = tables.read(spark, d, "customer")
    rivals = c.select((F.col("c_custkey") - 1).alias("c_custkey"), "c_nationkey", F.lit(True).alias("rival"))
    sizes = c.groupBy("c_nationkey").agg(F.count("*").alias("n"))
    joined = c.join(rivals, ["c_custkey", "c_nationkey"], "left").join(F.broadcast(sizes), "c_nationkey")  # one row per family
    return joined.select(
        F.col("c_custkey").alias("child"), F.col("rival").isNull().alias("unique_claim"), (F.col("n") <= 60).alias("room"),
        (F.col("c_acctbal") > 0).alias("active"), (F.col("c_custkey") * 37 % 1000 <= 500).alias("released"),
    )


@query("""
SELECT page_id, CASE page_id % 5 WHEN 0 THEN 0 WHEN 1 THEN least(page_id, n - 1) WHEN 2 THEN greatest(n - 500, 0) WHEN 3 THEN least(100, n - 1) ELSE 0 END AS start,
  CASE page_id % 5 WHEN 0 THEN least(499, n - 1) WHEN 1 THEN n - 1 WHEN 2 THEN n - 1 WHEN 3 THEN least(100 + page_id, n - 1) ELSE n - 1 END AS stop, page_id % 5 <> 4 AS ranged
FROM (SELECT page_id, CAST(length(html) AS BIGINT) AS n FROM pages)""", views=False)
def byte_ranges(spark: SparkSession, d: str) -> DataFrame:
    p = tables.read(spark, d, "pages")
    page = F.col("page_id").cast("string")
    header = (
        F.when(F.col("page_id") % 5 == 0, "bytes=0-499").when(F.col("page_id") % 5 == 1, F.concat(F.lit("bytes="), page, F.lit("-"))).when(F.col("page_id") % 5 == 2, "bytes=-500")
        .when(F.col("page_id") % 5 == 3, F.concat(F.lit("bytes=100-"), (F.col("page_id") + 100).cast("string"))).otherwise("bytes=0-100,200-300")
    )
    return p.select("page_id", naming.byte_range(header, F.length("html").cast("bigint")).alias("r")).select("page_id", "r.*")


_NAME = """'f ' || page_id || '?' || CASE page_id % 4 WHEN 0 THEN '.MP4' WHEN 1 THEN '.tar.gz' WHEN 2 THEN '.json' ELSE '' END"""


@query(f"""
SELECT page_id, regexp_replace({_NAME}, '[^A-Za-z0-9._ -]', '_', 'g') AS safe,
  CASE page_id % 4 WHEN 0 THEN 'video/mp4' WHEN 1 THEN 'application/gzip' WHEN 2 THEN 'application/json' ELSE 'application/octet-stream' END AS media FROM pages""", views=False)
def mime_filename(spark: SparkSession, d: str) -> DataFrame:
    part = F.when(F.col("page_id") % 4 == 0, ".MP4").when(F.col("page_id") % 4 == 1, ".tar.gz").when(F.col("page_id") % 4 == 2, ".json").otherwise("")
    name = F.concat(F.lit("f "), F.col("page_id").cast("string"), F.lit("?"), part)
    return tables.read(spark, d, "pages").select("page_id", naming.safe_filename(name).alias("safe"), naming.media_type(name).alias("media"))


_IP = "(page_id * 37 % 256) || '.' || (page_id * 11 % 256) || '.' || (page_id % 256) || '.7'"


@query(f"""WITH a AS (SELECT page_id, page_id * 37 % 256 AS a, page_id * 11 % 256 AS b, page_id % 256 AS c, {_IP} AS ip FROM pages)
SELECT page_id, ip, NOT (a = 127 OR a = 169 AND b = 254 OR a >= 224) AS advertisable,
  NOT (a = 127 OR a = 169 AND b = 254 OR a >= 224 OR a = 10 OR a = 172 AND b BETWEEN 16 AND 31 OR a = 192 AND b = 168 OR a = 100 AND b BETWEEN 64 AND 127) AS routable FROM a""", views=False)
def hash_filters(spark: SparkSession, d: str) -> DataFrame:
    """Hosts out of addresses, and whether they may be announced or reached."""
    p = F.col("page_id")
    address = F.concat(F.lit("http://"), (p * 37 % 256).cast("string"), F.lit("."), (p * 11 % 256).cast("string"), F.lit("."), (p % 256).cast("string"), F.lit(".7:3001/x"))
    hosts = tables.read(spark, d, "pages").select("page_id", naming.host_of(address).alias("ip")).withColumn("o", naming.octets(F.col("ip")))
    return hosts.select("page_id", "ip", naming.advertisable(F.col("o")).alias("advertisable"), naming.routable(F.col("o")).alias("routable"))


@query("""
WITH q AS (SELECT id, uid, ts FROM reports WHERE kind = 'view'), a AS (SELECT uid, ts FROM reports WHERE kind = 'click')
SELECT q.id, CASE WHEN min(a.ts) IS NULL THEN 'Timeout' ELSE 'Passed' END AS result FROM q LEFT JOIN a ON a.uid = q.uid AND a.ts BETWEEN q.ts AND q.ts + 3600 GROUP BY q.id""")
def challenge_response(spark: SparkSession, d: str) -> DataFrame:
    """Challenges met by an answer within an hour pass, the others time out."""
    r = reports(spark, d)
    asked = r.filter("kind = 'view'").select("id", "uid", F.col("ts").alias("asked"))
    return folds.answered(asked, r.filter("kind = 'click'").select("uid", F.col("ts").alias("said")), 3600).select("id", F.when(F.col("met"), "Passed").otherwise("Timeout").alias("result"))


@query("""SELECT uid, kind, ts // 600 AS slot, CAST(min(id) AS BIGINT) AS first_id FROM reports GROUP BY 1, 2, 3""")
def repair_hint_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The first hint of each key within a window of ten minutes."""
    slot = scoring.epoch_of(F.col("ts"), 600)
    return reports(spark, d).groupBy("uid", "kind", slot.alias("slot")).agg(F.min("id").alias("first_id"))


