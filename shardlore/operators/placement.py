"""Placement by declared expressions: rendezvous draws, slots, moves, owners and spares.

Placement depends on the group only, so it is a table (pg, slot, uid) that everything joins with; a stripe rotates a
group's slots. The number of groups is a constant of the cluster, so groups x nodes is bounded by the cluster, not by its files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardlore.functions import scoring


def draw(name: Column, weight: Column) -> Column:
    """A straw: log of 16 hash bits over the weight; weight 0 never wins."""
    u = (F.pmod(scoring.portable_hash(name), F.lit(65_536)) + 1) / F.lit(65_537.0)
    return F.when(weight > 0, F.ln(u) / weight).otherwise(F.lit(float("-inf")))


def group_placement(nodes: DataFrame, groups: int, slots: int, version: int = 3) -> DataFrame:
    """pg, slot and uid: the longest straws of each group, one node per family while families last, then round robin."""
    pgs = nodes.sparkSession.range(groups).withColumnRenamed("id", "pg")
    name = F.concat_ws(":", F.lit(f"v{version}"), F.col("pg").cast("string"), F.col("uid").cast("string"))
    straws = nodes.filter(~F.col("draining")).select("uid", "family", "weight").join(F.broadcast(pgs))
    straws = straws.select("pg", "uid", "family", F.round(draw(name, F.col("weight")), 12).alias("straw"))
    turn = F.row_number().over(Window.partitionBy("pg", "family").orderBy(F.desc("straw"), "uid"))
    place = F.row_number().over(Window.partitionBy("pg").orderBy("turn", F.desc("straw"), "uid")) - 1
    return straws.withColumn("turn", turn).withColumn("slot", place).filter(F.col("slot") < slots).select("pg", F.col("slot").cast("bigint").alias("slot"), "uid")


def owners(pieces: DataFrame, placement: DataFrame, slots: int) -> DataFrame:
    """pieces (pg, stripe, idx, ...) with the owner of each: slot (idx + stripe) mod slots of its group."""
    return pieces.withColumn("slot", F.pmod(F.col("idx") + F.col("stripe"), F.lit(slots))).join(placement, ["pg", "slot"])


def changed_groups(old: DataFrame, new: DataFrame) -> DataFrame:
    """Groups whose set of owners differs."""
    sets = [p.groupBy("pg").agg(F.array_sort(F.collect_set("uid")).alias(n)) for p, n in ((old, "a"), (new, "b"))]
    return sets[0].join(sets[1], "pg", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select("pg")


def moves(pieces: DataFrame, old: DataFrame, new: DataFrame, slots: int) -> DataFrame:
    """Pieces whose owner changes, with the node before and after."""
    both = old.withColumnRenamed("uid", "source").join(new.withColumnRenamed("uid", "target"), ["pg", "slot"]).filter("source <> target")
    return pieces.withColumn("slot", F.pmod(F.col("idx") + F.col("stripe"), F.lit(slots))).join(both, ["pg", "slot"])


def spares(placement: DataFrame, nodes: DataFrame, count: int) -> DataFrame:
    """For each group, `count` nodes of positive weight that aren't placed, round robin by uid from a start of the group's own."""
    free = nodes.filter("weight > 0 and not draining").select("uid").join(F.broadcast(placement.select("pg").distinct()))
    free = free.join(placement.select("pg", "uid"), ["pg", "uid"], "left_anti")
    w = Window.partitionBy("pg")
    numbered = free.withColumns({"rn": F.row_number().over(w.orderBy("uid")) - 1, "n": F.count("*").over(w)})
    turn = F.pmod(F.col("rn") - F.pmod(F.col("pg") * 7, F.col("n")), F.col("n"))
    return numbered.select("pg", turn.alias("spare"), "uid").filter(F.col("spare") < count)


def reliable(nodes: DataFrame, scores: DataFrame, least: float, need: int) -> DataFrame:
    """Nodes with their weights scaled by reliability, those under `least` left out; all nodes as they are if too few remain."""
    scored = nodes.join(scores, "uid", "left").withColumn("score", F.coalesce("score", F.lit(1.0)))
    scaled = scored.withColumn("scaled", F.greatest(F.lit(1), F.floor(F.col("weight") * F.col("score"))).cast("bigint"))
    enough = scored.agg((F.count_if(F.col("score") >= least) >= need).alias("enough"))
    joined = scaled.join(F.broadcast(enough))
    return joined.filter(~F.col("enough") | (F.col("score") >= least)).select("uid", F.when(F.col("enough"), F.col("scaled")).otherwise(F.col("weight")).alias("weight"))


def lookback(pieces: DataFrame, epochs: DataFrame, back: int) -> DataFrame:
    """Owners of a piece's group over the last epochs, newest first, each owner once."""
    met = pieces.join(epochs, (epochs.pg == pieces.pg) & epochs.seen.between(pieces.epoch - back, pieces.epoch)).drop(epochs.pg)
    first = met.groupBy("file_id", "uid").agg(F.max("seen").alias("seen"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("seen"), "uid")).cast("bigint"))


def with_overrides(placement: DataFrame, overrides: DataFrame, live: DataFrame, slots: int) -> DataFrame:
    """placement with a group's override in its place, if enough of the override's nodes are live. overrides: pg, uids."""
    listed = overrides.select("pg", F.posexplode("uids").alias("at", "uid")).join(live.select("uid"), "uid", "left_semi")
    slot = F.row_number().over(Window.partitionBy("pg").orderBy("at")) - 1
    good = listed.withColumn("slot", slot.cast("bigint")).withColumn("n", F.count("*").over(Window.partitionBy("pg"))).filter(F.col("n") >= slots).filter(F.col("slot") < slots)
    return placement.join(good.select("pg").distinct(), "pg", "left_anti").unionByName(good.select("pg", "slot", "uid"))


def repair_plan(pieces: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """For each stripe the first k shards by index, each from its newest holder; stripes with fewer have what there is.

    pieces: file_id, stripe; found: file_id, stripe, idx, uid, epoch.
    """
    best = found.join(pieces, ["file_id", "stripe"], "left_semi").groupBy("file_id", "stripe", "idx").agg(F.max_by("uid", F.struct("epoch", -F.col("uid"))).alias("uid"))
    w = Window.partitionBy("file_id", "stripe")
    ranked = best.withColumns({"turn": F.row_number().over(w.orderBy("idx")), "n": F.count("*").over(w)})
    return ranked.filter(F.col("turn") <= k).select("file_id", "stripe", "idx", "uid", (F.col("n") >= k).alias("repairable"))


def download_plan(requests: DataFrame, owners: DataFrame, latency: DataFrame, blocked: DataFrame, k: int, stripe_size: int) -> DataFrame:
    """The k fastest shards that aren't blocked of each stripe that a byte range touches.

    requests: file_id, start, stop; owners: file_id, stripe, idx, uid; latency: uid, ms (unknown ones come last); blocked: uid.
    """
    stripes = requests.select("file_id", F.explode(F.sequence(F.floor(F.col("start") / stripe_size), F.floor(F.col("stop") / stripe_size))).alias("stripe"))
    open_owners = owners.join(blocked.select("uid"), "uid", "left_anti").join(latency, "uid", "left")
    met = stripes.join(open_owners, ["file_id", "stripe"])
    turn = F.row_number().over(Window.partitionBy("file_id", "stripe").orderBy(F.col("ms").asc_nulls_last(), "idx", "uid"))
    return met.withColumn("turn", turn).filter(F.col("turn") <= k).select("file_id", "stripe", "idx", "uid")
