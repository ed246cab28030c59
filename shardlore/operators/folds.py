"""Ordered folds as window expressions: reputation, strikes, moving averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
PENALTY = {"Failed": 1.0, "InvalidProof": 1.0, "Timeout": 0.3}
RECOVERY, RECOVERY_AFTER, BAN_AT = 0.05, 10, 3.0
MAX_STRIKES = 3
LATENCY_ALPHA = 0.2


def reputation(reports: DataFrame) -> DataFrame:
    """Score, pass streak, strikes and ban of each uid after all its reports (uid, ts, id, result).

    A failure adds its penalty and ends the streak; a pass from the tenth in a row takes 0.05 off, never below 0. The
    score is a sum reflected at 0: the running sum less its least value so far, if that is negative.
    Repeated ids count once.
    """
    run = _running(reports.dropDuplicates(["id"]))
    last = run.groupBy("uid").agg(F.max_by(F.struct("total", "streak"), F.struct("ts", "id")).alias("end"), F.min("total").alias("least"), F.count("*").alias("n"))
    score = F.round(F.col("end.total") - F.least(F.col("least"), F.lit(0.0)), 4)
    return last.select("uid", "n", score.alias("score"), F.col("end.streak").alias("passes"), F.floor(score).alias("strikes"), (score >= BAN_AT).alias("banned"))


def _running(once: DataFrame) -> DataFrame:
    """Reports with the streak of passes and the sum of penalties and recoveries so far of their uid."""
    order = Window.partitionBy("uid").orderBy("ts", "id")
    failed = F.col("result") != "Passed"
    penalty = F.coalesce(*(F.when(F.col("result") == k, F.lit(v)) for k, v in PENALTY.items()), F.lit(0.0))
    island = F.sum(failed.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    run = once.withColumn("island", island)
    streak = F.sum((~failed).cast("int")).over(Window.partitionBy("uid", "island").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0))
    run = run.withColumn("streak", streak)
    step = F.when(failed, penalty).when(F.col("streak") >= RECOVERY_AFTER, -RECOVERY).otherwise(0.0)
    total = F.sum(step).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return run.withColumn("total", F.round(total, 6))


def ema(samples: DataFrame, key: str, order: list[str], value: str, alpha: float = LATENCY_ALPHA) -> DataFrame:
    """Moving average of a key's ordered samples; the first sample seeds it. One row per key."""
    # Unrolled, the average is a weighted sum: a sample's weight falls with the number of samples after it, and the first one's lacks the factor alpha.
    w = Window.partitionBy(key)
    after = F.row_number().over(w.orderBy(*(F.desc(c) for c in order))) - 1
    numbered = samples.select(key, value, after.alias("after"), F.count("*").over(w).alias("n"))
    weight = F.pow(F.lit(1 - alpha), "after") * F.when(F.col("after") == F.col("n") - 1, 1.0).otherwise(alpha)
    return numbered.groupBy(key).agg(F.count("*").alias("n"), F.sum(weight * F.col(value)).alias("ema"))


def answered(asked: DataFrame, said: DataFrame, within: int) -> DataFrame:
    """asked (uid, asked, ...) with met: whether the uid said something from then on within so many seconds.

    The next answer lies in the question's own slot of that length, or is the first one of the next slot, so neither a product nor all of a uid's rows are needed.
    """
    slot = F.floor(F.col("at") / within)
    both = asked.withColumns({"at": F.col("asked"), "said": F.lit(None).cast("bigint")}).unionByName(said.withColumn("at", F.col("said")), allowMissingColumns=True)
    both = both.withColumn("slot", slot)
    following = F.min("said").over(Window.partitionBy("uid", "slot").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    first = both.filter("said is not null").groupBy("uid", (F.col("slot") - 1).alias("slot")).agg(F.min("said").alias("first"))
    found = both.withColumn("following", following).filter("asked is not null").join(first, ["uid", "slot"], "left")
    met = F.coalesce(F.coalesce("following", "first") <= F.col("asked") + within, F.lit(False))
    return found.select(*asked.columns, met.alias("met"))


def outcomes(reports: DataFrame, nodes: DataFrame) -> DataFrame:
    """What becomes of each report: invalid (its warden isn't allowed, or its node isn't known), duplicate (one of its audit has been processed) or
    processed, and then the score that it leaves its node with and whether that is at the ban limit.

    reports: id, ts, uid, audit, allowed, result; nodes: uid.
    """
    marked = reports.join(nodes.select("uid", F.lit(True).alias("known")), "uid", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    valid = (F.col("allowed") & F.col("known")).cast("int")
    earlier = F.coalesce(F.sum(valid).over(Window.partitionBy("audit").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    outcome = F.when(~F.col("allowed"), "invalid").when(F.col("earlier") > 0, "duplicate").when(~F.col("known"), "invalid").otherwise("processed")
    told = marked.withColumn("earlier", earlier).withColumn("outcome", outcome).drop("earlier", "known", "allowed")
    run = _running(told.filter("outcome = 'processed'"))
    order = Window.partitionBy("uid").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    score = F.round(F.col("total") - F.least(F.min("total").over(order), F.lit(0.0)), 4)
    scored = run.withColumn("score", score).select(*told.columns, "score", (score >= BAN_AT).alias("banned"))
    rest = told.filter("outcome <> 'processed'").withColumns({"score": F.lit(None).cast("double"), "banned": F.lit(False)})
    return scored.unionByName(rest)


def strikes(reports: DataFrame, order: list[str]) -> DataFrame:
    """Strikes of each uid, and the moment of the one that bans it."""
    w = Window.partitionBy("uid").orderBy(*order)
    numbered = reports.withColumn("k", F.row_number().over(w))
    third = F.min(F.when(F.col("k") == MAX_STRIKES, F.col("ts")))
    return numbered.groupBy("uid").agg(F.count("*").alias("strikes"), third.alias("banned_at"))


def banned(nodes: DataFrame, bans: DataFrame) -> DataFrame:
    """Nodes that are banned themselves or belong to the family of one that is."""
    families = nodes.join(bans.filter("banned_at is not null").select("uid"), "uid", "left_semi").select("family").distinct()
    own = bans.select("uid", F.col("banned_at").isNotNull().alias("own"))
    return (
        nodes.join(own, "uid", "left")
        .join(families.withColumn("kin", F.lit(True)), "family", "left")
        .select("uid", "family", F.coalesce("own", F.lit(False)).alias("own_ban"), F.coalesce("kin", F.lit(False)).alias("banned"))
    )


def hash_sample(rows: DataFrame, key: str, rank: Column, most) -> DataFrame:
    """Up to `most` (a number or a column) rows of each key, by the order of a hash."""
    return rows.withColumn("pick", F.row_number().over(Window.partitionBy(key).orderBy(rank))).filter(F.col("pick") <= most)
