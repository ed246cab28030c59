"""Scalar scoring rules of the storage cluster as Column expressions.

Integer divisions floor and saturate as the cluster's own accounting does; ratios are doubles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
HEARTBEAT_SECS = 30
OFFLINE_SECS = 120
OUT_SECS = 600
REPUTATION_DECAY = 0.767
REPUTATION_BOUNDS = (0.1, 1.0)
NODE_WEIGHT_BOUNDS = (10, 2000)
BASE_WEIGHT_BOUNDS = (10.0, 1000.0)
MIN_AGE = 0.5
DAY_SECS = 86_400
GIB = 1 << 30
STRIPE_BYTES = 8 << 20
K, M = 10, 20


def between(x: Column, low, high) -> Column:
    """x within low and high."""
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def is_offline(last_seen: Column, now: int, after: int = OFFLINE_SECS) -> Column:
    return F.greatest(F.lit(now) - last_seen, F.lit(0)) > after


def uptime_score(heartbeats: Column, registered: Column, now: Column) -> Column:
    """Heartbeats seen per heartbeat due, 0 to 1; 1 while there is nothing to judge by."""
    elapsed = F.greatest(now - registered, F.lit(0))
    due = F.floor(elapsed / HEARTBEAT_SECS)
    fresh = (registered == 0) | (elapsed < 60) | (due == 0)
    return F.when(fresh, F.lit(1.0)).otherwise(between(F.try_divide(heartbeats, due), 0.0, 1.0))


def uptime_multiplier(score: Column) -> Column:
    return F.when(score >= 0.95, 1.5).when(score >= 0.80, 1.2).when(score >= 0.50, 1.0).otherwise(0.5)


def strike_multiplier(strikes: Column) -> Column:
    return F.when(strikes == 0, 1.0).when(strikes == 1, 0.8).when(strikes == 2, 0.5).otherwise(0.1)


def reputation_multiplier(reputation: Column) -> Column:
    return between(F.exp(F.lit(-REPUTATION_DECAY) * reputation), *REPUTATION_BOUNDS)


def capacity_multiplier(available: Column, total: Column) -> Column:
    used = F.lit(1.0) - F.try_divide(available, total)
    return F.when(total == 0, 1.0).when(used < 0.50, 1.2).when(used < 0.75, 1.0).when(used < 0.90, 0.8).otherwise(0.5)


def node_weight(total: Column, available: Column, heartbeats: Column, registered: Column, now: int, override: Column, stored: Column) -> Column:
    """Placement weight from size, uptime, free space and age; an override keeps the stored weight."""
    base = between(F.floor(total / GIB) * 10.0, *BASE_WEIGHT_BOUNDS)
    age = F.least(F.lit(MIN_AGE) + F.lit(MIN_AGE) * F.greatest(F.lit(now) - registered, F.lit(0)) / DAY_SECS, F.lit(1.0))
    full = base * uptime_multiplier(uptime_score(heartbeats, registered, F.lit(now))) * capacity_multiplier(available, total) * age
    return F.when(override, stored).otherwise(between(F.floor(full), *NODE_WEIGHT_BOUNDS)).cast("bigint")


def ilog2(x: Column) -> Column:
    """Floor of the binary logarithm of a bigint; 0 of 0."""
    return F.length(F.bin(x)) - 1


def quality_weight(
    bandwidth: Column, stored: Column, uptime_permille: Column, strikes: Column, integrity_fails: Column,
    bandwidth_permille: int = 500, storage_permille: int = 500, scale: int = 100, strike_penalty: int = 50, integrity_penalty: int = 100,
) -> Column:
    """A node's on-chain weight: blended logarithms, scaled, times uptime, less penalties, never negative."""
    blended = F.floor((ilog2(bandwidth + 1) * bandwidth_permille + ilog2(stored + 1) * storage_permille) / max(1, bandwidth_permille + storage_permille))
    score = F.floor(F.least(blended * scale, F.lit(65535)) * F.least(uptime_permille, F.lit(1000)) / 1000)
    penalty = F.least(strikes * strike_penalty + integrity_fails * integrity_penalty, F.lit(65535))
    return F.greatest(score - penalty, F.lit(0)).cast("bigint")


def ranked_sum(weights: Column, top: int = 5, decay_permille: int = 800, most: int = 10_000) -> Column:
    """Sum of an array's weights in descending order, each discounted once more than the one before, flooring at every step."""
    start = F.struct(F.lit(1000).cast("bigint").alias("factor"), F.lit(0).cast("bigint").alias("total"))
    added = F.aggregate(
        F.slice(F.sort_array(weights, asc=False), 1, top),
        start,
        lambda s, w: F.struct(
            F.floor(s["factor"] * decay_permille / 1000).cast("bigint").alias("factor"),
            (s["total"] + F.floor(w * s["factor"] / 1000)).cast("bigint").alias("total"),
        ),
    )
    return F.least(added["total"], F.lit(most)).cast("bigint")


def ema_permille(before: Column, after: Column, alpha: int) -> Column:
    """Integer moving average, floored."""
    a = min(alpha, 1000)
    return F.floor((before * (1000 - a) + after * a) / 1000).cast("bigint")


def smoothed_weight(before: Column, raw: Column, alpha: int = 300, delta: int = 100, most: int = 10_000) -> Column:
    """The moving average, moved by at most `delta` from the value before."""
    low, high = F.greatest(before - delta, F.lit(0)), F.least(before + delta, F.lit(most))
    return F.least(F.greatest(ema_permille(before, raw, alpha), low), high).cast("bigint")


def halved(value: Column, base: Column, elapsed: Column, period: int) -> Column:
    """value halved once for each full period, not below base; unchanged before the first period ends."""
    if not period:
        return value
    periods = F.floor(elapsed / period)
    return F.when(periods == 0, value).otherwise(F.greatest(base, F.floor(value / F.pow(F.lit(2.0), F.least(periods, F.lit(62)))).cast("bigint")))


def epoch_of(seconds: Column, duration: int) -> Column:
    return F.floor(seconds / duration).cast("bigint") if duration else F.lit(0).cast("bigint")


def stripe_bytes(size: Column, stripe: Column, stripe_size: int = STRIPE_BYTES) -> Column:
    """Data bytes in one stripe; 0 past the end."""
    return F.greatest(F.least(size - stripe * stripe_size, F.lit(stripe_size)), F.lit(0)).cast("bigint")


def shard_bytes(stripe_data: Column, k: int = K) -> Column:
    return F.floor((stripe_data + (k - 1)) / k).cast("bigint")


def commitment_count(shards: Column, least: int = 3, per: int = 3840, of: int = 100) -> Column:
    """How many of a file's shards are committed: `of` per `per`, at least `least`, at most all."""
    return F.least(shards, F.greatest(F.lit(least), F.ceil(shards * of / per))).cast("bigint")


def portable_hash(value: Column) -> Column:
    """60 bits of SHA-256, the same in any SQL engine."""
    return F.conv(F.substring(F.sha2(value, 256), 1, 15), 16, 10).cast("bigint")


def placement_group(file_hash: Column, groups: int) -> Column:
    return (portable_hash(file_hash) % groups).cast("bigint")
