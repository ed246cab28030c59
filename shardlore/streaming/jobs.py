"""Structured Streaming jobs over event time; late rows beyond the watermark are dropped.

The functions take streaming (or batch) DataFrames with an event time column `at` and return DataFrames; `start` writes one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WATERMARK = "10 minutes"


def bandwidth(reports: DataFrame, width: str = "30 seconds", late: str = WATERMARK) -> DataFrame:
    """Bytes of each node in tumbling windows; nothing is lost between flushes. reports: at, uid, bytes."""
    kept = reports.withWatermark("at", late).filter("uid is not null and bytes is not null")
    return kept.groupBy(F.window("at", width).alias("w"), "uid").agg(F.sum("bytes").alias("bytes")).select("uid", F.col("w.start").alias("window_start"), "bytes")


def liveness(heartbeats: DataFrame, late: str = WATERMARK) -> DataFrame:
    """Last heartbeat and number of heartbeats of each node in windows of an hour. heartbeats: at, uid."""
    seen = heartbeats.withWatermark("at", late).groupBy(F.window("at", "1 hour").alias("w"), "uid")
    return seen.agg(F.max("at").alias("last_seen"), F.count("*").alias("heartbeats")).select("uid", F.col("w.start").alias("hour"), "last_seen", "heartbeats")


def verdicts(challenges: DataFrame, answers: DataFrame, within: str = "60 seconds", late: str = WATERMARK) -> DataFrame:
    """Each challenge with its answer by nonce, or Timeout once the watermark has passed the limit.

    challenges: nonce, uid, at; answers: nonce, ok, at. An answer after the limit counts as none.
    """
    c = challenges.select("nonce", "uid", F.col("at").alias("asked")).withWatermark("asked", late)
    a = answers.select(F.col("nonce").alias("answered"), "ok", F.col("at").alias("said")).withWatermark("said", late)
    met = (F.col("nonce") == F.col("answered")) & (F.col("said") >= F.col("asked")) & (F.col("said") <= F.col("asked") + F.expr(f"interval {within}"))
    result = F.when(F.col("answered").isNull(), "Timeout").when(F.col("ok"), "Passed").otherwise("Failed")
    return c.join(a, met, "left_outer").select("nonce", "uid", "asked", result.alias("result"))


def first_hints(hints: DataFrame, keys: list[str], within: str = "10 minutes") -> DataFrame:
    """The first hint of each key within the window."""
    return hints.withWatermark("at", within).dropDuplicatesWithinWatermark(keys)


def attestations(reports: DataFrame, late: str = WATERMARK) -> DataFrame:
    """Reports without repeats of an audit id."""
    return reports.withWatermark("at", late).dropDuplicatesWithinWatermark(["audit_id"])


def epochs(reports: DataFrame, length: str = "1 hour", late: str = WATERMARK) -> DataFrame:
    """Each closed epoch's leaves in their fixed order. reports: at, shard_hash, audit_id, result."""
    leaf = F.struct("shard_hash", "at", "audit_id", "result")
    closed = reports.withWatermark("at", late).groupBy(F.window("at", length).alias("w")).agg(F.collect_list(leaf).alias("leaves"))
    return closed.select(F.col("w.start").alias("epoch"), F.sort_array("leaves").alias("leaves"))


def newer_maps(maps: DataFrame, most_jump: int = 100) -> DataFrame:
    """The cluster map of each source, replaced only by newer epochs that don't jump too far. maps: source, epoch, hash.

    The state is a number for each source, of which a cluster has a few; it isn't forgotten, or else an old map would pass for a new one.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest = state.get[0] if state.exists else None
        taken = []
        for frame in frames:
            for epoch, digest in sorted(zip(frame["epoch"], frame["hash"], strict=True)):
                if newest is None or newest < epoch <= newest + most_jump:
                    newest = int(epoch)
                    taken.append((key[0], newest, digest))
        if newest is not None:
            state.update((newest,))
        yield pd.DataFrame(taken, columns=["source", "epoch", "hash"])

    return maps.groupBy("source").applyInPandasWithState(step, "source string, epoch bigint, hash string", "epoch bigint", "append", GroupStateTimeout.NoTimeout)


def retries(reports: DataFrame, base: int = 30, cap: int = 3600, most: int = 10) -> DataFrame:
    """Failed deliveries of each report with the delay before the next try; given up after `most`. reports: key, at, delivered.

    Further failures of a report that was given up aren't told; a delivery begins anew and leaves no state, so there is state for undelivered reports only.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tries = state.get[0] if state.exists else 0
        out = []
        for frame in frames:
            for delivered in frame.sort_values("at")["delivered"]:
                if tries >= most and not delivered:
                    continue
                tries = 0 if delivered else tries + 1
                out.append((key[0], tries, 0 if delivered else min(base * 2 ** min(tries, 16), cap), bool(tries >= most)))
        if tries:
            state.update((tries,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["key", "tries", "delay", "given_up"])

    return reports.groupBy("key").applyInPandasWithState(step, "key string, tries bigint, delay bigint, given_up boolean", "tries bigint", "append", GroupStateTimeout.NoTimeout)


def start(stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append a stream to Parquet files; `once` reads what is there and ends."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def change_log(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append changes batch by batch to a log table; its latest rows are the state (see sources.sinks.latest)."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(table)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
