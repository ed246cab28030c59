"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is written to the shared folder, so its lineage is cut and a lost executor costs one round. A vertex's
smallest neighbour is a partial aggregate; a vertex with very many neighbours meets one row of the other side
in the join, which adaptive execution may split. A graph of at most ALONE edges is solved by one task instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardlore.llm import common


#: Up to so many edges (16 bytes each), one task solves the whole graph; rounds over a cluster cost more than that.
ALONE = 1_000_000


def _with_least(pairs: DataFrame) -> DataFrame:
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return _with_least(both).filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    joined = _with_least(down)
    ends = joined.select(F.col("m").alias("a"), F.col("v").alias("b")).union(joined.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return ends.filter("a < b").distinct()


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges in one task: least labels, pulled along edges and then along labels until nothing changes."""
    parts = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if not parts:
        return
    a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j, label = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while True:
        before = label.copy()
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        np.minimum.at(label, before[i], least)
        np.minimum.at(label, before[j], least)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(ids)))
    yield pa.RecordBatch.from_arrays([pa.array(ids[label[moved]]), pa.array(ids[moved])], ["a", "b"])


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """id and component (the smallest id reachable) of every vertex with an edge that isn't its component's smallest.

    edges: a and b, ids of one type; loops and repeated edges do no harm.
    """
    ordered = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    now, before = common.stage(ordered, name), None
    if now.count() <= ALONE:
        now = common.stage(now.coalesce(1).mapInArrow(_alone, "a bigint, b bigint"), name)
        return now.select(F.col("b").alias("id"), F.col("a").alias("component"))
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("b").alias("id"), F.col("a").alias("component"))
        before = state
        old, now = now, common.stage(_small(_large(now)), name)
        common.unstage(old)
