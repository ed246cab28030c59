"""Writers and the state changes of tables: upserts and deletes are appended and resolved to the latest row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key; one aggregate, no sort."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("r")).select(key, "r.*")


def upsert(now: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """now with the rows of changes in place of those with the same key."""
    return now.join(changes.select(key), key, "left_anti").unionByName(changes)


def delete(now: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return now.join(keys.select(key), key, "left_anti")


def append_epoch(snapshot: DataFrame, path: str, newest: int | None) -> None:
    """Add one epoch's rows; an epoch that isn't newer than the newest is refused."""
    epoch = snapshot.agg(F.max("epoch")).first()[0]
    if newest is not None and epoch is not None and epoch <= newest:
        raise ValueError(f"epoch {epoch} isn't newer than {newest}")
    snapshot.write.mode("append").partitionBy("epoch").parquet(path)


def write_blobs(blobs: DataFrame, path: str) -> None:
    """Content-addressed rows under two levels of folders' worth of partitions: one, to keep their number small."""
    blobs.withColumn("prefix", F.substring("hash", 1, 2)).write.mode("append").partitionBy("prefix").parquet(path)


def hash_lines(rows: DataFrame, path: str) -> int:
    """One hash a line; returns their number."""
    rows.select("hash").write.mode("overwrite").text(path)
    return rows.count()
