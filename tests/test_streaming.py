"""Streams against what a batch over the same rows gives."""

import pytest
from pyspark.sql import functions as F

from shardlore.sources import sinks, tables
from shardlore.streaming import jobs


def run(spark, tmp_path, rows, schema, job, names=("a",)):
    """Feed the rows through a stream and return what it appended."""
    streams = []
    for name in names:
        spark.createDataFrame(rows[name] if isinstance(rows, dict) else rows, schema[name] if isinstance(schema, dict) else schema).coalesce(1).write.parquet(str(tmp_path / name))
        streams.append(spark.readStream.schema(schema[name] if isinstance(schema, dict) else schema).parquet(str(tmp_path / name)))
    out = job(*streams)
    jobs.start(out, str(tmp_path / "out"), str(tmp_path / "check"), once=True).awaitTermination(120)
    return spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()


def at(seconds):
    import datetime

    return datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(seconds=seconds)


def test_bandwidth(spark, tmp_path):
    rows = [(at(1), 1, 5), (at(29), 1, 7), (at(31), 1, 1), (at(5), 2, None), (at(7200), 9, 1)]
    got = run(spark, tmp_path, rows, "at timestamp, uid long, bytes long", jobs.bandwidth)
    assert sorted((r.uid, r.bytes) for r in got if r.uid == 1) == [(1, 1), (1, 12)]


def test_verdicts(spark, tmp_path):
    rows = {"a": [("x", 1, at(0)), ("y", 1, at(1)), ("z", 2, at(2)), ("late", 3, at(9000))], "b": [("x", True, at(30)), ("y", False, at(20)), ("z", True, at(500)), ("q", True, at(9000))]}
    schema = {"a": "nonce string, uid long, at timestamp", "b": "nonce string, ok boolean, at timestamp"}
    got = run(spark, tmp_path, rows, schema, jobs.verdicts, ("a", "b"))
    found = {r.nonce: r.result for r in got}
    assert found["x"] == "Passed" and found["y"] == "Failed" and found.get("z", "Timeout") == "Timeout"


def test_dedup(spark, tmp_path):
    got = run(spark, tmp_path, [("f", 0, at(0)), ("f", 0, at(5)), ("f", 1, at(6))], "file string, stripe int, at timestamp", lambda s: jobs.first_hints(s, ["file", "stripe"]))
    assert sorted((r.file, r.stripe) for r in got) == [("f", 0), ("f", 1)]


def test_newer_maps(spark, tmp_path):
    got = run(spark, tmp_path, [("v", 5, "a"), ("v", 4, "b"), ("v", 6, "c"), ("v", 500, "d")], "source string, epoch long, hash string", jobs.newer_maps)
    assert [r.epoch for r in sorted(got)] == [4, 5, 6]


def test_retries(spark, tmp_path):
    got = run(spark, tmp_path, [("k", at(i), False) for i in range(12)], "key string, at timestamp, delivered boolean", jobs.retries)
    assert max(r.tries for r in got) == 10 and sum(r.given_up for r in got) == 1 and max(r.delay for r in got) == 3600


def test_delivery_after_giving_up(spark, tmp_path):
    rows = [("k", at(i), False) for i in range(12)] + [("k", at(20), True), ("k", at(21), False)]
    got = run(spark, tmp_path, rows, "key string, at timestamp, delivered boolean", jobs.retries)
    assert sorted(r.tries for r in got) == [0, 1, *range(1, 11)]


def test_liveness(spark, tmp_path):
    rows = [(at(1), 1), (at(50), 1), (at(3700), 1), (at(5), 2), (at(20_000), 9)]
    got = run(spark, tmp_path, rows, "at timestamp, uid long", jobs.liveness)
    assert sorted((r.uid, r.heartbeats) for r in got if r.uid != 9) == [(1, 1), (1, 2), (2, 1)]


def test_attestations(spark, tmp_path):
    got = run(spark, tmp_path, [("a", at(0)), ("a", at(5)), ("b", at(6))], "audit_id string, at timestamp", jobs.attestations)
    assert sorted(r.audit_id for r in got) == ["a", "b"]


def test_manifests(spark):
    import json

    good = {"file_hash": "a", "size": 10, "shards": [{"index": 0, "blob_hash": "b"}]}
    many = {"file_hash": "m", "size": 10, "stripe": {"size": 100, "k": 1, "m": 1}, "shards": [{"index": i, "blob_hash": "b"} for i in range(3)]}
    rows = [("a", json.dumps(good)), ("m", json.dumps(many)), ("cluster_map", "{}"), ("t", "DELETED"), ("j", "[1")]
    got = tables.manifests(spark.createDataFrame(rows, "key string, value string")).collect()
    assert [(r.key, r.placement_version, r.placement_epoch) for r in got] == [("a", 1, 0)]


def test_family_pages(spark):
    got = tables.family_pages(spark.createDataFrame([("f", "m", ["a", "b"]), ("g", None, None)], "family string, main_node string, child_nodes array<string>"))
    assert sorted(map(tuple, got.collect())) == [("f", "a"), ("f", "b"), ("f", "m")]


def test_state_changes(spark, tmp_path):
    now = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    after = sinks.upsert(now, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), "k")
    assert sorted(map(tuple, after.collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sinks.delete(after, now, "k").count() == 1
    log = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, t int, v string")
    assert sorted((r.k, r.v) for r in sinks.latest(log, "k", "t").collect()) == [(1, "b"), (2, "c")]
    path = str(tmp_path / "epochs")
    sinks.append_epoch(spark.range(3).withColumn("epoch", F.lit(5)), path, None)
    with pytest.raises(ValueError):
        sinks.append_epoch(spark.range(3).withColumn("epoch", F.lit(5)), path, 5)
    assert spark.read.parquet(path).count() == 3


def test_blobs(spark, tmp_path):
    for name in ("ab/cd/x1.bin", "y2.bin", "z.tmp"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"123")
    assert sorted(map(tuple, tables.blobs(spark, str(tmp_path)).collect())) == [("x1", 3), ("y2", 3)]
