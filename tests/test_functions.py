"""Fixed vectors of the scalar functions, and invariants of placement, sampling and coding."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shardlore.functions import codec, exact, naming, scoring
from shardlore.operators import merkle


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema).orderBy("i").select(column).collect()]


def test_uptime(spark):
    rows = [(0, 1000, 1050), (0, 100, 100), (10, 100, 400), (5, 100, 400), (0, 100, 220), (100, 100, 400), (0, 0, 9999)]
    got = values(spark, rows, "h long, r long, n long", scoring.uptime_score(F.col("h"), F.col("r"), F.col("n")))
    assert got == [1.0, 1.0, 1.0, 0.5, 0.0, 1.0, 1.0]


def test_commitment_count(spark):
    rows = [(0,), (1,), (2,), (30,), (120,), (3840,), (7680,)]
    assert values(spark, rows, "n long", scoring.commitment_count(F.col("n"))) == [0, 1, 2, 3, 4, 100, 200]


def test_ilog2(spark):
    assert values(spark, [(0,), (1,), (2,), (3,), (1 << 40,), ((1 << 53) - 1,)], "n long", scoring.ilog2(F.col("n"))) == [0, 0, 1, 1, 40, 52]


def test_byte_ranges(spark):
    rows = [("bytes=0-499", 1000), ("bytes=500-", 1000), ("bytes=-500", 1000), ("bytes=-5000", 1000), ("bytes=0-10,20-30", 1000), ("bytes=x", 1000), (None, 1000), ("bytes=0-1", 0), ("bytes=900-5000", 1000), ("bytes=-0", 1000)]
    got = [tuple(r) for r in values(spark, rows, "h string, n long", naming.byte_range(F.col("h"), F.col("n")))]
    assert got == [(0, 499, True), (500, 999, True), (500, 999, True), (0, 999, True), (0, 999, False), (0, 999, False), (0, 999, False), (0, 0, False), (900, 999, True), (0, 999, False)]


def test_names(spark):
    rows = [("a.MP4",), ("x.tar.gz",), ("none",), ('a"b\\c',), ("é\n",), ("",)]
    assert values(spark, rows, "n string", naming.media_type(F.col("n")))[:3] == ["video/mp4", "application/gzip", "application/octet-stream"]
    assert values(spark, rows, "n string", naming.safe_filename(F.col("n")))[3:] == ["a_b_c", "_", "download"]


def test_hosts(spark):
    rows = [("http://203.0.113.5:3001",), ("http://[::1]:3001",), ("https://10.0.0.1/x",), ("node.example:1",)]
    assert values(spark, rows, "a string", naming.host_of(F.col("a"))) == ["203.0.113.5", "::1", "10.0.0.1", "node.example"]
    o = naming.octets(naming.host_of(F.col("a")))
    assert values(spark, rows, "a string", naming.routable(o)) == [True, None, False, None]
    assert values(spark, rows, "a string", naming.advertisable(o)) == [True, None, True, None]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8])
def test_merkle(spark, n):
    df = spark.createDataFrame([([bytes([i]) * (i + 1) for i in range(n)],)], "leaves array<binary>").withColumn("root", merkle.root(F.col("leaves")))
    each = df.select("root", "leaves", F.posexplode("leaves").alias("at", "leaf"))
    path = merkle.proof(F.col("leaves"), F.col("at"))
    good = merkle.verify(F.col("leaf"), path, F.col("root"))
    bad = merkle.verify(F.concat("leaf", F.lit(b"x")), path, F.col("root"))
    assert [tuple(r) for r in each.select(good, bad).collect()] == [(True, False)] * n


@pytest.mark.parametrize("n", [4096, 4097, 5000])
def test_large_merkle(spark, n):
    """Trees of 4,096 leaves and more: the root by hashlib, and proofs of leaves on both sides of that number."""
    leaves = [hashlib.sha256(str(k).encode()).digest() for k in range(n)]
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves]
    level += level[-1:] * ((1 << (n - 1).bit_length()) - n)
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + a + b).digest() for a, b in zip(level[::2], level[1::2], strict=True)]
    at = [0, 4095, n - 1]
    df = spark.createDataFrame([(leaves, k) for k in at], "leaves array<binary>, at int")
    path = merkle.proof(F.col("leaves"), F.col("at"))
    got = df.select(merkle.root(F.col("leaves")).alias("root"), merkle.verify(F.get("leaves", F.col("at")), path, F.lit(level[0])).alias("ok")).collect()
    assert [tuple(r) for r in got] == [(bytearray(level[0]), True)] * len(at)


def test_empty_merkle(spark):
    got = spark.createDataFrame([([],), (None,)], "leaves array<binary>").select(merkle.root(F.col("leaves"))).collect()
    assert [r[0] for r in got] == [bytearray(32), None]


def test_sip_hash(spark):
    """The published vector of SipHash-2-4, and messages of several lengths at once."""
    key = (0x0706050403020100, 0x0F0E0D0C0B0A0908)
    assert int(exact.sip_hash([bytes(range(15))], 2, 4, key)[0]) == 0xA129CA6149BE45E5
    many = [b"", b"a" * 7, bytes(range(15)), b"a" * 8, b"x" * 300]
    assert exact.sip_hash(many).tolist() == [int(exact.sip_hash([m])[0]) for m in many]
    got = values(spark, [("5F3x",), (None,), ("5F3x",)], "k string", exact.node_uid(F.col("k")))
    assert got[0] == got[2] and 0 <= got[0] < 1 << 31 and got[1] is None


def test_signed_bytes(spark):
    shard, warden, challenge = "ab" * 32, "w" * 70, bytes(range(32))
    df = spark.createDataFrame([(shard, 7, 2, bytearray(challenge), 1 << 40, 9, bytearray(), warden)], "s string, u long, r int, c binary, b long, t long, p binary, w string")
    got = df.select(naming.signed_bytes("TAG", *(F.col(c) for c in "surcbtpw"))).first()[0]
    parts = [bytes([12]) + b"TAG", (64 * 4 + 1).to_bytes(2, "little") + shard.encode(), (7).to_bytes(4, "little"), b"\2", challenge, (1 << 40).to_bytes(8, "little"), (9).to_bytes(8, "little"), b"\0"]
    assert bytes(got) == b"".join(parts) + (70 * 4 + 1).to_bytes(2, "little") + warden.encode()


def test_field_elements(spark):
    rows = [(bytearray(b""),), (bytearray(b"\1"),), (bytearray(b"\1\2\3"),), (bytearray(bytes([1, 2, 3, 255, 255])),)]
    assert values(spark, rows, "d binary", naming.field_elements(F.col("d"))) == [[0], [1, 1], [1 + 512 + 3 * 65536, 3], [1 + 512 + 3 * 65536, 65535, 5]]
    assert values(spark, [([1, 256, 2013265920, 0, 0, 0, 0, 7],)], "e array<int>", naming.element_bytes(F.col("e"))) == [
        bytearray(b"".join(x.to_bytes(4, "little") for x in (1, 256, 2013265920, 0, 0, 0, 0, 7)))
    ]


FAMILIES = st.lists(st.tuples(st.integers(1, 3000), st.sampled_from("abcdefgh")), min_size=12, max_size=40, unique_by=lambda x: x[0])


@settings(max_examples=40, deadline=None)
@given(FAMILIES, st.sampled_from([exact.Straws, exact.Wheel]), st.integers(0, 9))
def test_spread(pairs, method, stripe):
    nodes = [(u, f, 10 + u % 90) for u, f in pairs]
    chosen = exact.spread("file", stripe, 6, nodes, method)
    assert chosen == exact.spread("file", stripe, 6, list(reversed(nodes)), method)
    assert len(set(chosen)) == 6
    family = {u: f for u, f, _ in nodes}
    if len(set(family.values())) >= 6:
        assert len({family[u] for u in chosen}) == 6


def test_spread_needs_nodes():
    with pytest.raises(ValueError):
        exact.spread("file", 0, 3, [(1, "a", 1), (2, "b", 1)])


def test_weight_matters():
    nodes = [(u, f"f{u}", 100 if u < 3 else 10) for u in range(6)]
    heavy = sum(u < 3 for k in range(300) for u in exact.spread(f"x{k}", 0, 1, nodes))
    assert heavy > 200


def test_fresh_addresses():
    nodes = {1: ("a", 5), 2: ("a", 5), 3: ("b", 9), 4: ("a", 50)}
    assert exact.fresh_addresses([1, 2], nodes) == [1, 3]


@given(st.integers(0, 2**64 - 1), st.integers(1, 500), st.integers(0, 600))
def test_sample(seed, total, size):
    got = exact.sample(seed, total, size)
    assert got == sorted(set(got)) and len(got) == min(size, total) and all(0 <= x < total for x in got)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300), st.integers(1, 8), st.integers(0, 6), st.data())
def test_codec(data, k, m, draw):
    shards = codec.encode(data, k, m)
    lost = draw.draw(st.sets(st.integers(0, k + m - 1), max_size=m))
    left = [None if i in lost else s for i, s in enumerate(shards)]
    assert codec.decode(left, k, m, len(data)) == data
    with pytest.raises(ValueError):
        codec.decode([s if i < k - 1 else None for i, s in enumerate(shards)], k, m, len(data))
