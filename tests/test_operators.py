"""Operators on small tables: cursors, pages, folds, outcomes, snapshots."""

import pytest
from pyspark.sql import functions as F

from shardlore.operators import cluster, folds, history
from shardlore.sources import tables


@pytest.mark.parametrize(("cursor", "size"), [(0, 5), (37, 50), (95, 20), (250, 10), (3, 500)])
def test_from_cursor(spark, cursor, size):
    """Places around the end of the list, with slices of all sizes and ties in the first column."""
    rows = sorted((k * k % 23, k) for k in range(100))
    got = cluster.from_cursor(spark.createDataFrame(rows, "a long, b long"), ["a", "b"], cursor, size, width=4)
    assert sorted(map(tuple, got.collect())) == sorted({rows[(cursor + k) % 100] for k in range(size)})


def test_group_index_pages(spark):
    files = spark.range(500).select(F.sha2(F.col("id").cast("string"), 256).alias("file_hash"))
    pages = sorted(cluster.group_index(files.union(files), 3, page_size=7).collect())
    whole = {}
    for r in pages:
        assert len(r.files) == 7 or r == max((p for p in pages if p.pg == r.pg), key=lambda p: p.page)
        whole.setdefault(r.pg, []).extend(r.files)
    assert all(f == sorted(f) for f in whole.values()) and sum(map(len, whole.values())) == 500


def test_ema(spark):
    rows = [(u, t, (t * 37 + u) % 100 / 7) for u in range(3) for t in range(u * 40 + 1)]
    got = {r.uid: (r.n, r.ema) for r in folds.ema(spark.createDataFrame(rows, "uid long, ts long, v double"), "uid", ["ts"], "v").collect()}
    for u in range(3):
        mine = [v for x, _, v in rows if x == u]
        c = mine[0]
        for v in mine[1:]:
            c += 0.2 * (v - c)
        assert got[u][0] == len(mine) and abs(got[u][1] - c) < 1e-9


def test_answered(spark):
    asked = [(1, 100), (1, 3700), (1, 7300), (2, 50), (1, 10_000)]
    said = [(1, 3600), (1, 7300), (2, 49), (2, 3651), (3, 60)]
    got = folds.answered(spark.createDataFrame(asked, "uid long, asked long"), spark.createDataFrame(said, "uid long, said long"), 3600).collect()
    assert sorted(map(tuple, got)) == sorted((u, t, any(v == u and t <= s <= t + 3600 for v, s in said)) for u, t in asked)


def test_outcomes(spark):
    """Failures end streaks and ban at 3.0, repeats of a processed audit are skipped, others are invalid."""
    rows = [(k, k, 1, f"a{k}", True, "Failed") for k in range(3)] + [(3, 3, 1, "a0", True, "Failed"), (4, 4, 9, "b", True, "Passed"), (5, 5, 2, "b", True, "Timeout"), (6, 6, 2, "c", False, "Failed"), (7, 7, 2, "b", False, "Failed")]
    rows += [(10 + k, 10 + k, 3, f"d{k}", True, "Failed" if k == 0 else "Passed") for k in range(12)]
    df = spark.createDataFrame(rows, "id long, ts long, uid long, audit string, allowed boolean, result string")
    got = {r.id: (r.outcome, r.score, r.banned) for r in folds.outcomes(df, spark.createDataFrame([(1,), (2,), (3,)], "uid long")).collect()}
    assert [got[k] for k in range(8)] == [("processed", 1.0, False), ("processed", 2.0, False), ("processed", 3.0, True), ("duplicate", None, False), ("invalid", None, False), ("processed", 0.3, False), ("invalid", None, False), ("invalid", None, False)]
    assert [got[10 + k][1] for k in (0, 9, 10, 11)] == [1.0, 1.0, 0.95, 0.9]


def test_resting(spark):
    until = spark.createDataFrame([(1, 10), (2, 11)], "uid long, until long")
    got = history.resting(spark.createDataFrame([(1,), (2,), (3,)], "uid long"), until, spark.createDataFrame([(10,)], "now long"))
    assert {r.uid: r.resting for r in got.collect()} == {1: False, 2: True, 3: False}


def test_sync_index(spark):
    files = spark.createDataFrame([(f"h{k}", k, k % 5) for k in range(50)], "file_hash string, size long, epoch long")
    first = history.sync_index(files).first()
    assert first == history.sync_index(files.repartition(7).orderBy(F.desc("size"))).first() and (first.files, first.bytes, first.epoch) == (50, 1225, 4)
    assert history.sync_index(files.filter("size <> 7")).first().digest != first.digest


def test_newest_snapshot(spark, tmp_path):
    for name, block, uids in (("a", 5, [1, 2]), ("b", 9, [3]), ("c", 9, [4])):
        (tmp_path / f"{name}.json").write_text("\n".join(f'{{"at_block": {block}, "uid": {u}}}' for u in uids) + "\n{bad")
    got = tables.snapshots(spark, str(tmp_path), "at_block long, uid long")
    assert sorted(r.uid for r in got.collect()) == [3, 4]
    assert tables.newest(spark.createDataFrame([], "at_block long, uid long")).count() == 0
