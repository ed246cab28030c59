"""Embedding near-duplicates by collision-counting projections.

Vectors are scaled to length 1 and projected on PROJECTIONS random directions. Each projection of a label's vectors is sorted, block by block, and a
window of half-width WIDTH centred on each query is cut out of it by binary search; a
pair collides in a direction if one lies in the other's window. At cosine 0.93 the difference of two projections is
normal with deviation sqrt(2 - 2 * 0.93) = 0.374, so a pair collides in a direction with probability 0.89 at least, and the
pairs that collide in LEAST of the directions hold all but about 1 pair in 10^4 at the bound (`miss` computes it, and
the tests measure recall against brute force). Those pairs are verified by cosine in double precision.

Collisions are counted for 64 pairs at a time: along a sorted projection the vectors up to each place are a bitmap, a window is the
difference of two of them, and the windows of all directions are added up in six planes of bits. A pair costs a few bit operations for each
direction's word of 64, less than its cosine, and only pairs that pass the count (about 1 in 10^5 unrelated ones) are touched one by one.

Copies (equal components) are put together first and one vector stands for them, with their number. Each label's vectors
are laid in blocks of BLOCK rows, sorted by the first projection, so that a block meets only the blocks within reach of
its windows; a pair of blocks is one unit of work, whatever label it belongs to, and a large label is many units. A unit
returns link counts and a spanning forest of its links, not its pairs. Nothing is dropped: the work on a label grows with the number
of block pairs within a window of the first projection.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and vectors with a null
label, link with nothing and are components of their own, as do vectors of another length than the partner's; a null vec_id links
with nothing, has no component and is kept; rows of one vec_id are one vertex, each counted as a vector; an empty
table stays empty. Other columns are ignored.

All pairs of a label's blocks within reach are counted, so the work grows with the square of a label: windows in one dimension hold a fixed
share of unrelated vectors, and no count of such windows has both this recall and fewer collisions than a part of all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardlore.llm import common, text
from shardlore.llm.components import components

COSINE = 0.93
PROJECTIONS = 32
WIDTH = 0.6
LEAST = 22
#: The first projection only keeps far blocks apart: its reach is so many deviations of a pair at the bound.
REACH = 4.5 * math.sqrt(2 - 2 * COSINE)
BLOCK = 4096
STRIP = 512
#: Planes of bits of a counter that begins at 32 - LEAST, so that the highest plane tells whether LEAST is reached.
PLANES = 6


def miss() -> float:
    """The probability that a pair at the bound collides in fewer than LEAST directions."""
    p = math.erf(WIDTH / math.sqrt(2 - 2 * COSINE) / math.sqrt(2))
    return sum(math.comb(PROJECTIONS, k) * p**k * (1 - p) ** (PROJECTIONS - k) for k in range(LEAST))


def directions(dimensions: int) -> np.ndarray:
    """Fixed random normal directions."""
    bits = text.stream(31, 2 * dimensions * PROJECTIONS) >> np.uint64(11)
    u = (bits.astype(np.float64) + 0.5) / (1 << 53)
    half = len(u) // 2
    return (np.sqrt(-2 * np.log(u[:half])) * np.cos(2 * np.pi * u[half:])).reshape(dimensions, PROJECTIONS)


def units(vectors: DataFrame) -> DataFrame:
    """vec_id, label, unit vector (null if the vector links with nothing) and first projection."""
    common.prepare(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, label = batch.column("embedding"), batch.column("label")
            out, first = [], []
            for k in range(batch.num_rows):
                value = column[k].values if column[k].is_valid and label[k].is_valid else None
                v = None
                if value is not None and len(value) and not value.null_count:
                    v = value.to_numpy(zero_copy_only=False).astype(np.float64)
                    top = np.abs(v).max()
                    v = None if not np.isfinite(top) or top == 0 else v / top
                    v = None if v is None else v / np.sqrt((v * v).sum())
                out.append(v)
                first.append(None if v is None else float(v @ directions_of(len(v))[:, 0]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), label, pa.array([None if v is None else v.tobytes() for v in out], pa.binary()), pa.array(first, pa.float64())],
                ["vec_id", "label", "unit", "first"],
            )

    kind = vectors.schema["label"].dataType.simpleString()
    return vectors.select("vec_id", "label", "embedding").mapInArrow(run, f"vec_id bigint, label {kind}, unit binary, first double")


_KNOWN: dict[int, np.ndarray] = {}


def directions_of(dimensions: int) -> np.ndarray:
    if dimensions not in _KNOWN:
        _KNOWN[dimensions] = directions(dimensions)
    return _KNOWN[dimensions]


def windows(values: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """For each query a bitmap of the values within WIDTH of it: the sorted values up to the window's end without those before it."""
    order = np.argsort(values, kind="stable")
    low, high = (np.searchsorted(values[order], queries + side, at) for side, at in ((-WIDTH, "left"), (WIDTH, "right")))
    upto = np.zeros((len(values) + 1, -(-len(values) // 64)), np.uint64)
    upto[np.arange(1, len(values) + 1), order >> 6] = np.uint64(1) << (order & 63).astype(np.uint64)
    np.bitwise_or.accumulate(upto, axis=0, out=upto)
    return upto[high] ^ upto[low]


def collide(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x and y whose pair collides in LEAST directions."""
    px, py = (v @ directions_of(v.shape[1]) for v in (x, y))
    words = -(-len(y) // 64)
    begin = (1 << PLANES - 1) - LEAST
    planes = [np.full((len(x), words), np.uint64(0xFFFFFFFFFFFFFFFF) if begin >> k & 1 else np.uint64(0)) for k in range(PLANES)]
    for k in range(PROJECTIONS):
        found = windows(py[:, k], px[:, k])
        for top in range(0, len(x), STRIP):
            carry = found[top : top + STRIP]
            for plane in planes[:-1]:
                part = plane[top : top + STRIP]
                over = part & carry
                part ^= carry
                carry = over
            planes[-1][top : top + STRIP] |= carry
    row, word = np.nonzero(planes[-1])
    bits = np.unpackbits(planes[-1][row, word].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, bit = np.nonzero(bits)
    return row[at], word[at] * 64 + bit


def _close(x: np.ndarray, y: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x and y whose pair collides in LEAST directions and whose cosine is at least COSINE; each pair of one block once."""
    i, j = collide(x, y)
    if same:
        i, j = i[i < j], j[i < j]
    good = np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 16):
        part = slice(at, at + (1 << 16))
        good[part] = np.einsum("ij,ij->i", x[i[part]], y[j[part]]) >= COSINE
    return i[good], j[good]


BLOCKS = "label string, block bigint, low double, high double, reps binary, counts binary, units binary"


def blocks(reps: DataFrame, rows: int) -> DataFrame:
    """The representatives (label, unit, first, rep, n) in blocks of a label's neighbours along the first projection."""
    size = F.length("unit")
    # A label's vectors of another length are another label: they link with nothing here.
    kinds = reps.select(F.concat_ws(":", size.cast("string"), F.col("label").cast("string")).alias("label"), "first", "rep", "n", "unit")
    laid = kinds.repartitionByRange(max(1, rows // (2 * BLOCK)), "label", "first", "rep").sortWithinPartitions("label", "first", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: list[pa.Table] = []

        def flush():
            nonlocal number, held
            table, held = pa.concat_tables(held), []
            first = table.column("first").to_numpy()
            cells = [
                table.column("label")[0].as_py(),
                part << 32 | number,
                float(first[0]),
                float(first[-1]),
                table.column("rep").to_numpy().tobytes(),
                table.column("n").to_numpy().tobytes(),
                b"".join(table.column("unit").to_pylist()),
            ]
            number += 1
            types = [pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types, strict=True)], [f.split()[0] for f in BLOCKS.split(", ")])

        for batch in batches:
            labels = batch.column("label").to_pylist()
            at = 0
            while at < len(labels):
                have = sum(t.num_rows for t in held)
                if held and (have >= BLOCK or held[0].column("label")[0].as_py() != labels[at]):
                    yield flush()
                    have = 0
                end = at
                while end < len(labels) and labels[end] == labels[at] and end - at < BLOCK - have:
                    end += 1
                held.append(pa.Table.from_batches([batch.slice(at, end - at)]))
                at = end
        if held:
            yield flush()

    return common.stage(laid.mapInArrow(run, BLOCKS), "blocks")


def meet(laid: DataFrame) -> DataFrame:
    """rep, links (a unit's count of its linked vectors) and other (a representative of the same component, or null), for each unit."""
    ends = laid.select("label", "block", "low", "high")
    other = ends.select("label", F.col("block").alias("block2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    after = (F.col("low2") > F.col("low")) | ((F.col("low2") == F.col("low")) & (F.col("block2") >= F.col("block")))
    pairs = ends.join(other, "label").filter(after & (F.col("low2") <= F.col("high") + REACH)).select("block", "block2")
    left = laid.select("block", F.col("reps").alias("reps_x"), F.col("counts").alias("counts_x"), F.col("units").alias("units_x"))
    right = laid.select(F.col("block").alias("block2"), F.col("reps").alias("reps_y"), F.col("counts").alias("counts_y"), F.col("units").alias("units_y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                same = row["block"] == row["block2"]
                reps = [np.frombuffer(row[c], np.int64) for c in ("reps_x", "reps_y")]
                counts = [np.frombuffer(row[c], np.int64) for c in ("counts_x", "counts_y")]
                x, y = (np.frombuffer(row[c], np.float64).reshape(len(r), -1) for c, r in zip(("units_x", "units_y"), reps, strict=True))
                i, j = _close(x, y, same)
                j = j if same else j + len(x)
                rep, count = (reps[0], counts[0]) if same else (np.concatenate(reps), np.concatenate(counts))
                links = np.bincount(i, count[j], minlength=len(rep)) + np.bincount(j, count[i], minlength=len(rep))
                head = np.arange(len(rep))
                while True:
                    before = head.copy()
                    np.minimum.at(head, i, head[j])
                    np.minimum.at(head, j, head[i])
                    head = head[head]
                    if (head == before).all():
                        break
                some = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(links[some].astype(np.int64)), pa.array(rep[head[some]])], ["rep", "links", "other"])

    joined = pairs.join(left, "block").join(right, "block2").repartition(F.col("block"), F.col("block2"))
    return joined.mapInArrow(run, "rep bigint, links bigint, other bigint")


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    known = common.stage(units(vectors), "units")
    able = known.filter("unit is not null and vec_id is not null")
    reps = common.stage(able.groupBy("label", "unit").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("first").alias("first")), "vectors")
    found = common.stage(meet(blocks(reps, reps.count())), "links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    members = able.join(reps.select("label", "unit", "rep", "n"), ["label", "unit"]).join(counts, "rep", "left")
    members = members.select("vec_id", "label", "rep", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
    copies = members.filter("vec_id <> rep").select(F.col("rep").alias("a"), F.col("vec_id").alias("b"))
    merged = components(found.select(F.col("rep").alias("a"), F.col("other").alias("b")).union(copies), "vector_components")
    rows = members.select("vec_id", "links").union(known.filter("unit is null or vec_id is null").select("vec_id", F.lit(0).cast("bigint")))
    component = F.coalesce("component", "vec_id")
    return rows.join(merged, F.col("vec_id") == F.col("id"), "left").select(
        "vec_id", F.col("links").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: near-duplicates among all embeddings."""
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))


#: Components by repeated minima over links; the recursion ends when no smaller vec_id is reached.
SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
p AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}),
r AS (SELECT vec_id AS x, vec_id AS c FROM embeddings UNION SELECT p.y, r.c FROM r JOIN p ON p.x = r.x),
n AS (SELECT x, count(*) AS n_links FROM p GROUP BY x),
m AS (SELECT x, min(c) AS component_id FROM r GROUP BY x)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN m ON m.x = vec_id LEFT JOIN n ON n.x = vec_id
"""
