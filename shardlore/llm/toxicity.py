"""Toxicity: a factorization machine over hashed terms, trained here on labelled documents.

Terms are a document's distinct folded words and their first 4, 6 and 8 bytes (stems), hashed into
2^20 buckets. The machine adds to the linear weights a factorised weight for each pair of terms,
so an insult next to a mention of a group can count for more than the two alone.

Training rows: labelled documents outside the held-out fold, at most TRAIN_ROWS of them, taken in the
order of a hash of doc_id (the documented bound of the sample). Their distinct buckets, 4 MB a row at most however long its text,
are gathered on the driver. Buckets are admitted as terms if they tell something about the label by themselves, or only
in a pair: the four cells of two common buckets (neither, one, the other, both) are held against what the two say
apart. The machine is fitted to the terms by AdaGrad on the logistic loss. The model has a fixed size (TERMS + PAIRED rows of
FACTORS + 1 floats and a table of 2^20 entries, under 5 MB) and is sent to the tasks. Scoring reads whole texts.

Defined results: a null or empty text gets the score of no terms; without labelled rows of both
classes every score is the labelled share of 1, or 0 without labels; several labels of one doc_id count as
their maximum; null labels are no labels; a null doc_id is in no fold. Labels, lang, source and doc_id are
never inputs of a score. Repeated rows get equal scores. Other columns stay or are ignored; `score` replaces a column of
the name toxic_score, `decide` keeps it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardlore.llm import common, text

#: At most so many labelled rows are gathered for training.
TRAIN_ROWS = 12_000
BITS = 20
STEMS = (4, 6, 8)
#: Buckets that so many training rows have, with the highest chi-square against the label, above GAIN, are terms.
SEEN, TERMS, GAIN = 3, 8192, 4
#: So are those of the commonest buckets whose pairs tell more than their buckets do, with so many rows in each cell and a squared contrast of so many variances.
PAIRED, CELL, PAIR_GAIN = 1024, 8, 30
#: Training rows whose pairs are counted together.
ROWS = 1024
FACTORS = 8
EPOCHS, BATCH = 12, 128
#: Steps at least, for small samples.
STEPS = 600
#: Deviation of the factors at first; learning rates of linear weights, factors and bias; decay of linear weights and factors.
INIT, RATE, RATE_PAIRS, RATE_BIAS, DECAY, DECAY_PAIRS = 0.02, 0.1, 0.05, 0.3, 2e-3, 5e-3
#: Weight of a toxic row in training; such rows are few.
WEIGHT = 4
#: Scores from here on are predicted toxic.
THRESHOLD = 0.7


def fold(doc_id: Column | str) -> Column:
    """crc32 of doc_id as text, modulo 3; 1 is held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 if isinstance(doc_id, str) else F.crc32(doc_id.cast("string").cast("binary")) % 3


def buckets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and term bucket of each word and stem, with repeats."""
    starts, ends, row = text.words(data, at, text.WORD)
    found = [text.hashes(data, starts, ends)]
    rows = [row]
    for n in STEMS:
        long = np.flatnonzero(ends - starts > n)
        found.append(text.hashes(data, starts[long], starts[long] + n) + np.uint64(n))
        rows.append(row[long])
    return np.concatenate(rows), (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text.chunks(batch, "text"):
            row, term = buckets(*text.flat(part.column("text")))
            pair = np.unique((row << BITS) | term)
            cut = np.searchsorted(pair, np.arange(1, part.num_rows) << BITS)
            terms = np.split((pair & ((1 << BITS) - 1)).astype(np.int32), cut)
            yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array([t.tobytes() for t in terms], pa.binary())], ["toxic", "terms"])


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """toxic and the packed term buckets of the training documents, TRAIN_ROWS at most."""
    common.prepare(docs.sparkSession)
    chosen = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id") != 1))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(TRAIN_ROWS)
    )
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text").mapInArrow(_features, "toxic int, terms binary")


class Machine:
    """A fitted factorization machine: score = sigmoid(bias + sum w + sum over pairs <v, v>)."""

    def __init__(self, bias: float, slots: np.ndarray, w: np.ndarray, v: np.ndarray):
        self.bias, self.slots, self.w, self.v = bias, slots, w, v

    def raw(self, row: np.ndarray, slot: np.ndarray, rows: int) -> np.ndarray:
        """Log-odds of rows, given the distinct (row, slot) pairs in ascending order."""
        out = np.full(rows, self.bias)
        if len(row):
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            v = self.v[slot]
            both = np.add.reduceat(v, first) ** 2 - np.add.reduceat(v * v, first)
            out[row[first]] += np.add.reduceat(self.w[slot], first) + 0.5 * both.sum(axis=1)
        return out

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        row, term = buckets(data, at)
        slot = self.slots[term]
        known = slot >= 0
        pair = np.unique(row[known] << BITS | slot[known])
        return 1 / (1 + np.exp(-np.clip(self.raw(pair >> BITS, pair & ((1 << BITS) - 1), len(at) - 1), -30, 30)))


def admitted(term: np.ndarray, row: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The buckets that tell something about the label, by themselves (chi-square) or only beside another bucket (contrast of the four cells)."""
    n, pos = len(y), float(y.sum())
    seen = np.bincount(term, minlength=1 << BITS).astype(np.float64)
    toxic = np.bincount(term, y[row], minlength=1 << BITS)
    spread = seen * (n - seen) * pos * (n - pos)
    gain = np.where((seen >= SEEN) & (spread > 0), n * (toxic * n - seen * pos) ** 2 / np.maximum(spread, 1), 0)
    alone = np.argsort(-gain, kind="stable")[:TERMS]
    alone = alone[gain[alone] > GAIN]
    # Pairs: the commonest buckets that some rows lack.
    varied = np.where((seen >= CELL) & (n - seen >= CELL), seen, 0)
    common_ones = np.argsort(-varied, kind="stable")[:PAIRED]
    common_ones = common_ones[varied[common_ones] > 0]
    column = np.full(1 << BITS, -1, np.int32)
    column[common_ones] = np.arange(len(common_ones))
    both, both_toxic = np.zeros((2, len(common_ones), len(common_ones)), np.float32)
    for low in range(0, n, ROWS):
        here = slice(*np.searchsorted(row, [low, low + ROWS]))
        at, x = column[term[here]], np.zeros((min(ROWS, n - low), len(common_ones)), np.float32)
        x[row[here][at >= 0] - low, at[at >= 0]] = 1
        both += x.T @ x
        both_toxic += x.T @ (x * y[low : low + ROWS, None].astype(np.float32))
    one, one_toxic = np.diag(both).astype(np.float64), np.diag(both_toxic).astype(np.float64)
    told = np.zeros(len(common_ones), bool)
    for k in range(len(common_ones)):
        cells = (
            (both[k], both_toxic[k], 1),
            (one[k] - both[k], one_toxic[k] - both_toxic[k], -1),
            (one - both[k], one_toxic - both_toxic[k], -1),
            (n - one[k] - one + both[k], pos - one_toxic[k] - one_toxic + both_toxic[k], 1),
        )
        contrast, variance, least = np.zeros(len(one)), np.zeros(len(one)), np.full(len(one), np.inf)
        for size, found, sign in cells:
            share = (found + 0.5) / (size + 1)
            contrast, variance, least = contrast + sign * share, variance + share * (1 - share) / (size + 1), np.minimum(least, size)
        told[k] = ((least >= CELL) & (contrast**2 > PAIR_GAIN * variance)).any()
    return np.union1d(alone, common_ones[told])


def fit(rows: list[tuple[int, bytes]]) -> Machine:
    """Fit on (label, packed buckets); the same rows in any order give the same machine."""
    rows = sorted((int(y > 0), bytes(t)) for y, t in rows)
    y = np.array([a for a, _ in rows], np.float32)
    slots = np.full(1 << BITS, -1, np.int32)
    none = Machine(0.0, slots, np.zeros(1), np.zeros((1, FACTORS)))
    if not len(y) or y.min() == y.max():
        none.bias = 30.0 if len(y) and y[0] else -30.0
        return none
    n, pos = len(y), float(y.sum())
    term = np.frombuffer(b"".join(t for _, t in rows), np.int32)
    row = np.repeat(np.arange(n, dtype=np.int32), [len(t) // 4 for _, t in rows])
    del rows
    known = admitted(term, row, y)
    slots[known] = np.arange(len(known))
    slot = slots[term]
    row, slot = row[slot >= 0], slot[slot >= 0]
    begin = np.searchsorted(row, np.arange(n + 1))
    random = np.random.default_rng(7)
    w = np.zeros(max(1, len(known)), np.float32)
    v = random.normal(0, INIT, (len(w), FACTORS)).astype(np.float32)
    gw, gv, gb = np.full_like(w, 1e-3), np.full_like(v, 1e-3), 1e-3
    bias = float(np.log(pos / (n - pos)))
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // n))):
        shuffled = random.permutation(n)
        for k in range(0, n, BATCH):
            part = shuffled[k : k + BATCH]
            size = begin[part + 1] - begin[part]
            mine = np.repeat(np.arange(len(part)), size)
            s = slot[np.arange(len(mine)) + np.repeat(begin[part] - (np.cumsum(size) - size), size)]
            vs = v[s]
            some, first = np.flatnonzero(size), (np.cumsum(size) - size)[size > 0]
            total, z = np.zeros((len(part), FACTORS), np.float32), np.full(len(part), bias)
            if len(s):
                total[some] = np.add.reduceat(vs, first)
                z[some] += np.add.reduceat(w[s] - 0.5 * (vs * vs).sum(axis=1), first) + 0.5 * (total[some] ** 2).sum(axis=1)
            g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) * np.where(y[part] > 0, WEIGHT, 1)).astype(np.float32)
            gb += float(g.sum()) ** 2
            bias -= RATE_BIAS * float(g.sum()) / gb**0.5
            if not len(s):
                continue
            order = np.argsort(s, kind="stable")
            turn = np.flatnonzero(np.append(True, s[order][1:] != s[order][:-1]))
            touched = s[order][turn]
            dw = np.add.reduceat(g[mine][order], turn) + DECAY * w[touched]
            dv = np.add.reduceat((g[mine, None] * (total[mine] - vs))[order], turn) + DECAY_PAIRS * v[touched]
            gw[touched] += dw**2
            gv[touched] += dv**2
            w[touched] -= RATE * dw / np.sqrt(gw[touched])
            v[touched] -= RATE_PAIRS * dv / np.sqrt(gv[touched])
    return Machine(bias, slots, w, v)


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    """The machine learnt from the labelled documents."""
    return fit([(r[0], r[1]) for r in training_rows(docs, labels).toLocalIterator()])


def score(docs: DataFrame, model: Machine, name: str = "toxic_score") -> DataFrame:
    """All columns of docs and the score (0 to 1) under `name`."""
    common.prepare(docs.sparkSession)
    docs = docs.drop(name)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.chunks(batch, "text"):
                yield part.append_column(name, pa.array(sent.value.scores(*text.flat(part.column("text")))))

    return docs.mapInArrow(run, kind)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: the toxicity of all documents."""
    docs = common.table(spark, sf_dir, "documents")
    model = train(docs, common.table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id",
        F.coalesce(fold("doc_id") == 1, F.lit(False)).alias("held_out"),
        F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def decide(docs: DataFrame, labelled: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the machine, trained on `labelled` documents, does not predict toxic."""
    name = common.unused(docs, "toxic_score")
    return score(docs, train(labelled, labels), name).filter(F.col(name) < THRESHOLD).select(*docs.columns)
