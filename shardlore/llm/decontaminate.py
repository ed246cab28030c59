"""Benchmark decontamination with a distributed positional inverted index.

The corpus is indexed by document shards of a few megabytes. A shard's index holds, for each term of
the index vocabulary, the ascending word positions at which it stands; it is one row of a stored
table, so a lookup runs where the row is read and nothing is shuffled. A phrase is looked up by
its terms' posting lists, rarest first: each list is shifted back by the term's place in the phrase
and intersected with the places that are left. Proximity lookups keep the places of the rarest term
that have every other term within a given distance in the same document.

Defined results: a null text has no words; a null doc_id keeps its row; documents without words
are reported with zeros; repeated document rows are reported once each; a benchmark item without
words matches nothing; repeated benchmark rows count once by item_id; words of an item whose
item_id is null are hit like others, but it is neither counted nor named. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardlore.llm import common, text

#: Bytes of text in one shard of the index.
SHARD_BYTES = 4 << 20
#: Consecutive words that count as leaked.
WINDOW = 10
#: Benchmark text that one lookup takes to the tasks; a larger benchmark is looked up block by block.
BLOCK_BYTES = 8 << 20

_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

INDEX = "row_nos array<bigint>, doc_ids array<bigint>, n_words array<bigint>, terms binary, ends binary, postings binary"
MATCHES = "row_no bigint, doc_id bigint, n_words bigint, spans array<struct<first:bigint,last:bigint>>, item_ids array<bigint>"


def tokens(value: str | None) -> list[bytes]:
    """The folded words of one short text."""
    return _WORDS.findall((value or "").encode().lower())


def build_index(docs: DataFrame, kept: np.ndarray | None = None) -> DataFrame:
    """One row per shard: its documents and the postings of its terms.

    kept: sorted hashes of the terms to store; None stores all terms.
    """
    common.prepare(docs.sparkSession)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.chunks(batch, "text", SHARD_BYTES):
                yield _shard(part, kept)

    return docs.select(F.monotonically_increasing_id().alias("row_no"), "doc_id", "text").mapInArrow(shards, INDEX)


def _shard(part: pa.RecordBatch, kept: np.ndarray | None) -> pa.RecordBatch:
    counts, terms, places = [], [], []
    base = 0
    for piece in text.chunks(part, "text"):
        data, at = text.flat(piece.column("text"))
        starts, ends, row = text.words(data, at, text.WORD)
        found = text.hashes(data, starts, ends)
        # A place is the word's number in the shard plus its document's number: no phrase runs on into the next document.
        place = np.arange(len(found)) + row + base
        base += len(found) + piece.num_rows
        counts.append(np.bincount(row, minlength=piece.num_rows))
        if kept is not None:
            mine = _member(kept, found)
            found, place = found[mine], place[mine]
        terms.append(found)
        places.append(place.astype(np.int32))
    found, place = np.concatenate(terms), np.concatenate(places)
    order = np.argsort(found, kind="stable")
    found, place = found[order], place[order]
    last = np.flatnonzero(np.append(found[1:] != found[:-1], True)) if len(found) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([part.column("row_no").to_pylist()], pa.list_(pa.int64())),
            pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())),
            pa.array([np.concatenate(counts)], pa.list_(pa.int64())),
            pa.array([found[last].tobytes()], pa.binary()),
            pa.array([(last + 1).astype(np.int32).tobytes()], pa.binary()),
            pa.array([place.tobytes()], pa.binary()),
        ],
        ["row_nos", "doc_ids", "n_words", "terms", "ends", "postings"],
    )


def _member(among: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value is among the sorted ones; a table of 16-bit prefixes answers most."""
    if not len(among):
        return np.zeros(len(values), bool)
    prefix = np.zeros(1 << 16, bool)
    prefix[among >> np.uint64(48)] = True
    out = prefix[values >> np.uint64(48)]
    likely = np.flatnonzero(out)
    out[likely] = among[np.minimum(np.searchsorted(among, values[likely]), len(among) - 1)] == values[likely]
    return out


class Shard:
    """One row of the index, opened."""

    def __init__(self, row: dict):
        self.counts = np.asarray(row["n_words"], np.int64)
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.ends = np.frombuffer(row["ends"], np.int32)
        self.begins = np.append(0, self.ends[:-1]).astype(np.int32) if len(self.ends) else self.ends
        self.postings = np.frombuffer(row["postings"], np.int32)
        #: The place of each document's first word.
        self.first = np.append(0, np.cumsum(self.counts + 1)[:-1]) if len(self.counts) else self.counts

    def lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each term's postings begin and end; equal where it has none."""
        if not len(self.terms):
            return np.zeros(terms.shape, np.int64), np.zeros(terms.shape, np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        there = self.terms[at] == terms
        return np.where(there, self.begins[at], 0), np.where(there, self.ends[at], 0)

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, places, "right") - 1

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Places at which the terms stand one after another, rarest first."""
        low, high = self.lists(terms)
        order = np.argsort(high - low, kind="stable")
        left = self.postings[low[order[0]] : high[order[0]]] - order[0]
        for k in order[1:]:
            if not len(left):
                break
            other = self.postings[low[k] : high[k]]
            at = np.minimum(np.searchsorted(other, left + k), max(len(other) - 1, 0))
            left = left[other[at] == left + k] if len(other) else left[:0]
        return left

    def near(self, terms: np.ndarray, distance: int) -> np.ndarray:
        """Places of the rarest term that have each other term within `distance` words in the same document."""
        low, high = self.lists(terms)
        order = np.argsort(high - low, kind="stable")
        left = self.postings[low[order[0]] : high[order[0]]]
        for k in order[1:]:
            other = self.postings[low[k] : high[k]]
            if not len(left) or not len(other):
                return left[:0]
            at, home = np.searchsorted(other, left), self.document(left)
            good = np.zeros(len(left), bool)
            for near in (np.maximum(at - 1, 0), np.minimum(at, len(other) - 1)):
                good |= (np.abs(other[near] - left) <= distance) & (self.document(other[near]) == home)
            left = left[good]
        return left


def blocks(items: DataFrame, window: int) -> Iterator[tuple[list, list]]:
    """The benchmark in blocks of bounded size: distinct item ids, and (words, item numbers) per distinct window."""
    ids: list = []
    windows: dict[tuple[int, ...], set[int]] = {}
    size = 0
    for item_id, value in items.select("item_id", "text").toLocalIterator():
        said = tokens(value)
        if not said:
            continue
        size += sum(map(len, said))
        at = np.cumsum([0, *map(len, said)])
        marks = text.hashes(np.frombuffer(b"".join(said), np.uint8), at[:-1], at[1:]).tolist()
        ids.append(item_id)
        for k in range(max(1, len(marks) - window + 1)):
            windows.setdefault(tuple(marks[k : k + window]), set()).add(len(ids) - 1)
        if size > BLOCK_BYTES:
            yield ids, list(windows.items())
            ids, windows, size = [], {}, 0
    if ids:
        yield ids, list(windows.items())


def find(index: DataFrame, ids: list, phrases: list, distance: int | None = None) -> DataFrame:
    """The matches of one block, a row per document: merged word spans and the ids of matching items.

    distance: None asks for exact phrases; a number asks for the phrases' words within that many words of the rarest.
    """
    lengths = sorted({len(terms) for terms, _ in phrases})
    by_length = [(n, np.array([t for t, _ in phrases if len(t) == n], np.uint64), [w for t, w in phrases if len(t) == n]) for n in lengths]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _matches(row, ids, by_length, distance)

    return index.mapInArrow(look, MATCHES)


def _matches(row: dict, ids: list, by_length: list, distance: int | None) -> pa.RecordBatch:
    shard = Shard(row)
    hits: list[tuple[np.ndarray, int, set[int]]] = []
    for n, terms, owners in by_length:
        low, high = shard.lists(terms)
        for k in np.flatnonzero(((high - low) > 0).all(axis=1)):
            places = shard.phrase(terms[k]) if distance is None else shard.near(terms[k], distance)
            if len(places):
                hits.append((places, n if distance is None else 1, owners[k]))
    spans: list[list] = [[] for _ in shard.counts]
    items: list[list] = [[] for _ in shard.counts]
    if hits:
        begins = np.concatenate([p for p, _, _ in hits]).astype(np.int64)
        stops = np.concatenate([p + n for p, n, _ in hits]).astype(np.int64)
        order = np.argsort(begins, kind="stable")
        begins, stops = begins[order], np.maximum.accumulate(stops[order])
        new = np.append(True, begins[1:] > stops[:-1])
        home = shard.document(begins[new])
        tails = stops[np.append(np.flatnonzero(new)[1:] - 1, len(stops) - 1)]
        for d, a, b in zip(home.tolist(), (begins[new] - shard.first[home]).tolist(), (tails - shard.first[home]).tolist(), strict=True):
            spans[d].append({"first": a, "last": b - 1})
        named: dict[int, set] = {}
        for places, _, owners in hits:
            for d in np.unique(shard.document(places)).tolist():
                named.setdefault(d, set()).update(ids[i] for i in owners)
        for d, found in named.items():
            items[d] = sorted(found - {None})
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    return pa.RecordBatch.from_arrays(
        [pa.array(row["row_nos"], pa.int64()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["n_words"], pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.int64()))],
        ["row_no", "doc_id", "n_words", "spans", "item_ids"],
    )


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, spans of leaked words (first and last word, from 0) and the sorted ids of leaked items, for each document.

    The index is stored once; a benchmark of several blocks is looked up block by block and the
    blocks' matches are merged per document.
    """
    terms = np.zeros(0, np.uint64)
    for _, phrases in blocks(items, window):
        terms = np.union1d(terms, np.fromiter({t for words, _ in phrases for t in words}, np.uint64))
    index = common.stage(build_index(docs, terms), "postings")
    found = [find(index, ids, phrases) for ids, phrases in blocks(items, window)] or [find(index, [], [])]
    if len(found) == 1:
        return found[0].drop("row_no")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    grouped = every.groupBy("row_no").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
    )
    merged = F.aggregate(
        "spans",
        F.expr("cast(array() as array<struct<first:bigint,last:bigint>>)"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["last"] + 1 >= s["first"]),
            F.concat(
                F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))),
                F.array(
                    F.struct(
                        F.try_element_at(done, F.lit(-1))["first"].alias("first"),
                        F.greatest(F.try_element_at(done, F.lit(-1))["last"], s["last"]).alias("last"),
                    )
                ),
            ),
        ).otherwise(F.concat(done, F.array(s))),
    )
    return grouped.select("doc_id", "n_words", merged.alias("spans"), "item_ids")


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The digest of `contamination`: n_hit, n_items, items_sha256, contaminated."""
    found = contamination(docs, items)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"] + 1)
    names = F.array_sort(F.transform("item_ids", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: benchmark passages in all documents."""
    return report(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def decide(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs without a leaked window; every column stays.

    Texts decide, not ids: rows with equal texts go or stay together, whatever their ids.
    """
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    found = contamination(docs.select(key.alias("doc_id"), "text"), items)
    name = common.unused(docs, "leaked_text")
    leaked = found.filter(F.size("spans") > 0).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(leaked, key == F.col(name), "left_anti")


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM p),
g AS (
  SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, g.n, s FROM g JOIN p ON g.n = p.n AND g.phrase = p.phrase),
hit AS (SELECT doc_id, count(DISTINCT s + o) AS n_hit FROM (SELECT doc_id, s, unnest(range(0, n)) AS o FROM m) GROUP BY doc_id),
it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names
  FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
