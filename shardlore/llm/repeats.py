"""Removal of repeated passages with run-length indexes.

A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a smaller doc_id, or earlier in the same
document. The corpus is cut as for a prefix-free parse: each window of LENGTH bytes has one anchor, the smallest
hash among its GRAM-byte substrings, which depends on the window's bytes alone. Equal windows so have
equal anchors, and indexes of different anchors never need each other.

1. Runs of windows are told by their anchors' hashes. A task knows by itself which hashes it has seen twice; of these it sends one token to the
   hash's shard, of the others the run. Shards answer with the runs whose hash is repeated elsewhere.
2. The bytes under repeated runs (segments) go to their anchor's shard. A task sends each distinct segment once, with its earliest place, so
   a passage that very many documents share reaches its shard once from a task and not once from a document.
3. A shard builds, for a bounded number of symbols at a time, the run-length Burrows-Wheeler transform of its distinct segments and keeps
   its runs and the samples at their ends: for each run's first row its text position, the position of the row above (the end of the run before), and
   the bytes that the two share. Between samples both positions move on together, so the samples give every suffix's matching statistic:
   how many bytes it shares with the suffix sorted above it, and where that one starts. Windows that share LENGTH bytes
   with the window above are equal; chains of such windows are classes, and each window with an earlier one in its class is marked.
4. Shards answer for the earliest place of each segment only. Repeated runs without an answer are later places of a segment and go whole.

Memory is bounded by SHARD bytes of text on average in a shard (several shards may share a task, one after another), by HELD bytes in a sending task and by BATCH symbols
for an index. An anchor with more distinct surroundings than that is parted by anchors of another hash. Segments are taken for equal only if their bytes
are. Documents are told apart by 96 hash bits of id and text.

Defined results: texts are UTF-8 bytes; a null text is empty and removes nothing; rows equal in doc_id and text are one
document and give equal rows; rows of one doc_id with different texts come in the order of a hash of the text; a null doc_id
comes after all others; an empty table stays empty. Matches never cross documents. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardlore.llm import common, text

LENGTH = 100
#: Long enough that prose rarely repeats it by chance.
GRAM = 36
#: Bytes of text for each shard of anchors, and the most partitions that shards are dealt to.
SHARD, PARTITIONS = 4 << 20, 1 << 16
#: Shards that a task takes one after another. Each file that a task writes starts a process or two (Hadoop's chmod).
TOGETHER = 4
#: Bytes of text whose runs, and of segments, that a task holds back to send each once.
HELD = 16 << 20
#: Windows that a long text is cut to.
PIECE = 4 << 20
#: Windows of one segment at most.
WINDOWS = 77
#: Bytes of data that are hashed at a time; each takes some 50 bytes of memory while it is.
BLOCK = 1 << 20
#: Symbols of one index.
BATCH = 3 << 19
#: How often an anchor that is too common is parted by another hash.
LEVELS = 8
#: Symbols that the first sort compares.
DEPTH = 3
#: Ends a segment; no byte of UTF-8.
SEPARATOR = 255
_RAW = text.stream(41, 256)


def anchors(data: np.ndarray, at: np.ndarray, level: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows whose anchors' hashes are equal: row, first window's start in the data, number of windows, anchor hash, and whether
    the anchor stands more than once under the run, so that windows of the run itself may be equal. level: which hash chooses the anchors."""
    n = len(data) - LENGTH + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none.astype(np.uint64), none.astype(bool)
    # Window starts that stay inside a row.
    inside = np.zeros(n + 1, np.int8)
    long = np.flatnonzero(np.diff(at) >= LENGTH)
    inside[at[long]] += 1
    np.add.at(inside, at[long + 1] - LENGTH + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside[:n]))
    if not len(starts):
        return none, none, none, none.astype(np.uint64), none.astype(bool)
    grams = best = _grams(data, level)
    width, span = LENGTH - GRAM + 1, 1
    while span < width:
        step = min(span, width - span)
        best = np.minimum(best[step:], best[:-step])
        span += step
    mark = best[starts]
    row = np.searchsorted(at, starts, "right") - 1
    first = np.flatnonzero(np.append(True, (mark[1:] != mark[:-1]) | (row[1:] != row[:-1])))
    count = np.diff(np.append(first, len(starts)))
    # Runs are cut to at most WINDOWS windows, which bounds the segments; where a run is cut doesn't matter.
    parts = -(-count // WINDOWS)
    turn = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    first = np.repeat(first, parts) + turn * WINDOWS
    count = np.minimum(np.repeat(count, parts) - turn * WINDOWS, WINDOWS)
    begin, again = starts[first], np.zeros(len(first), bool)
    for low in range(0, len(begin), 1 << 12):
        part = slice(low, low + (1 << 12))
        place = np.arange(width)
        # The anchor's first place under the run's first window and its last place under the run's last window.
        head = begin[part] + grams[begin[part, None] + place].argmin(axis=1)
        end = begin[part] + count[part] - 1
        again[part] = head != end + width - 1 - grams[end[:, None] + place[::-1]].argmin(axis=1)
    return row[first], begin, count, mark[first], again


def _grams(data: np.ndarray, level: int = 0) -> np.ndarray:
    """The hash of each GRAM bytes."""
    total, down = _totals(data)
    with np.errstate(over="ignore"):
        return text.mix((total[GRAM:] - total[:-GRAM]) * down[: len(data) - GRAM + 1] + np.uint64(level) * np.uint64(0x9E3779B97F4A7C15))


def _totals(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = text.Powers.to(len(data))
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_RAW[data] * up[: len(data)], out=total[1:])
    return total, down


def _stretches(begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[slice, slice]]:
    """Parts of segments that come in the order of their begins, and the stretch of data under each part, of about BLOCK bytes."""
    low = 0
    while low < len(begin):
        high = int(np.searchsorted(begin, begin[low] + BLOCK))
        yield slice(low, high), slice(int(begin[low]), int(end[low:high].max()))
        low = high


def _marks(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The anchor hash of the windows that start at `begin`, in ascending order."""
    out = np.empty(len(begin), np.uint64)
    for part, under in _stretches(begin, begin + LENGTH):
        grams, at, own = _grams(data[under]), begin[part] - under.start, out[part]
        for low in range(0, len(at), 1 << 13):
            own[low : low + (1 << 13)] = grams[at[low : low + (1 << 13), None] + np.arange(LENGTH - GRAM + 1)].min(axis=1)
    return out


def _eight(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, read where they stand; zeros follow the data."""
    padded = np.zeros(len(data) + LENGTH + WINDOWS + 16, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))


def shared(eight: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many bytes from places a and b on are equal, `most` at most."""
    out, live, done = most.copy(), np.flatnonzero(most > 0), 0
    while len(live):
        other = eight[a[live] + done] ^ eight[b[live] + done]
        apart = np.flatnonzero(other)
        # The lowest byte that isn't zero: its bits below the lowest set one are counted in a float's exponent.
        lowest = np.frexp((other[apart] & (~other[apart] + np.uint64(1))).astype(np.float64))[1] - 1
        out[live[apart]] = np.minimum(out[live[apart]], done + lowest // 8)
        done += 8
        live = live[(other == 0) & (most[live] > done)]
    return out


def _distinct(data: np.ndarray, begin: np.ndarray, size: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Of each distinct segment the number of its earliest place, in ascending order; begin ascends, too. Hashes bring equal segments together, bytes decide."""
    content = np.empty(len(begin), np.uint64)
    for part, under in _stretches(begin, begin + size):
        total, down = _totals(data[under])
        at = begin[part] - under.start
        with np.errstate(over="ignore"):
            content[part] = text.mix((total[at + size[part]] - total[at]) * down[at] + size[part].astype(np.uint64))
    order = np.lexsort((place, content))
    new = np.append(True, content[order][1:] != content[order][:-1])[: len(order)]
    first = order[new][np.cumsum(new) - 1]
    alike = (size[order] == size[first]) & (shared(_eight(data), begin[order], begin[first], np.minimum(size[order], size[first])) == size[order])
    return np.sort(order[new | ~alike])


def _rank(*ids: np.ndarray) -> np.ndarray:
    """The number of each document in the order of ids, the first one first."""
    order = np.lexsort(ids[::-1])
    new = np.zeros(len(order), bool)
    for x in ids:
        new[1:] |= x[order][1:] != x[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _gather(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of the segments, one after another."""
    at = np.cumsum(size)
    out = np.empty(int(at[-1]) if len(at) else 0, np.uint8)
    for part, under in _stretches(at - size, at):
        out[under] = data[np.arange(under.start, under.stop) + np.repeat((begin - at + size)[part], size[part])]
    return out


# Rows packed by a number (a shard of anchors, or a bucket of documents): columns of fixed-width numbers as bytes.


def _packed(number: np.ndarray, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not len(number):
        return
    order = np.argsort(number, kind="stable")
    numbers, first = np.unique(number[order], return_index=True)
    for n, pick in zip(numbers.tolist(), np.split(order, first[1:]), strict=True):
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), *(pa.array([_planes(c[pick])], pa.binary()) for c in columns.values())], ["number", *columns])


def _planes(values: np.ndarray) -> bytes:
    """Numbers as planes of bytes, which compress far better."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _opened(tables: list[pa.RecordBatch], column: str, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    cells = [c for t in tables for c in t.column(column).to_pylist()]
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(c, np.uint8).reshape(width, -1).T.copy().view(kind).reshape(-1) for c in cells)])


def _dealt(df: DataFrame, shards: int) -> DataFrame:
    """df by number, the numbers dealt to partitions in turn, which hashes would do unevenly."""
    parts = min(-(-shards // TOGETHER), PARTITIONS)
    return df.repartitionById(parts, (F.col("number") % parts).cast("int")).sortWithinPartitions("number")


def _shard_of(marks: np.ndarray, shards: int) -> np.ndarray:
    return (marks >> np.uint64(32)).astype(np.int64) % shards


RUNS = "number int, keys binary, checks binary, marks binary, starts binary, counts binary"


def runs(docs: DataFrame, shards: int) -> DataFrame:
    """Every anchor's run of windows. docs: key, check, text.

    Rows without marks are runs whose hash the task has seen twice, packed by bucket of key; the others are runs of hashes that it has
    seen once, packed by shard, and tokens (of no window) for the hashes that it has seen twice.
    """

    def send(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        key, check, mark, start, count, again = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(mark, kind="stable")
        same = mark[order][1:] == mark[order][:-1]
        twice = np.empty(len(order), bool)
        twice[order] = np.append(same, False) | np.append(False, same)
        twice |= again
        token = np.unique(mark[twice], return_index=True)[1]
        token = np.flatnonzero(twice)[token]
        known, once = np.flatnonzero(twice), np.append(np.flatnonzero(~twice), token)
        for rows in _packed(key[known] % shards, keys=key[known], checks=check[known], starts=start[known], counts=count[known].astype(np.uint8)):
            yield rows.add_column(3, "marks", pa.array([None], pa.binary()))
        windows = np.where(twice[once], 0, count[once]).astype(np.uint8)
        yield from _packed(_shard_of(mark[once], shards), keys=key[once], checks=check[once], marks=mark[once].astype(np.uint32), starts=start[once], counts=windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for part in text.chunks(batch, "text"):
                data, at = text.flat(part.column("text"))
                keys, checks = part.column("key").to_numpy(), part.column("check").to_numpy()
                # A chunk above PIECE is one long text.
                for low in range(0, max(1, len(data)), PIECE) if len(data) > PIECE else (0,):
                    piece = data[low : low + PIECE + LENGTH - 1] if len(data) > PIECE else data
                    row, start, count, mark, again = anchors(piece, np.array([0, len(piece)]) if len(data) > PIECE else at)
                    held.append((keys[row], checks[row], mark, (start - at[row] + low).astype(np.int32), count, again))
                size += len(data)
                if size >= HELD:
                    yield from send(held)
                    held, size = [], 0
        if held:
            yield from send(held)

    return docs.select("key", "check", "text").mapInArrow(run, RUNS)


PLACES = "number int, keys binary, checks binary, starts binary, counts binary"


def _places(tables: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return tuple(_opened(tables, c, t) for c, t in (("keys", np.int64), ("checks", np.int32), ("starts", np.int32), ("counts", np.uint8)))


def repeated(found: DataFrame, shards: int) -> DataFrame:
    """The runs whose anchor hash occurs more than once, packed by bucket of key. found: `runs`.

    Shards are told by the hash's upper half and compare its lower one: a chance match costs a look, not a wrong result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in common.groups(batches, "number"):
            unknown = table.column("marks").is_valid()
            yield from table.filter(pc.invert(unknown)).select([c.split()[0] for c in PLACES.split(", ")]).to_batches()
            tables = table.filter(unknown).to_batches()
            key, check, start, count = _places(tables)
            mark = _opened(tables, "marks", np.uint32)
            order = np.argsort(mark)
            same = mark[order][1:] == mark[order][:-1]
            twice = order[np.append(same, False) | np.append(False, same)] if len(order) else order
            twice = twice[count[twice] > 0]
            yield from _packed(key[twice] % shards, keys=key[twice], checks=check[twice], starts=start[twice], counts=count[twice])

    return _dealt(found, shards).mapInArrow(run, PLACES)


def _per_key(key: np.ndarray, check: np.ndarray, start: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each document of places in the order of documents."""
    if not len(key):
        return
    first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (check[1:] != check[:-1])))

    def cells(values: np.ndarray) -> pa.Array:
        offsets = np.append(first, len(values)).astype(np.int32) * values.itemsize
        return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])

    yield pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array(check[first]), cells(start), cells(count)], ["key", "check", "starts", "counts"])


DOCUMENTS = "key bigint, check int, starts binary, counts binary"


def per_document(wanted: DataFrame, shards: int) -> DataFrame:
    """The repeated runs of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in common.groups(batches, "number"):
            key, check, start, count = _places(table.to_batches())
            order = np.lexsort((start, check, key))
            key, check, start, count = key[order], check[order], start[order], count[order]
            new = np.append(True, (key[1:] != key[:-1]) | (check[1:] != check[:-1]) | (start[1:] != start[:-1]))[: len(key)]
            yield from _per_key(key[new], check[new], start[new], count[new])

    return _dealt(wanted, shards).mapInArrow(run, DOCUMENTS)


def removals(wanted: DataFrame, answers: DataFrame, shards: int) -> DataFrame:
    """The runs of windows of each document that also start earlier: repeated runs without an answer, and those that answers name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in common.groups(batches, "number"):
            tables = table.to_batches()
            key, check, start, count = _places(tables)
            answer = np.repeat([a for t in tables for a in t.column("answer").to_pylist()], [len(c) for t in tables for c in t.column("counts").to_pylist()])
            # 0: a repeated run; 1: it is its segment's earliest place; 2: windows with an earlier one.
            kind = np.where(answer, np.where(count > 0, 2, 1), 0)
            order = np.lexsort((kind, start, check, key))
            key, check, start, count, kind = key[order], check[order], start[order], count[order], kind[order]
            new = np.append(True, (key[1:] != key[:-1]) | (check[1:] != check[:-1]) | (start[1:] != start[:-1]))[: len(key)]
            place = np.cumsum(new) - 1
            earliest = np.zeros(int(place[-1]) + 1 if len(place) else 0, bool)
            earliest[place[kind == 1]] = True
            once = new | np.append(True, kind[1:] != kind[:-1])[: len(key)]
            go = once & ((kind == 2) | ((kind == 0) & ~earliest[place]))
            yield from _per_key(key[go], check[go], start[go], count[go])

    both = wanted.withColumn("answer", F.lit(False)).union(answers.withColumn("answer", F.lit(True)))
    return _dealt(both, shards).mapInArrow(run, DOCUMENTS)


SEGMENTS = "number int, keys binary, checks binary, ids binary, starts binary, marks binary, sizes binary, bytes binary"
_KINDS = {"keys": np.int64, "checks": np.int32, "ids": np.int64, "starts": np.int32, "marks": np.uint64, "sizes": np.uint8}


def segments(docs: DataFrame, wanted: DataFrame, shards: int) -> DataFrame:
    """The distinct segments under the wanted runs with their earliest places, packed by shard. docs: key, check, doc_id, text; wanted: `per_document`."""
    joined = docs.select("key", "check", "doc_id", "text").join(wanted, ["key", "check"])

    def send(held: list[dict]) -> Iterator[pa.RecordBatch]:
        whole = {c: np.concatenate([h[c] for h in held]) for c in (*_KINDS, "bytes")}
        size = whole["sizes"].astype(np.int64)
        begin = np.cumsum(size) - size
        one = _distinct(whole["bytes"], begin, size, _rank(whole["ids"], whole["keys"], whole["checks"]) << 32 | whole["starts"])
        number = _shard_of(whole["marks"][one], shards)
        order = np.argsort(number, kind="stable")
        one, number = one[order], number[order]
        cuts = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
        sent = _packed(number, **{c: whole[c][one] for c in _KINDS})
        for rows, pick in zip(sent, np.split(one, cuts[1:]), strict=True):
            yield rows.append_column("bytes", pa.array([_gather(whole["bytes"], begin[pick], size[pick]).tobytes()], pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        sum_of = 0
        for batch in batches:
            for part in text.chunks(batch, "text"):
                data, at = text.flat(part.column("text"))
                start = [np.frombuffer(x, np.int32) for x in part.column("starts").to_pylist()]
                row = np.repeat(np.arange(part.num_rows), [len(s) for s in start])
                size = np.frombuffer(b"".join(part.column("counts").to_pylist()), np.uint8).astype(np.int64) + LENGTH - 1
                start = np.concatenate(start)
                begin = start + at[row]
                # A null id comes after all others.
                ids = part.column("doc_id").fill_null((1 << 63) - 1).to_numpy()
                key, check = part.column("key").to_numpy(), part.column("check").to_numpy()
                place = _rank(ids, key, check)[row] << 32 | start
                # A long text is a chunk by itself, taken stretch by stretch.
                for some, under in _stretches(begin, begin + size):
                    body, at = data[under], begin[some] - under.start
                    one = _distinct(body, at, size[some], place[some])
                    at, one = at[one], one + some.start
                    own = row[one]
                    held.append({"keys": key[own], "checks": check[own], "ids": ids[own], "starts": start[one], "marks": _marks(body, at), "sizes": size[one].astype(np.uint8), "bytes": _gather(body, at, size[one])})
                    sum_of += int(size[one].sum())
                    if sum_of >= HELD:
                        yield from send(held)
                        held, sum_of = [], 0
        if held:
            yield from send(held)

    return joined.mapInArrow(run, SEGMENTS)


class RunIndex:
    """The run-length Burrows-Wheeler transform of segments, with samples at the ends of its runs.

    data: the segments' bytes, each ended by SEPARATOR; size: their lengths without it. Kept are each run's symbol (0 for the separators, all of which
    differ and so are runs by themselves) and length, and, in the order of the text, the positions of the runs' first rows, those of the
    rows above them, which are the last ones of the runs before, and the bytes that the two rows share.
    """

    def __init__(self, data: np.ndarray, size: np.ndarray):
        n = len(data)
        owner = np.repeat(np.arange(len(size), dtype=np.int32), size + 1)
        end = np.cumsum(size + 1) - 1
        symbol = data.astype(np.int16) + 1
        symbol[end] = 0
        order = self._sort(symbol, owner, int(size.max()) + 1)
        before = np.where(order > 0, symbol[order - 1], 0)
        heads = np.flatnonzero(np.append(True, (before[1:] != before[:-1]) | (before[1:] == 0)))
        self.symbols, self.lengths = before[heads], np.diff(np.append(heads, n))
        at, above = order[heads], np.append(-1, order[heads[1:] - 1])
        del order, before, heads
        by_text = np.argsort(at)
        self.at, self.above = at[by_text], above[by_text]
        del at, above, by_text
        self.shared, eight = np.empty(len(self.at), np.int64), _eight(data)
        for low in range(0, len(self.at), 1 << 17):
            part = slice(low, low + (1 << 17))
            own, other = self.at[part], np.maximum(self.above[part], 0)
            most = np.where(self.above[part] < 0, 0, np.minimum(end[owner[own]] - own, end[owner[other]] - other))
            self.shared[part] = shared(eight, own, other, most)

    @staticmethod
    def _sort(symbol: np.ndarray, owner: np.ndarray, longest: int) -> np.ndarray:
        """Suffix order by prefix doubling. A separator is smaller than any byte; separators are told apart by their segment.

        Keys and positions are packed into one 64-bit number where they fit, since sorting numbers is much faster than sorting positions by them.
        Few numbers of 64 bits are held for a symbol at any time: two indexes are built at once in an executor.
        """
        n = len(symbol)
        ended, key = np.zeros(n, bool), np.zeros(n, np.int64)
        for k in range(DEPTH):
            shifted = np.zeros(n, np.int16)
            shifted[: n - k] = symbol[k:]
            ended |= shifted == 0
            shifted[ended] = 0
            key <<= 9
            key |= shifted
        order, rank = RunIndex._order(key, np.where(ended, owner + np.int32(1), np.int32(0)))
        del ended, key, shifted
        depth = DEPTH
        while depth < longest and rank[order[-1]] < n - 1:
            del order
            following = np.zeros(n, np.int64)
            following[: n - depth] = rank[depth:]
            order, rank = RunIndex._order(rank, following)
            depth *= 2
        return order

    @staticmethod
    def _order(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the order of (high, low), and the rank of each position; equal keys have equal ranks."""
        n = len(high)
        place = n.bit_length()
        width = int(low.max()).bit_length()
        if int(high.max()).bit_length() + width + place < 64:
            packed = high << width
            packed |= low
            packed <<= place
            packed |= np.arange(n)
            packed.sort()
            order = packed & ((1 << place) - 1)
            packed >>= place
            new = packed[1:] != packed[:-1]
            del packed
        else:
            order = np.lexsort((low, high))
            new = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(False, new))
        return order, rank

    def statistics(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the suffix sorted above each of these starts, and how many bytes the two share (none or less: nothing)."""
        run = np.searchsorted(self.at, places, "right") - 1
        step = places - self.at[run]
        return self.above[run] + step, self.shared[run] - step


def earlier(data: np.ndarray, begin: np.ndarray, size: np.ndarray, place: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """For each window of each segment, the windows of a segment side by side, whether an equal one has an earlier place.

    place: of the segments' first windows, in the order of documents (document << 32 | start).
    """
    windows = size - LENGTH + 1
    out = np.zeros(int(windows.sum()), bool)
    _earlier(out, data, begin, size, place, mark, np.cumsum(windows) - windows, 0)
    return out


def _earlier(out: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray, place: np.ndarray, mark: np.ndarray, slot: np.ndarray, level: int) -> None:
    by_mark = np.argsort(mark, kind="stable")
    total, sorted_marks, low = np.cumsum(size[by_mark] + 1), mark[by_mark], 0
    while low < len(mark):
        done = int(total[low - 1]) if low else 0
        # Whole anchors, as many as fit, but one at least.
        high = int(np.searchsorted(total, done + BATCH, "right"))
        if high < len(mark):
            high = int(np.searchsorted(sorted_marks, sorted_marks[high], "left"))
        if high <= low:
            high = int(np.searchsorted(sorted_marks, sorted_marks[low], "right"))
        part = by_mark[low:high]
        if total[high - 1] - done > BATCH and level < LEVELS:
            held = _gather(data, begin[part], size[part])
            at = np.append(0, np.cumsum(size[part]))
            # Anchors are chosen for about BLOCK bytes of segments at a time.
            found = []
            for rows, under in _stretches(at[:-1], at[1:]):
                row, start, count, other, _ = anchors(held[under], at[rows.start : rows.stop + 1] - under.start, level + 1)
                found.append((row + rows.start, start + under.start, count, other))
            row, start, count, other = (np.concatenate(x) for x in zip(*found, strict=True))
            offset = start - at[row]
            _earlier(out, held, start, count + LENGTH - 1, place[part][row] + offset, other, slot[part][row] + offset, level + 1)
        else:
            _classes(out, data, begin[part], size[part], place[part], slot[part])
        low = high


def _classes(out: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray, place: np.ndarray, slot: np.ndarray) -> None:
    """The windows of one index: chains of equal ones, each of which is told its chain's earliest place."""
    ended = np.full(int((size + 1).sum()), SEPARATOR, np.uint8)
    first = np.cumsum(size + 1) - (size + 1)
    ended[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = _gather(data, begin, size)
    index = RunIndex(ended, size)
    windows = size - LENGTH + 1
    offset = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    position = np.repeat(first, windows) + offset
    place = np.repeat(place, windows) + offset
    number = np.empty(len(ended), np.int64)
    number[position] = np.arange(len(position))
    above, alike = index.statistics(position)
    up = np.arange(len(position))
    linked = alike >= LENGTH
    up[linked] = number[above[linked]]
    while True:
        further = up[up]
        if (further == up).all():
            break
        up = further
    least = place.copy()
    np.minimum.at(least, up, place)
    out[np.repeat(slot, windows) + offset] = least[up] < place


def _stretched(gone: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of marked windows of each segment: segment, first window and number of windows. windows: of each segment, which stand side by side."""
    edge = np.cumsum(windows) - windows
    new, last = gone.copy(), gone.copy()
    new[1:] &= ~gone[:-1]
    last[:-1] &= ~gone[1:]
    new[edge] = gone[edge]
    last[edge + windows - 1] = gone[edge + windows - 1]
    first = np.flatnonzero(new)
    owner = np.searchsorted(edge, first, "right") - 1
    return owner, first - edge[owner], np.flatnonzero(last) - first + 1


def answers(packed: DataFrame, shards: int) -> DataFrame:
    """For the earliest place of each segment: a run of no window, and the runs of windows that also start earlier; packed by bucket of key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in common.groups(batches, "number"):
            tables = table.to_batches()
            key, check, ids, start, mark, size = (_opened(tables, c, t) for c, t in _KINDS.items())
            held = np.concatenate([text.flat(t.column("bytes"))[0] for t in tables])
            del table, tables
            size = size.astype(np.int64)
            begin = np.cumsum(size) - size
            place = _rank(ids, key, check) << 32 | start
            # Equal segments from different tasks become one.
            one = _distinct(held, begin, size, place)
            key, check, start, size = key[one], check[one], start[one], size[one]
            gone = earlier(held, begin[one], size, place[one], mark[one])
            owner, offset, count = _stretched(gone, size - LENGTH + 1)
            starts, counts = np.append(start, start[owner] + offset).astype(np.int32), np.append(np.zeros(len(one)), count).astype(np.uint8)
            key, check = np.append(key, key[owner]), np.append(check, check[owner])
            yield from _packed(key % shards, keys=key, checks=check, starts=starts, counts=counts)

    return _dealt(packed, shards).mapInArrow(run, PLACES)


def _removed(body: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The maximal runs of bytes under these runs of windows (first byte, end), which come in the order of their starts, and the bytes beside them."""
    if not len(start):
        return np.zeros((0, 2), np.int64), body.tobytes()
    reach = np.maximum.accumulate(start.astype(np.int64) + count + LENGTH - 1)
    new = np.flatnonzero(np.append(True, start[1:] > reach[:-1]))
    spans = np.stack([start[new], reach[np.append(new[1:], len(start)) - 1]], axis=1)
    edges = np.concatenate([[0], spans.ravel(), [len(body)]]).reshape(-1, 2)
    return spans, b"".join(body[a:b].tobytes() for a, b in edges.tolist())


def remove(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, the removed spans (byte offsets, end exclusive) and the kept bytes of each document."""
    common.prepare(docs.sparkSession)
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumns({"key": F.xxhash64(F.lit(6), "doc_id", "text"), "check": F.hash("text", "doc_id")})
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(16, -(-size // SHARD))
    wanted = common.stage(repeated(runs(keyed, shards), shards), "repeated")
    found = common.stage(answers(segments(keyed, per_document(wanted, shards), shards), shards), "earliest")
    joined = keyed.join(removals(wanted, found, shards), ["key", "check"], "left")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.chunks(batch, "text"):
                data, at = text.flat(part.column("text"))
                sizes, spans, kept = [], [], []
                for k, (starts, counts) in enumerate(zip(part.column("starts").to_pylist(), part.column("counts").to_pylist(), strict=True)):
                    body = data[at[k] : at[k + 1]]
                    found, rest = _removed(body, np.frombuffer(starts or b"", np.int32), np.frombuffer(counts or b"", np.uint8))
                    sizes.append(len(body))
                    spans.append([{"start": a, "end": b} for a, b in found.tolist()])
                    kept.append(rest)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return joined.select("doc_id", "text", "starts", "counts").mapInArrow(run, "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")


def report(docs: DataFrame) -> DataFrame:
    """The digest of `remove`."""
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return remove(docs).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: repeated passages in all documents."""
    return report(common.table(spark, sf_dir, "documents"))
