"""Vectorised word splitting and hashing over the bytes of whole Arrow columns.

Words are found on UTF-8 bytes: both word patterns of the operators keep every byte of a character
above 0x7F together, so byte classes and character classes give the same words. A-Z alone is folded.
Words are compared by a 64-bit hash that mixes eight bytes at a time (XXH3 beyond LONG bytes), so no words
collide by their structure, those of at most eight bytes never, and two others with odds of 2^-64: among 10^6 distinct words the
chance that any two share a hash is about 3e-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: A-Z become a-z, all other bytes stay.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


mix = _mix


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers, the same everywhere."""
    with np.errstate(over="ignore"):
        return _mix(np.uint64(seed) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_SEED = 0x2545F4914F6CDD1D
#: Words of more bytes are hashed one by one.
LONG = 32
#: The low bytes of eight that belong to a word which ends within them.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class Powers:
    """Powers of a rolling hash's base and of its inverse modulo 2^64, grown on demand."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 16)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps, dtype=np.uint64))
        return cls.up, cls.down


def _mask(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are folded, so A-Z count as letters here.
WORD = _mask((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: Bytes of [^\x20\x09-\x0D]+.
SOLID = ~_mask((0x20, 0x20), (0x09, 0x0D))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and where each row starts and the last one ends. Null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def chunks(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about `most` bytes of text; a longer text is a slice by itself."""
    _, at = flat(batch.column(column))
    row = 0
    while row < len(at) - 1:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield batch.slice(row, end - row)
        row = end


def words(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word. No word crosses from one row to the next."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = table[data]
    cut = at[(at > 0) & (at < len(data))]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    before[cut] = False
    after[cut - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, A-Z folded."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    folded = np.zeros(len(data) + 8, np.uint8)
    folded[:-8] = FOLD[data]
    # The eight bytes from each place on, read where they stand.
    eight = np.ndarray(len(data) + 1, "<u8", folded, strides=(1,))
    size = ends - starts
    out = _mix(size.astype(np.uint64) + np.uint64(_SEED))
    live = np.flatnonzero((size > 0) & (size <= LONG))
    done = 0
    while len(live):
        left = size[live] - done
        out[live] = _mix(out[live] ^ (eight[starts[live] + done] & _LOW[np.minimum(left, 8)]))
        done += 8
        live = live[left > 8]
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = xxhash.xxh3_64_intdigest(folded[starts[k] : ends[k]].tobytes(), _SEED)
    return out


def hash_of(word: str) -> int:
    """The hash that `hashes` gives this word."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(hashes(data, np.array([0]), np.array([len(data)]))[0])
