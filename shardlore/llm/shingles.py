"""Sets of word shingles, as sorted 64-bit hashes, and their minwise values."""

from __future__ import annotations

import numpy as np

from shardlore.llm import text

SIZE = 5
_PLACE = text.stream(21, SIZE) | np.uint64(1)


def sets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct shingle hashes of the rows, one row after another, and where each row's begin (and the last end).

    Words are runs of bytes other than ASCII white space, A-Z folded. A row of fewer than SIZE words, but some, has one shingle of all its words.
    """
    rows = len(at) - 1
    starts, ends, row = text.words(data, at, text.SOLID)
    word = text.hashes(data, starts, ends)
    with np.errstate(over="ignore"):
        n = max(0, len(word) - SIZE + 1)
        full = np.flatnonzero(row[:n] == row[len(row) - n :]) if n else np.zeros(0, np.int64)
        mixed = np.zeros(len(full), np.uint64)
        for k in range(SIZE):
            mixed += word[full + k] * _PLACE[k]
        found, home = text.mix(mixed), row[full]
        many = np.bincount(row, minlength=rows)
        short = np.flatnonzero((many > 0) & (many < SIZE))
        if len(short):
            first = np.searchsorted(row, short)
            alone = np.array([(word[f : f + m] * _PLACE[:m]).sum(dtype=np.uint64) + np.uint64(m) for f, m in zip(first, many[short], strict=True)], np.uint64)
            found, home = np.concatenate([found, text.mix(alone)]), np.concatenate([home, short])
            order = np.argsort(home, kind="stable")
            found, home = found[order], home[order]
    cut = np.searchsorted(home, np.arange(rows + 1))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if b - a > 1:
            found[a:b].sort()
    if len(found):
        new = np.append(True, (found[1:] != found[:-1]) | (home[1:] != home[:-1]))
        found, home = found[new], home[new]
    return found, np.searchsorted(home, np.arange(rows + 1))


def per_row(reduce: np.ufunc, values: np.ndarray, cut: np.ndarray, empty: int = 0) -> np.ndarray:
    """reduce over each row's values; `empty` for rows without any."""
    out = np.full(len(cut) - 1, empty, values.dtype)
    some = np.flatnonzero(cut[1:] > cut[:-1])
    if len(some):
        out[some] = reduce.reduceat(values, cut[some])
    return out


def signature(found: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Two 64-bit sums that tell sets apart."""
    with np.errstate(over="ignore"):
        return np.stack([per_row(np.add, text.mix(found + np.uint64(1)), cut), per_row(np.add, text.mix(found ^ np.uint64(0x5555555555555555)), cut)], axis=1)


def minwise(found: np.ndarray, cut: np.ndarray, count: int) -> np.ndarray:
    """count minwise values (32 bits) of each row's set."""
    out = np.empty((len(cut) - 1, count), np.int32)
    with np.errstate(over="ignore"):
        for k, factor in enumerate(text.stream(22, count) | np.uint64(1)):
            out[:, k] = (per_row(np.minimum, found * factor, cut) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out
