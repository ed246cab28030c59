"""Erasure coding of stripes over GF(2^8), vectorised: any k of the k + m shards give the data back."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: The field's polynomial x^8 + x^4 + x^3 + x^2 + 1. Fixed value.
POLYNOMIAL = 0x11D


@lru_cache(1)
def products() -> np.ndarray:
    """The field's multiplication table."""
    power, log = np.zeros(510, np.int64), np.zeros(256, np.int64)
    x = 1
    for k in range(255):
        power[k] = power[k + 255] = x
        log[x] = k
        x = x << 1 ^ (POLYNOMIAL if x & 0x80 else 0)
    table = power[log[:, None] + log[None, :]]
    table[0], table[:, 0] = 0, 0
    return table.astype(np.uint8)


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two matrices over the field."""
    table = products()
    out = np.zeros((a.shape[0], b.shape[1]), np.uint8)
    for k in range(a.shape[1]):
        out ^= table[a[:, k, None], b[None, k]]
    return out


def inverse(matrix: np.ndarray) -> np.ndarray:
    """The inverse by elimination; raises ValueError if there is none."""
    table, n = products(), len(matrix)
    work = np.concatenate([matrix.copy(), np.eye(n, dtype=np.uint8)], axis=1)
    for k in range(n):
        rows = np.flatnonzero(work[k:, k])
        if not len(rows):
            raise ValueError("the matrix has no inverse")
        if rows[0]:
            work[[k, k + rows[0]]] = work[[k + rows[0], k]]
        work[k] = table[np.flatnonzero(table[work[k, k]] == 1)[0], work[k]]
        for other in np.flatnonzero(work[:, k]):
            if other != k:
                work[other] ^= table[work[other, k], work[k]]
    return work[:, n:]


@lru_cache(16)
def generator(k: int, m: int) -> np.ndarray:
    """k + m rows, the first k the identity; any k of them can be inverted."""
    table = products()
    rows = np.ones((k + m, k), np.uint8)
    for j in range(1, k):
        rows[:, j] = table[rows[:, j - 1], np.arange(k + m)]
    rows[0, 1:] = 0
    return multiply(rows, inverse(rows[:k]))


def encode(data: bytes, k: int, m: int) -> list[bytes]:
    """k data shards (padded with zeros) and m parity shards; empty data has empty shards."""
    size = -(-len(data) // k)
    body = np.zeros(k * size, np.uint8)
    body[: len(data)] = np.frombuffer(data, np.uint8)
    body = body.reshape(k, size)
    return [row.tobytes() for row in (*body, *multiply(generator(k, m)[k:], body))]


def decode(shards: list[bytes | None], k: int, m: int, size: int) -> bytes:
    """The first `size` bytes of the data; ValueError with fewer than k shards."""
    have = [i for i, s in enumerate(shards) if s is not None][:k]
    if len(have) < k:
        raise ValueError(f"{k} shards are needed, there are {len(have)}")
    body = np.stack([np.frombuffer(shards[i], np.uint8) for i in have])
    if have != list(range(k)):
        body = multiply(inverse(generator(k, m)[have]), body)
    return body.tobytes()[:size]


def encode_stripes(stripes: DataFrame, k: int, m: int) -> DataFrame:
    """id, idx and shard of each (id, data) row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, n, s) for i, data in zip(frame["id"], frame["data"], strict=True) for n, s in enumerate(encode(bytes(data or b""), k, m))]
            yield pd.DataFrame(rows, columns=["id", "idx", "shard"])

    return stripes.select("id", "data").mapInPandas(run, "id bigint, idx bigint, shard binary")


def decode_stripes(shards: DataFrame, sizes: DataFrame, k: int, m: int) -> DataFrame:
    """id and data out of the shards (id, idx, shard) that are left; null where fewer than k are. sizes: id, size."""
    from pyspark.sql import functions as F

    lists = shards.groupBy("id").agg(F.collect_list(F.struct("idx", "shard")).alias("s")).join(sizes, "id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for i, held, size in zip(frame["id"], frame["s"], frame["size"], strict=True):
                slots: list[bytes | None] = [None] * (k + m)
                for x in held:
                    slots[int(x["idx"])] = bytes(x["shard"])
                rows.append((i, decode(slots, k, m, int(size)) if sum(s is not None for s in slots) >= k else None))
            yield pd.DataFrame(rows, columns=["id", "data"])

    return lists.select("id", "s", "size").mapInPandas(run, "id bigint, data binary")
