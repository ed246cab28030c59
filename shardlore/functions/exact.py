"""Bit-exact placement and sampling in unsigned 64-bit arithmetic, for batches of keys.

Spark has no wrapping multiplication and no XXH3, so these run in mapInPandas over placement groups or stripes: a
bounded number of rows, each independent of the others.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The generator's constants and word size.
MULTIPLIER, INCREMENT, WORD = 6364136223846793005, 1, 1 << 64


def advance(seed: int) -> int:
    return (seed * MULTIPLIER + INCREMENT) % WORD


def seed_of(name: str, stripe: int) -> int:
    """XXH3 of the name followed by the stripe number as eight little-endian bytes."""
    return xxhash.xxh3_64_intdigest(name.encode() + struct.pack("<Q", stripe))


def group_of(file_hash: str, groups: int) -> int:
    return xxhash.xxh3_64_intdigest(file_hash.encode()) % groups


def sample(seed: int, total: int, size: int) -> list[int]:
    """`size` distinct numbers below `total`, ascending; all of them if there are no more."""
    if size >= total:
        return list(range(total))
    chosen: set[int] = set()
    while len(chosen) < size:
        seed = advance(seed)
        chosen.add(seed % total)
    return sorted(chosen)


def sip_hash(messages: list[bytes], each: int = 1, last: int = 3, key: tuple[int, int] = (0, 0)) -> np.ndarray:
    """SipHash of each message, `each` rounds for a word and `last` at the end; messages of as many words are hashed side by side."""
    out = np.zeros(len(messages), np.uint64)
    words = np.array([len(m) // 8 + 1 for m in messages])

    def turned(x: np.ndarray, by: int) -> np.ndarray:
        return (x << np.uint64(by)) | (x >> np.uint64(64 - by))

    def rounds(v: list[np.ndarray], n: int) -> None:
        for _ in range(n):
            for a, b, c, d, r, s in ((0, 1, 2, 3, 13, 16), (2, 1, 0, 3, 17, 21)):
                # Both halves of a round mix the first pair, then the second one, which the other half takes crosswise.
                v[a] = v[a] + v[b]
                v[b] = turned(v[b], r) ^ v[a]
                v[a] = turned(v[a], 32)
                other = c if a == 0 else 0
                v[other] = v[other] + v[d]
                v[d] = turned(v[d], s) ^ v[other]

    with np.errstate(over="ignore"):
        for n in np.unique(words).tolist():
            mine = np.flatnonzero(words == n)
            cells = np.frombuffer(b"".join(messages[k].ljust(8 * n - 1, b"\0") + bytes([len(messages[k]) & 255]) for k in mine), "<u8").reshape(-1, n)
            # What the state begins with.
            begin = (0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573)
            v = [np.full(len(mine), b ^ key[k % 2], np.uint64) for k, b in enumerate(begin)]
            for k in range(n):
                v[3] = v[3] ^ cells[:, k]
                rounds(v, each)
                v[0] = v[0] ^ cells[:, k]
            v[2] = v[2] ^ np.uint64(255)
            rounds(v, last)
            out[mine] = v[0] ^ v[1] ^ v[2] ^ v[3]
    return out


def node_uid(public_key: Column) -> Column:
    """The number of a node: the low 31 bits of the SipHash of its key's text and a byte of ones."""

    @F.pandas_udf("bigint")
    def number(keys: pd.Series) -> pd.Series:
        known = keys.notna()
        out = pd.Series([None] * len(keys), dtype="Int64", index=keys.index)
        out[known] = (sip_hash([k.encode() + b"\xff" for k in keys[known]]) & np.uint64(0x7FFFFFFF)).astype(np.int64)
        return out

    return number(public_key)


class Wheel:
    """Weighted draws without replacement: the generator's next value, modulo the weights left, falls into one of them."""

    @staticmethod
    def pick(weights: list[tuple], count: int, seed: int) -> list:
        left, taken = list(weights), []
        while left and len(taken) < count:
            whole = sum(w for _, w in left)
            if not whole:
                break
            seed = advance(seed)
            target = seed % whole
            for at, (_, w) in enumerate(left):
                target -= w
                if target < 0:
                    taken.append(left.pop(at)[0])
                    break
        return taken


class Straws:
    """Longest straws without replacement: the seed grows by one each round; the first of equal straws wins."""

    @staticmethod
    def length(seed: int, number: int, weight: int) -> float:
        if not weight:
            return -math.inf
        h = xxhash.xxh3_64_intdigest(struct.pack("<QI", seed, number))
        return math.log(((h & 0xFFFF) + 1) / 65537.0) / weight

    @classmethod
    def pick(cls, weights: list[tuple], count: int, seed: int) -> list:
        left, taken = list(weights), []
        for turn in range(count):
            if not any(w for _, w in left):
                break
            mark = (seed + turn) % WORD
            best = max(range(len(left)), key=lambda k: (cls.length(mark, cls.number(left[k][0]), left[k][1]), -k))
            taken.append(left.pop(best)[0])
        return taken

    @staticmethod
    def number(name) -> int:
        return name if isinstance(name, int) else xxhash.xxh3_64_intdigest(str(name).encode()) & 0xFFFFFFFF


def spread(name: str, stripe: int, count: int, nodes: list[tuple[int, str, int]], method=Straws) -> list[int]:
    """uids for the slots of a stripe, over as many families as there are; nodes: uid, family, weight.

    With enough families each gives one node. Otherwise all share evenly, the first in the draw give the remainder, and what small
    families lack is taken from the others in the draw's order. Fewer than `count` nodes in all is an error.
    """
    if len(nodes) < count:
        raise ValueError(f"{count} nodes are needed, there are {len(nodes)}")
    families: dict[str, list[tuple[int, int]]] = {}
    for uid, family, weight in sorted(nodes):
        families.setdefault(family, []).append((uid, weight))
    seed = seed_of(name, stripe)
    totals = [(f, sum(w for _, w in families[f])) for f in sorted(families)]
    order = method.pick(totals, min(count, len(totals)), seed)
    quota, more = divmod(count, len(totals)) if len(totals) < count else (1, 0)
    chosen: list[int] = []
    for turn, family in enumerate(order):
        want = min(quota + (turn < more), len(families[family]))
        chosen += method.pick(families[family], want, (seed + turn) % WORD)
    for turn, family in enumerate(order):
        if len(chosen) >= count or len(totals) >= count:
            break
        free = [x for x in families[family] if x[0] not in chosen]
        chosen += method.pick(free, min(len(free), count - len(chosen)), (seed + len(totals) + turn) % WORD)
    if len(chosen) < count:
        raise ValueError(f"only {len(chosen)} of {count} slots could be filled")
    return chosen


def fresh_addresses(chosen: list[int], nodes: dict[int, tuple[str | None, int]]) -> list[int]:
    """chosen with later nodes on an address already used replaced by the heaviest free node on a fresh one, where there is one; nodes: uid to address, weight."""
    used: set[str] = set()
    out = list(chosen)
    free = sorted((u for u in nodes if u not in set(chosen) and nodes[u][1] > 0), key=lambda u: (-nodes[u][1], u))
    repeats = []
    for slot, uid in enumerate(out):
        address = nodes[uid][0]
        if address is not None and address in used:
            repeats.append(slot)
        elif address is not None:
            used.add(address)
    for slot in repeats:
        for uid in free:
            if (nodes[uid][0] or "") not in used:
                out[slot] = uid
                free.remove(uid)
                if nodes[uid][0]:
                    used.add(nodes[uid][0])
                break
    return out


def placements(stripes: DataFrame, nodes: DataFrame, count: int, method=Straws) -> DataFrame:
    """name, stripe, slot and uid of each (name, stripe). The nodes of one cluster map (bounded by the cluster, checked) go to the tasks."""
    most = 100_000
    known = [(r.uid, str(r.family), r.weight) for r in nodes.select("uid", "family", "weight").limit(most + 1).collect()]
    if len(known) > most:
        raise ValueError(f"a cluster map holds at most {most} nodes")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [
                (name, stripe, slot, uid)
                for name, stripe in zip(frame["name"], frame["stripe"], strict=True)
                for slot, uid in enumerate(spread(name, int(stripe), count, known, method))
            ]
            yield pd.DataFrame(rows, columns=["name", "stripe", "slot", "uid"])

    return stripes.select("name", "stripe").mapInPandas(run, "name string, stripe bigint, slot bigint, uid bigint")
