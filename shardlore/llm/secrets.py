"""Secret scans through a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams (folded to lower case):
strings that every match must hold, joined by AND and OR. The documents of a shard are indexed by the
trigrams that the rules ask for; a rule's posting lists are intersected and united, and the regular
expression runs over the whole texts of the candidates only. A rule whose expression demands no trigram
(such as a run of hex digits) is run over all texts.

Spans are code points, end exclusive, of whole matches; matches of a rule don't overlap, those of
different rules may. Defined results: a null text is empty; a null doc_id keeps its row; repeated rows are
reported once each. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from re import _constants as K  # type: ignore[attr-defined]
from re import _parser  # type: ignore[attr-defined]
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardlore.llm import common, text


class Rule(NamedTuple):
    kind: str
    pattern: str
    keep: Callable[[re.Match], bool] = lambda m: True


#: The base kinds come first; their order breaks ties of spans that start together.
RULES = (
    Rule("assign", r"""(?P<name>(?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m.group(2)) >= 8),
    Rule("access", r"AKIA[A-Z0-9]+", lambda m: m.end() - m.start() >= 16),
    Rule("hex", r"[0-9a-f]+", lambda m: m.end() - m.start() >= 32),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"(?:gh[oprsu]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,})"),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"(?ai:authorization: *bearer) +[A-Za-z0-9._~+/-]{16,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,15}://[^/\s:@]{1,64}:[^/\s:@]{3,64}@"),
)
BASE = ("assign", "access", "hex")

#: Sets of strings beyond this size stop being tracked one by one.
_MOST = 64

Query = tuple | str | None


def _all(parts: list[Query]) -> Query:
    parts = [p for p in dict.fromkeys(parts) if p is not None]
    return None if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _any(parts: list[Query]) -> Query:
    return None if not parts or None in parts else parts[0] if len(set(parts)) == 1 else ("or", *dict.fromkeys(parts))


def _demand(strings: set[str]) -> Query:
    """What holds if one of the strings occurs."""
    return _any([_all([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _cross(left: set[str], right: set[str]) -> set[str] | None:
    return {a + b for a in left for b in right} if len(left) * len(right) <= _MOST else None


def _exact(op, value) -> set[str] | None:
    """The folded strings that one parsed item matches, if they are few."""
    if op is K.LITERAL:
        return {chr(value).lower()}
    if op is K.IN and value[0][0] is not K.NEGATE:
        out = set()
        for kind, x in value:
            if kind is K.LITERAL:
                out.add(chr(x).lower())
            elif kind is K.RANGE and x[1] - x[0] < 8:
                out |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    return None


def _walk(items) -> tuple[set[str] | None, Query]:
    """The strings that a sequence matches, or None and what any match must hold."""
    demands: list[Query] = []
    run: set[str] = {""}
    whole = True

    def flush():
        nonlocal run, whole
        demands.append(_demand(run))
        run, whole = {""}, False

    def append(strings: set[str]):
        nonlocal run
        if (longer := _cross(run, strings)) is None:
            flush()
            longer = strings
        run = longer

    for op, value in items:
        strings = _exact(op, value)
        if strings is not None:
            append(strings)
        elif op is K.SUBPATTERN:
            strings, demand = _walk(value[3])
            if strings is None:
                flush()
                demands.append(demand)
            else:
                append(strings)
        elif op is K.BRANCH:
            ways = [_walk(way) for way in value[1]]
            if all(s is not None for s, _ in ways) and sum(len(s) for s, _ in ways) <= _MOST:
                append(set().union(*(s for s, _ in ways)))
            else:
                flush()
                demands.append(_any([d if s is None else _demand(s) for s, d in ways]))
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
            low, high, what = value
            strings, demand = _walk(what)
            if strings is not None and (low, high) == (0, 1) and len(strings) < _MOST:
                append(strings | {""})
                continue
            if strings is not None and low == high <= 8:
                for _ in range(low):
                    append(strings)
                continue
            if strings is not None and low:
                append(strings)
            flush()
            if low and strings is None:
                demands.append(demand)
        elif op is not K.AT:
            flush()
    if whole:
        return run, _demand(run)
    flush()
    return None, _all(demands)


def trigram_query(pattern: str) -> Query:
    """The Boolean query that every text with a match fulfils; None if none is demanded.

    A string is one trigram; ("and", ...) and ("or", ...) hold queries.
    """
    strings, demand = _walk(_parser.parse(pattern))
    return demand if strings is None else _demand(strings)


def trigrams(query: Query) -> set[str]:
    """The trigrams that a query names. Those with characters above 0x7F aren't indexed, so they may not occur in rules."""
    return set() if query is None else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1:]))


class Index:
    """The postings, among the rows of a shard, of the trigrams that the rules ask for."""

    def __init__(self, asked: list[str]):
        self.number = {t: i for i, t in enumerate(asked, 1)}
        self.table = np.zeros(1 << 24, np.uint16)
        for t, i in self.number.items():
            a, b, c = t.encode("ascii")
            self.table[a << 16 | b << 8 | c] = i

    def postings(self, data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """Ascending rows by trigram number."""
        if len(data) < 3:
            return [np.zeros(0, np.int64)] * (len(self.number) + 1)
        low = text.FOLD[data].astype(np.int32)
        found = self.table[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]]
        place = np.flatnonzero(found)
        row = np.searchsorted(at, place, "right") - 1
        inside = place + 3 <= at[row + 1]
        pair = np.unique(found[place[inside]].astype(np.int64) << 32 | row[inside])
        cut = np.searchsorted(pair, np.arange(1, len(self.number) + 1) << 32)
        return [p & 0xFFFFFFFF for p in np.split(pair, cut)]

    def rows(self, query: Query, postings: list[np.ndarray]) -> np.ndarray:
        """The rows that fulfil the query; intersections begin with the shortest list."""
        if isinstance(query, str):
            return postings[self.number[query]]
        lists = [self.rows(q, postings) for q in query[1:]]
        if query[0] == "or":
            return np.unique(np.concatenate(lists))
        lists.sort(key=len)
        out = lists[0]
        for other in lists[1:]:
            out = np.intersect1d(out, other, assume_unique=True)
        return out


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans (kind, start, end; by start, then as the rules are listed) of each document."""
    common.prepare(docs.sparkSession)
    queries = [trigram_query(r.pattern) for r in rules]
    asked = sorted(set().union(*map(trigrams, queries)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, patterns = Index(asked), [re.compile(r.pattern) for r in rules]
        for batch in batches:
            for part in text.chunks(batch, "text"):
                column = part.column("text")
                postings = index.postings(*text.flat(column))
                values: dict[int, str] = {}
                spans: dict[int, list] = {}
                for order, (rule, query, pattern) in enumerate(zip(rules, queries, patterns, strict=True)):
                    for row in range(part.num_rows) if query is None else index.rows(query, postings).tolist():
                        if row not in values:
                            values[row] = column[row].as_py() or ""
                        for m in pattern.finditer(values[row]):
                            if rule.keep(m):
                                spans.setdefault(row, []).append((m.start(), order, m.end()))
                out = [[{"kind": rules[o].kind, "start": a, "end": b} for a, o, b in sorted(spans.get(i, ()))] for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.list_(SPAN))], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>")


def report(docs: DataFrame) -> DataFrame:
    """The digest of `scan`."""
    found = scan(docs)

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *map(number, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: secrets in all documents."""
    return report(common.table(spark, sf_dir, "documents"))
