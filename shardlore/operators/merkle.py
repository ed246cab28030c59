"""Merkle trees over arrays of binary leaves, as Column expressions (SHA-256)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags of leaves and inner nodes, and the root of no leaves.
LEAF, NODE, NOTHING = b"\x00", b"\x01", bytes(32)


def sha(value: Column) -> Column:
    return F.unhex(F.sha2(value, 256))


def chunks(data: Column, size: int) -> Column:
    """SHA-256 of each chunk of `size` bytes; one chunk at least."""
    count = F.greatest(F.ceil(F.octet_length(data) / size).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda k: sha(F.substr(data, k * size + 1, F.lit(size))))


def leaf(value: Column) -> Column:
    return sha(F.concat(F.lit(LEAF), value))


def node(left: Column, right: Column) -> Column:
    return sha(F.concat(F.lit(NODE), left, right))


def padded(values: Column, padding: bytes | None = None) -> Column:
    """Leaves up to a power of two, by repeating the last one, or by a leaf digest given."""
    width = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1))))).cast("int")
    fill = F.lit(padding) if padding else F.try_element_at(values, F.lit(-1))
    return F.concat(values, F.array_repeat(fill, width - F.size(values)))


def levels(leaves: Column) -> Column:
    """A sequence of as many elements as levels lie between the leaves and the root, one at least."""
    return F.sequence(F.lit(1), F.length(F.bin(F.greatest(F.size(leaves) - 1, F.lit(1)).cast("bigint"))))


def level_up(values: Column) -> Column:
    """The level above; a single value stays."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(values) - 1, F.lit(1)), F.lit(2)), lambda i: node(F.element_at(values, i), F.element_at(values, i + 1)))
    return F.when(F.size(values) > 1, pairs).otherwise(values)


def root(leaves: Column, padding: bytes | None = None) -> Column:
    """The root of an array of leaves, however many; 32 zero bytes of none."""
    start = padded(F.transform(leaves, leaf), padding)
    top = F.aggregate(levels(leaves), start, lambda v, _: level_up(v))
    return F.when(F.size(leaves) > 0, F.get(top, F.lit(0))).when(leaves.isNotNull(), F.lit(NOTHING))


def proof(leaves: Column, index: Column, padding: bytes | None = None) -> Column:
    """The siblings from a leaf (counted from 0) to the root, each with whether it stands on the left."""
    start = F.struct(
        padded(F.transform(leaves, leaf), padding).alias("level"), index.cast("int").alias("at"),
        F.expr("cast(array() as array<struct<sibling:binary,left:boolean>>)").alias("path"),
    )

    def step(s: Column, _: Column) -> Column:
        other = s["at"].bitwiseXOR(F.lit(1))
        sibling = F.struct(F.try_element_at(s["level"], other + 1).alias("sibling"), (s["at"] % 2 == 1).alias("left"))
        path = F.when(F.size(s["level"]) > 1, F.concat(s["path"], F.array(sibling))).otherwise(s["path"])
        return F.struct(level_up(s["level"]).alias("level"), F.floor(s["at"] / 2).cast("int").alias("at"), path.alias("path"))

    return F.aggregate(levels(leaves), start, step)["path"]


def verify(value: Column, path: Column, expected: Column) -> Column:
    """Whether a leaf and its siblings hash to the root."""
    return F.aggregate(path, leaf(value), lambda h, p: F.when(p["left"], node(p["sibling"], h)).otherwise(node(h, p["sibling"]))) == expected
