"""Sharding by extendible hashing, with DataFrame expressions only.

A document's key is a 60-bit hash of its id and text. The directory is indexed by the key's leading bits;
it starts with one bucket, and only buckets over the byte limit split on their next bit. The
byte totals come from one aggregation per directory level of BITS bits: cells of that depth are summed, every
prefix of a cell is a sum of cells, and a bucket is the shortest prefix that fits. Cells that are still over the
limit go to the next level, where only their rows are summed again. Each level's directory has at most
2^BITS entries per cell of the level before that is over the limit; it is joined by Spark's choice of strategy.

Rows that no hash bit can part (equal id and text, or one text above the limit) stay in a bucket of the
largest depth; its equal rows are numbered and cut into parts that fit, where a single row above the limit has a part of its own.

Defined results: a null text has 0 bytes and a null id is an id of its own; an empty table has no shard;
repeated rows are placed one by one. Other columns stay as they are; columns named shard, shard_depth or n_bytes are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shardlore.llm import common

#: Bytes of text in one shard.
LIMIT = 16 << 20
#: Directory bits added at a time, and in all.
BITS = 12
DEPTH = 60


def key() -> Column:
    """60 hash bits of a row's id and text."""
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.coalesce("text", F.lit("")))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 15), 16, 10).cast("bigint")


def directory(sizes: DataFrame, limit: int) -> DataFrame:
    """The directory of (key, bytes) rows: cell_bits and cell (leading bits), and the depth of the cell's bucket.

    Cells that fit at no depth have depth DEPTH.
    """
    rest, done = sizes, None
    base = 0
    while base < DEPTH:
        deep = base + BITS
        cells = rest.groupBy(F.shiftright("key", DEPTH - deep).alias("cell")).agg(F.sum("bytes").alias("bytes"))
        # The levels of the cells' prefixes: each cell adds its bytes to BITS + 1 buckets (the first level has the root as well).
        paths = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(base if base == 0 else base + 1), F.lit(deep))).alias("depth"))
        paths = paths.withColumn("prefix", F.expr(f"shiftright(cell, {deep} - depth)"))
        fits = paths.groupBy("depth", "prefix").agg(F.sum("bytes").alias("total")).filter(F.col("total") <= limit)
        found = paths.join(fits, ["depth", "prefix"]).groupBy("cell").agg(F.min("depth").alias("depth"))
        level = common.stage(
            cells.select("cell").join(found, "cell", "left").select(F.lit(deep).alias("cell_bits"), "cell", F.coalesce("depth", F.lit(DEPTH if deep == DEPTH else None)).alias("depth")),
            "directory",
        )
        placed = level.filter(F.col("depth").isNotNull())
        done = placed if done is None else done.unionByName(placed)
        left = level.filter(F.col("depth").isNull()).select(F.col("cell").alias("large"))
        if left.isEmpty():
            break
        rest = rest.join(left, F.shiftright("key", DEPTH - deep) == F.col("large"), "left_semi")
        base = deep
    return done


def assign(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """docs with shard (bucket bits as text, and a part number where one bucket had to be cut), shard_depth and n_bytes."""
    docs, back = common.aside(docs.drop("shard", "shard_depth", "n_bytes"), ())
    keyed = docs.withColumns({"__key": key(), "n_bytes": F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")})
    sizes = common.stage(keyed.select(F.col("__key").alias("key"), F.col("n_bytes").alias("bytes")), "sizes")
    cells = directory(sizes, limit)
    found = keyed
    levels = cells.groupBy("cell_bits").agg(F.max("depth").alias("deepest")).orderBy("cell_bits").collect()
    depth = F.lit(None).cast("int")
    for bits, _ in levels:
        entries = cells.filter(F.col("cell_bits") == bits).select(F.col("cell").alias(f"__cell{bits}"), F.col("depth").alias(f"__depth{bits}"))
        found = found.join(entries, F.shiftright("__key", DEPTH - bits) == F.col(f"__cell{bits}"), "left")
        depth = F.coalesce(depth, F.col(f"__depth{bits}"))
    bucket = F.expr(f"concat('b', substring(lpad(bin(__key), {DEPTH}, '0'), 1, shard_depth))")
    found = found.withColumn("shard_depth", depth).withColumn("shard", bucket)
    if any(deepest == DEPTH for _, deepest in levels):
        found = found.filter(F.col("shard_depth") < DEPTH).unionByName(_parts(found.filter(F.col("shard_depth") == DEPTH), limit))
    return back(found.drop(*[c for c in found.columns if c.startswith("__")]))


def _parts(rows: DataFrame, limit: int) -> DataFrame:
    """Number the equal rows of each bucket of the largest depth, and start a new part whenever the next row would not fit.

    A key may hold very many rows: they are numbered within the files they were written to, and the files' counts are summed.
    """
    rows = common.stage(rows, "deepest").withColumn("__file", F.input_file_name())
    local = F.row_number().over(Window.partitionBy("__key", "__file").orderBy("n_bytes"))
    counts = rows.groupBy("__key", "__file").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__key").orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__key", "__file", before.alias("__before"))
    number = F.col("__before") + local - 1
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("n_bytes", F.lit(1))))
    return rows.join(starts, ["__key", "__file"]).withColumn("shard", F.concat("shard", F.lit("."), F.floor(number / each).cast("string"))).drop("__file", "__before")


def report(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Each document's shard and size."""
    return assign(docs.select("doc_id", "text"), limit).select("doc_id", "shard", F.col("shard_depth").cast("int").alias("shard_depth"), "n_bytes")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: all documents in shards of at most LIMIT bytes of text."""
    return report(common.table(spark, sf_dir, "documents"))


SQL = f"""
WITH k AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS key,
    row_number() OVER () AS rn
  FROM documents),
p AS (SELECT rn, n_bytes, d, key >> ({DEPTH} - d) AS prefix FROM k, (SELECT unnest(range(0, {DEPTH})) AS d)),
t AS (SELECT d, prefix, sum(n_bytes) AS total FROM p GROUP BY d, prefix HAVING sum(n_bytes) <= {LIMIT}),
f AS (SELECT rn, min(d) AS depth FROM p JOIN t USING (d, prefix) GROUP BY rn)
SELECT doc_id, 'b' || CASE WHEN depth = 0 THEN '' ELSE substr(lpad(bin(key), {DEPTH}, '0'), 1, CAST(depth AS INTEGER)) END AS shard,
  CAST(depth AS INTEGER) AS shard_depth, n_bytes
FROM k JOIN f USING (rn)
"""
