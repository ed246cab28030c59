"""MinHash near-duplicates by a chosen-path set similarity join.

A document is its set of distinct five-word shingles. Equal sets are put together first (by two 64-bit sums),
and one document stands for them. The join then grows TREES independent trees: at the root of a tree, documents
part by their value under the tree's minwise function; a node of more than NODE documents chooses
further functions (BRANCHES) by its own path and its documents part again under each, so a document may go down several
paths; documents whose sketch is like that of the node's first one are candidates through it, and paths on which only documents meet
that are connected by then end. Nodes of up to NODE documents, and nodes with up to NODE documents outside their largest connected group, are
compared exhaustively (but for pairs within that group, which is dealt over parts) by their MINWISE-value sketches, and pairs whose estimate
reaches SKETCH are candidates. Nodes with the same documents as another are compared once. A node still too large at depth DEPTH shares that many minwise values and is taken as
candidates as a whole.

Recall at similarity 0.75: a pair meets in a small root with probability 0.75 per tree, so ten trees find all but one in 10^6. In a crowded
root it survives each of the three splits with probability 0.98, and ten trees find it in 99.999 % of cases even if it is
connected through nobody else; the sketch of 64 values misses an estimate of 0.5 about once in 10^5 such pairs.

Candidates are confirmed on full shingle sets: connected groups of candidates are brought together, each text once,
and all pairs of a group that aren't connected yet are compared, so no cap and no sampling is involved.
Groups of more than GROUP shingles are compared block against block.

Each distinct set has a key of its own, a 64-bit hash of the doc_id and text of its first row; doc_id comes in with the results. Shingles and
sets are compared by 64-bit hashes and pairs of them (`text` states the odds).

Defined results: in the report, rows of one doc_id are one document with the union of their links; `decide` keeps one row of each
class of texts and doesn't take texts of one doc_id for one another. A text without words, an
empty or null one has no shingles and is linked with nothing; a null doc_id is linked with nothing, has no component and
is kept; repeated rows are returned as often by the report; an empty table stays empty. Other columns stay in `decide`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardlore.llm import common, shingles, text
from shardlore.llm.components import components

MINWISE = 64
TREES = 10
#: Functions under which a crowded node's documents part again, by the node's depth.
BRANCHES = (3, 3, 3)
DEPTH = len(BRANCHES) + 1
NODE = 256
#: Documents of a crowded node that are compared with its first one, or with those outside its largest group, together.
SPREAD = 1024
SKETCH = 0.5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Shingles of candidate groups that one task compares at a time.
GROUP = 2_000_000
#: Up to so many candidates (8 bytes each) are broadcast to pick out their texts; with more, all texts are shuffled once.
PICKED = 2_000_000

FEATURES = "doc_id bigint, text_key bigint, n_shingles bigint, set_a bigint, set_b bigint, mins array<int>"


def features(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, set size, set signature and minwise values of every row."""
    common.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.chunks(batch, "text"):
                found, cut = shingles.sets(*text.flat(part.column("text")))
                sums = shingles.signature(found, cut).view(np.int64)
                mins = pa.FixedSizeListArray.from_arrays(shingles.minwise(found, cut, MINWISE).reshape(-1), MINWISE).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), pa.array(np.diff(cut)), pa.array(sums[:, 0]), pa.array(sums[:, 1]), mins],
                    ["doc_id", "text_key", "n_shingles", "set_a", "set_b", "mins"],
                )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, FEATURES)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate edges of nodes: a spanning forest of the pairs whose sketches are alike."""
    for table in common.groups(batches, "node"):
        node = table.column("node").to_numpy()
        rep = table.column("rep").to_numpy()
        main = table.column("main").to_numpy()
        mins = table.column("mins").combine_chunks()
        mins = (mins if isinstance(mins, pa.Array) else mins.chunk(0)).flatten().to_numpy().reshape(-1, MINWISE)
        first = np.append(0, np.flatnonzero(node[1:] != node[:-1]) + 1)
        size = np.diff(np.append(first, len(node)))
        pairs = first[size == 2]
        alike = (mins[pairs] == mins[pairs + 1]).sum(axis=1) >= SKETCH * MINWISE
        a, b = [rep[pairs[alike]]], [rep[pairs[alike] + 1]]
        for f, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            m, inner = mins[f : f + n], main[f : f + n]
            core, left = m[inner], np.flatnonzero(~inner)
            # Main documents are connected already, so one of them that is alike is enough.
            for k in left.tolist() if len(core) else ():
                found = np.flatnonzero(inner)[(core == m[k]).sum(axis=1) >= SKETCH * MINWISE][:1]
                a.append(np.full(len(found), rep[f + k]))
                b.append(rep[f + found])
            while len(left):
                queue, left = [int(left[0])], left[1:]
                while queue and len(left):
                    k = queue.pop()
                    near = (m[left] == m[k]).sum(axis=1) >= SKETCH * MINWISE
                    found, left = left[near], left[~near]
                    queue.extend(found.tolist())
                    a.append(np.full(len(found), rep[f + k]))
                    b.append(rep[f + found])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def _near_head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges between documents and their node's first one whose sketches are alike."""
    for batch in batches:
        sketches = [batch.column(c).flatten().to_numpy().reshape(-1, MINWISE) for c in ("mins", "first_mins")]
        near = pa.array((sketches[0] == sketches[1]).sum(axis=1) >= SKETCH * MINWISE)
        yield pa.RecordBatch.from_arrays([batch.column("first").filter(near), batch.column("rep").filter(near)], ["a", "b"])


def candidates(reps: DataFrame) -> DataFrame:
    """Edges (a, b) whose connected groups hold every pair that the trees found; reps: rep and mins."""
    level = reps.select("rep", F.posexplode(F.slice("mins", 1, TREES)).alias("tree", "value"))
    level = level.select(F.xxhash64("tree", "value").alias("node"), "rep", F.col("rep").alias("head"))
    small, through = None, []
    for depth in range(1, DEPTH + 1):
        # head: a document that this one is known to be connected with. A node of one head has nothing to find.
        sizes = level.groupBy("node").agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("who"), F.min("rep").alias("first"),
            F.min("head").alias("low"), F.max("head").alias("high"), F.min_by("head", "rep").alias("first_head"),
        )
        # Nodes that hold the same documents are one node.
        kept = sizes.filter("n > 1 and low <> high").groupBy("n", "who").agg(F.min_by(F.struct("node", "first", "first_head"), "node").alias("one")).select("one.*", "n")
        rows = common.stage(level.join(kept, "node"), "paths")
        few = rows.filter(F.col("n") <= NODE).select("node", "rep", F.lit(False).alias("main"))
        small = few if small is None else small.union(few)
        large = rows.filter(F.col("n") > NODE)
        if large.isEmpty():
            break
        if depth == DEPTH:
            through.append(large.select(F.col("first").alias("a"), F.col("rep").alias("b")))
            break
        crowded = common.stage(large.join(reps.select("rep", "mins"), "rep"), "crowded")
        # Documents like their node's first one are connected through it, unless they are already; a node's documents are spread over parts of SPREAD,
        # each of which gets the first one's sketch.
        parts = F.ceil(F.col("n") / SPREAD).cast("int")
        apart = crowded.filter("head <> first_head").withColumn("part", F.pmod(F.xxhash64("rep", "node"), parts).cast("int"))
        spread = large.filter("head <> first_head").select("node", "first", "n").distinct().withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")
        sketch = reps.select(F.col("rep").alias("first"), F.col("mins").alias("first_mins"))
        tested = apart.select("node", "rep", "part", "mins").join(spread.join(sketch, "first"), ["node", "part"]).select("rep", "mins", "first", "first_mins")
        through.append(common.stage(tested.mapInArrow(_near_head, "a bigint, b bigint"), "near_first"))
        known = components(reduce(DataFrame.union, through), "heads").select(F.col("id").alias("rep"), F.col("component").alias("known"))
        heads = common.stage(crowded.join(known, "rep", "left").select("node", "rep", "mins", F.coalesce("known", "rep").alias("head")), "heads")
        # A node of only connected documents ends here.
        by_head = heads.groupBy("node", "head").agg(F.count("*").alias("n"))
        top = F.max(F.struct("n", "head"))
        shape = by_head.groupBy("node").agg(F.sum("n").alias("n"), top["n"].alias("top"), top["head"].alias("main_head")).filter("top < n")
        shape = common.stage(shape.withColumn("outside", F.col("n") - F.col("top")), "shape")
        # Up to NODE documents beside one connected group: all of them meet every part of it.
        parts = F.ceil(F.col("top") / SPREAD).cast("int")
        met = heads.join(shape.filter(F.col("outside") <= NODE), "node").withColumn("main", F.col("head") == F.col("main_head"))
        home = F.pmod(F.xxhash64("rep", "node"), parts).cast("int")
        met = met.withColumn("part", F.explode(F.when(F.col("main"), F.array(home)).otherwise(F.sequence(F.lit(0), parts - 1))))
        small = small.union(common.stage(met.select(F.xxhash64("node", "part").alias("node"), "rep", "main"), "beside"))
        open_nodes = shape.filter(F.col("outside") > NODE).select("node")
        chosen = F.pmod(F.xxhash64("node", "branch"), F.lit(MINWISE)).cast("int")
        # Crowded nodes are few, so their documents are dealt anew before they branch.
        down = heads.join(open_nodes, "node", "left_semi").repartition("rep", "node").withColumn("branch", F.explode(F.sequence(F.lit(1), F.lit(BRANCHES[depth - 1]))))
        level = common.stage(down.select(F.xxhash64("node", "branch", F.get("mins", chosen)).alias("node"), "rep", "head"), "level")
    # The small nodes of all depths are compared in one pass.
    edges = small.join(reps.select("rep", "mins"), "rep").repartition("node").sortWithinPartitions("node").mapInArrow(_compare, "a bigint, b bigint")
    for more in through:
        edges = edges.union(more)
    return edges


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of pairs whose full sets reach the similarity, enough of them to connect each group as all its links do."""
    for table in common.groups(batches, "team"):
        table = table.combine_chunks()
        team, rep = table.column("team").to_numpy(), table.column("rep").to_numpy()
        first = np.append(0, np.flatnonzero(team[1:] != team[:-1]) + 1)
        last = np.append(first[1:], len(team))
        a: list[int] = []
        b: list[int] = []
        for f, stop in zip(first.tolist(), last.tolist(), strict=True):
            parts, sizes = [], []
            for batch in table.slice(f, stop - f).to_batches():
                for piece in text.chunks(batch, "text"):
                    found, cut = shingles.sets(*text.flat(piece.column("text")))
                    parts.append(found)
                    sizes.append(np.diff(cut))
            size = np.concatenate(sizes)
            _, ids = np.unique(np.concatenate(parts), return_inverse=True)
            end = np.cumsum(size)
            flag = np.zeros(ids.max(initial=0) + 1, bool)
            for x, y in _links(ids, end - size, size, flag):
                a.append(int(rep[f + x]))
                b.append(int(rep[f + y]))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _links(ids: np.ndarray, begin: np.ndarray, size: np.ndarray, flag: np.ndarray) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among sets (ids[begin : begin + size], none empty): pairs within one tree aren't compared."""
    left = np.arange(len(size))
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            k = queue.pop()
            mine = ids[begin[k] : begin[k] + size[k]]
            fits = left[100 * np.minimum(size[left], size[k]) >= PERCENT * np.maximum(size[left], size[k])]
            if not len(fits):
                continue
            flag[mine] = True
            n = size[fits]
            stop = np.cumsum(n)
            at = np.arange(stop[-1]) + np.repeat(begin[fits] - (stop - n), n)
            common_ids = np.add.reduceat(flag[ids[at]].astype(np.int64), stop - n)
            flag[mine] = False
            found = fits[100 * common_ids >= PERCENT * (n + size[k] - common_ids)]
            if len(found):
                left = np.setdiff1d(left, found, assume_unique=True)
                queue.extend(found.tolist())
                yield from ((k, x) for x in found.tolist())


def links(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Confirmed edges within candidate groups; groups: team, rep and n_shingles."""
    sizes = groups.groupBy("team").agg(F.sum("n_shingles").alias("total")).select("team", F.ceil(F.col("total") / GROUP).cast("int").alias("blocks"))
    placed = groups.join(sizes, "team").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # A group of several blocks meets as pairs of blocks, each with itself and every other; most groups are one block.
    met = placed.select("team", "rep", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select(F.xxhash64("team", F.least("block", "other"), F.greatest("block", "other")).alias("team"), "rep")
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").select(F.xxhash64("doc_id", "text_key").alias("rep"), "text")
    wanted = groups.select("rep")
    wanted = F.broadcast(wanted) if groups.count() <= PICKED else wanted
    texts = keyed.join(wanted, "rep", "left_semi").dropDuplicates(["rep"])
    return met.join(texts, "rep").repartition("team").sortWithinPartitions("team").mapInArrow(_confirm, "a bigint, b bigint")


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The features of docs, and set_a, set_b, low and low_key of each distinct set: the doc_id and text_key that stand for its class."""
    known = common.stage(features(docs), "features")
    some = known.filter("n_shingles > 0 and doc_id is not null")
    row = F.min(F.struct("doc_id", "text_key"))
    reps = some.groupBy("set_a", "set_b").agg(row.alias("row"), F.first("mins").alias("mins"), F.first("n_shingles").alias("n_shingles"))
    reps = common.stage(reps.select(F.xxhash64("row.doc_id", "row.text_key").alias("rep"), "set_a", "set_b", "row.*", "mins", "n_shingles"), "reps")
    maybe = components(candidates(reps), "candidates")
    teams = maybe.select(F.col("component").alias("team"), F.col("id").alias("rep"))
    teams = teams.union(teams.select("team", F.col("team").alias("rep"))).distinct()
    groups = common.stage(teams.join(reps.select("rep", "n_shingles"), "rep"), "teams")
    merged = components(links(docs, groups), "near")
    sets = reps.select("rep", "set_a", "set_b", "doc_id", "text_key").join(merged, F.col("rep") == F.col("id"), "left")
    sets = sets.select("set_a", "set_b", "doc_id", "text_key", F.coalesce("component", "rep").alias("class"))
    least = sets.groupBy("class").agg(row.alias("least"))
    low = sets.join(least, "class").select("set_a", "set_b", F.col("least.doc_id").alias("low"), F.col("least.text_key").alias("low_key"))
    return known, common.stage(low, "classes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs."""
    known, low = classes(docs)
    some = known.filter("n_shingles > 0 and doc_id is not null").select("doc_id", "set_a", "set_b")
    # A doc_id with several texts joins their classes.
    same = some.join(low, ["set_a", "set_b"]).select(F.col("low").alias("a"), F.col("doc_id").alias("b"))
    merged = components(same, "documents")
    out = known.select("doc_id", "n_shingles").join(merged, F.col("doc_id") == F.col("id"), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: near-duplicates among all documents."""
    return near_duplicates(common.table(spark, sf_dir, "documents"))


def decide(docs: DataFrame) -> DataFrame:
    """The rows of docs without those that another row stands for: one row of each class of texts; every column stays.

    Rows with a null doc_id stay.
    """
    known, low = classes(docs)
    some = known.filter("n_shingles > 0 and doc_id is not null").select("doc_id", F.col("text_key").alias("__text_key"), "set_a", "set_b")
    gone = some.join(low, ["set_a", "set_b"]).filter((F.col("doc_id") != F.col("low")) | (F.col("__text_key") != F.col("low_key")))
    keyed = docs.withColumn("__text_key", F.xxhash64("text"))
    left = keyed.join(gone.select("doc_id", "__text_key").distinct(), ["doc_id", "__text_key"], "left_anti").select(*docs.columns, "__text_key")
    one = left.filter("doc_id is not null").dropDuplicates(["doc_id", "__text_key"])
    return one.union(left.filter("doc_id is null")).drop("__text_key")
