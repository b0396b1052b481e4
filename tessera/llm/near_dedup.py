"""Near-duplicate detection with an LSH forest.

A document's set holds its distinct shingles of five words. Documents with equal sets form a class, which has a number of its own
and is represented by its document of the smallest id. Each class stands in ``TREES`` orders, each sorted by ``DEPTH`` MinHash
values. In an order, a region is a run of representatives with a common prefix: it starts at depth ``SHALLOW``, and where
more than ``REGION`` share it, it is cut a value deeper, so depth adapts to each region's crowding. Members of a
region are candidates of one another; a region that was too crowded adds a star from each member to two pivots of it.

Candidates are confirmed on full sets in two rounds: first each representative's neighbours of the longest common
prefixes (those met in the most orders), which joins most copies; then every other candidate pair whose
members aren't yet connected. So no pair between copies already connected is ever compared. Pairs whose signatures agree far less than the threshold (five standard
deviations) are dropped before their sets are read.

At 0.75 a pair misses all orders with probability (1 - 0.75 ** SHALLOW) ** TREES, about 2e-6. In regions that are cut deeper a pair
needs a longer common prefix; there the stars and the many orders connect tight groups. What they leave apart is compared exactly: a crowd is a
region too crowded at depth ``SHALLOW``. If round 1 leaves it in several components (many texts of one
template), all pairs between different components are counted on full sets, block by block. So no pair that meets in an order is lost, at a cost
quadratic in what round 1 leaves apart in a crowd; pairs within a component of more than a block are never counted.

Defined results: null, empty and blank texts have an empty set and link with nothing; fewer than five words
are one shingle; very long texts are read whole; a component is called by its smallest id (null if it has null ids alone), and one text of it is kept: the one of the smallest
id, null ids last, of several texts under that id the one of the least hash; rows that repeat an id and text are members each and kept alike
(``deduplicate`` keeps one of them); different texts under one id are documents of their own; an empty table gives an empty table; other columns don't matter,
whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from tessera.llm.common import discard, free_name, map_arrow, materialise
from tessera.llm.components import connected_components

SHINGLE = 5
TREES, DEPTH, SHALLOW, REGION = 24, 6, 3, 24
#: Documents, and bytes of their sets, that a block of a crowd holds on average; columns of a product.
BLOCK, BLOCK_BYTES, COLUMNS = 1024, 8 << 20, 4096
#: Word hashes that a task remembers.
CACHE = 150_000
_HASHES = TREES * DEPTH
_rng = np.random.default_rng(20240101)
_A = (_rng.integers(1, 1 << 32, _HASHES, np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, _HASHES, np.uint64).astype(np.uint32)
_ODD = [np.uint64(int(x) | 1) for x in _rng.integers(1, 1 << 63, SHINGLE, np.uint64)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[str | None], memory: dict) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    if len(memory) > CACHE:
        memory.clear()
    split = [t.encode().lower().split() if t else [] for t in texts]  # of bytes: A-Z and ASCII white space alone
    digest = xxhash.xxh64_intdigest
    for w in set().union(*split).difference(memory):
        memory[w] = digest(w)
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    flat = np.fromiter((memory[w] for ws in split for w in ws), np.uint64, int(sizes.sum()))
    out, at = [], 0
    for n in sizes.tolist():
        h, at = flat[at:at + n], at + n
        if n == 0:
            out.append(h)
        elif n < SHINGLE:
            total = np.array([n], np.uint64)
            for w, c in zip(h, _ODD):
                total = (total ^ w) * c
            out.append(_mix(total))
        else:
            total = h[:n - SHINGLE + 1] * _ODD[0]
            for k in range(1, SHINGLE):
                total = total + h[k:n - SHINGLE + 1 + k] * _ODD[k]
            out.append(np.unique(_mix(total)))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """16 bits of each of the MinHash values, tree by tree."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(_HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 4096):
        np.minimum(least, (x[k:k + 4096, None] * _A + _B).min(axis=0), out=least)
    return (least ^ (least >> np.uint32(16))).astype(np.uint16)


def _sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, n_shingles, digest, sig`` of each whole text."""
    memory: dict = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column("text").to_pylist(), memory)
        digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        sig = [signature(s).tobytes() if len(s) else None for s in sets]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())],
            names=["doc_id", "text_hash", "n_shingles", "digest", "sig"])

    return map_arrow(docs, run, "doc_id long, text_hash long, n_shingles long, digest binary, sig binary", "text")


def _classes(sketches: DataFrame) -> DataFrame:
    """``digest, sig, rep, first`` of each class: its number, and the null mark, id and text hash of its first document."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    known = sketches.where("digest IS NOT NULL").groupBy("digest").agg(first, F.any_value("sig").alias("sig"))
    return known.withColumn("rep", F.monotonically_increasing_id())


def _regions(reps: DataFrame, write=materialise) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Members of regions of at most REGION (``region, label, rep``), stars of the crowded ones (``a, b``), and
    members of those crowded at the first depth (``region, rep``), if there are such. ``write`` stores what is read again.

    The first pivot of a crowded region is its most central member: the one whose regions, over all orders, hold the
    most members. It recurs from order to order, so a group's members meet the same few pivots.
    """
    width = 2 * DEPTH
    rows = reps.select("rep", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    rows = rows.select("rep", "tree", F.expr(f"substring(sig, tree * {width} + 1, {width})").alias("label"))
    small, stars, crowd = [], [], None
    for depth in range(SHALLOW, DEPTH + 1):
        rows = rows.withColumn("region", F.xxhash64("tree", F.expr(f"substring(label, 1, {2 * depth})")))
        count = rows.groupBy("region").agg(F.count("*").alias("n")).where("n > 1")
        found = write(rows.join(count, "region"), f"regions-{depth}")
        small.append(found.where(F.col("n") <= REGION).select("region", "label", "rep"))
        rows = found.where(F.col("n") > REGION)
        if rows.isEmpty():
            break
        if depth == SHALLOW:
            crowd = rows.select("region", "rep")
        if depth == SHALLOW:  # over all rows of a representative, of which there are at most TREES, before the crowded ones are taken
            rows = found.withColumn("central", F.sum("n").over(W.partitionBy("rep"))).where(F.col("n") > REGION)
        pivots = rows.groupBy("region").agg(F.max(F.struct("central", F.xxhash64("rep").alias("h"), "rep")).alias("p"),
                                            F.max(F.struct(F.xxhash64("rep").alias("h"), "rep")).alias("q"))
        # Written first: reduced before the shuffle, and the join below may split a crowded region.
        pivots = write(pivots.select("region", F.array("p.rep", "q.rep").alias("b")), f"pivots-{depth}")
        stars.append(rows.select("region", "rep").join(pivots, "region").select("rep", "b"))
        rows = rows.select("rep", "tree", "label", "central")
    members = small[0]
    for m in small[1:]:
        members = members.union(m)
    if not stars:
        stars = [members.select("rep", F.array("rep").alias("b")).where("false")]
    star = stars[0]
    for x in stars[1:]:
        star = star.union(x)
    # A member has at most two pivots for each order and depth; they recur, so they are counted before they become rows.
    star = star.groupBy("rep").agg(F.flatten(F.collect_list("b")).alias("bs"))
    counted = F.expr("transform(array_distinct(bs), b -> struct(b, size(filter(bs, x -> x = b)) AS n))")
    star = star.select(F.col("rep").alias("a"), F.explode(counted).alias("e")).select("a", "e.b", F.col("e.n").cast("long").alias("n"))
    return members, write(star.where("a <> b"), "stars"), crowd


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _likely(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose signatures don't exclude the threshold."""
    least = threshold - 5 * (threshold * (1 - threshold) / _HASHES) ** 0.5
    sig = reps.select("rep", "sig")
    rows = pairs.join(sig.select(F.col("rep").alias("a"), F.col("sig").alias("x")), "a")
    rows = rows.join(sig.select(F.col("rep").alias("b"), F.col("sig").alias("y")), "b")

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, _HASHES) for c in ("x", "y"))
            keep = (x == y).mean(axis=1) >= least
            out = batch.select(["a", "b"]).filter(pa.array(keep))
            if out.num_rows:
                yield out

    return rows.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, reps: DataFrame, members: DataFrame, stars: DataFrame, write=materialise) -> DataFrame:
    """``rep, s``: the full sets of classes that have candidates, read once for both rounds from their first documents."""
    needed = members.select("rep").union(stars.select("a")).union(stars.select("b")).distinct()
    needed = write(reps.select("rep", "first.doc_id", "first.text_hash").join(needed, "rep", "left_semi"), "needed")
    memory: dict = {}

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = shingle_sets(batch.column("text").to_pylist(), memory)
        return pa.RecordBatch.from_arrays([batch.column("rep"), pa.array([s.tobytes() for s in found], pa.binary())], names=["rep", "s"])

    by = ["doc_id", "text_hash"]
    rows = docs.join(needed.hint("merge"), by).select("rep", "text")  # sorted and spilled, whatever the sizes
    nameless = docs.where("doc_id IS NULL").groupBy("text_hash").agg(F.any_value("text").alias("text"))
    rows = rows.union(nameless.join(needed.where("doc_id IS NULL").select("rep", "text_hash"), "text_hash").select("rep", "text"))
    return write(map_arrow(rows, sets, "rep long, s binary", "text"), "sets")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int, write=materialise) -> DataFrame:
    """Pairs whose full sets reach the threshold: 100 * shared >= percent * all."""
    both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("s").alias("x")).hint("merge"), "a")
    both = both.join(sets.select(F.col("rep").alias("b"), F.col("s").alias("y")).hint("merge"), "b")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(batch.column("x"), batch.column("y")):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            shared = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
            keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    links = map_arrow(both.select("a", "b", "x", "y"), run, "a long, b long", "x")
    return write(links.distinct(), "links")  # rows that repeat an id give a pair twice


def _joining(rows: pa.Table, percent: int) -> pa.Table:
    """Links that join different components of one pair of blocks (or of one block): a forest of them, each exact."""
    rep, part, right = (rows.column(c).to_numpy() for c in ("rep", "c", "right"))
    sets = [np.frombuffer(v.as_buffer(), np.uint64) for chunk in rows.column("s").chunks for v in chunk]
    size = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(column, kind="stable")
    order = order[count[column[order]] > 1]
    owner, column = owner[order], column[order]
    column = np.cumsum(np.diff(column, prepend=column[:1]) != 0)
    left, right = np.flatnonzero(~right), np.flatnonzero(right)
    right = right if len(right) else left
    place = np.zeros(len(sets), np.int64)
    shared = np.zeros((len(left), len(right)), np.float32)
    for k in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (k, k + COLUMNS))
        sides = []
        for side in (left, right):
            place[:] = -1
            place[side] = np.arange(len(side))
            at = place[owner[a:b]]
            m = np.zeros((len(side), COLUMNS), np.float32)
            m[at[at >= 0], column[a:b][at >= 0] - k] = 1
            sides.append(m)
        shared += sides[0] @ sides[1].T
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    found = []
    for i, row in zip(left.tolist(), shared):
        both = row.astype(np.int64)
        for j in right[(100 * both >= percent * (size[i] + size[right] - both)) & (part[i] != part[right])].tolist():
            x, y = root(part[i]), root(part[j])
            if x != y:
                parent[x] = y
                found.append((rep[i], rep[j]))
    a, b = zip(*found) if found else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _crowd_links(crowd: DataFrame, found: DataFrame, sets: DataFrame, percent: int, write=materialise) -> DataFrame | None:
    """Links between different components of a crowd; nothing where each region is in one component."""
    part = crowd.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("region", "rep", F.coalesce("component", "rep").alias("c"))
    part = write(part, "crowd")
    mixed = write(part.groupBy("region").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("region"), "mixed")
    if mixed.isEmpty():
        return None
    rows = part.join(mixed, "region").select(F.col("region").alias("crowd"), "rep", "c").join(sets, "rep").distinct()
    rows = write(rows.select("crowd", "c", "rep", "s"), "crowd-sets")

    # Components of more than a block have blocks of their own, the others share some.
    units = F.greatest(F.count("*") / BLOCK, F.sum(F.octet_length("s")) / BLOCK_BYTES).alias("units")
    parts = rows.groupBy("crowd", "c").agg(units)
    parts = write(parts.withColumn("own", F.when(F.col("units") > 1, F.col("c").cast("string")).otherwise("")), "crowd-parts")
    counts = parts.groupBy("crowd", "own").agg(F.ceil(F.sum("units")).cast("long").alias("k"))
    blocks = counts.withColumn("j", F.explode(F.expr("sequence(0L, k - 1)"))).select("crowd", "own", F.xxhash64("crowd", "own", "j").alias("block"))
    blocks = write(blocks, "crowd-blocks")
    other = blocks.select("crowd", F.col("own").alias("own_b"), F.col("block").alias("b"))
    pairs = blocks.withColumnRenamed("block", "a").join(other, "crowd").where("a <= b AND (own <> own_b OR own = '')")
    pairs = pairs.withColumn("pair", F.xxhash64("crowd", "a", "b"))
    sides = pairs.select("pair", F.col("a").alias("block"), F.lit(False).alias("right"))
    sides = sides.union(pairs.where("a <> b").select("pair", F.col("b").alias("block"), F.lit(True).alias("right")))
    rows = rows.join(parts.drop("units"), ["crowd", "c"]).join(counts, ["crowd", "own"])
    rows = rows.withColumn("block", F.xxhash64("crowd", "own", F.pmod(F.xxhash64("rep"), "k")))
    rows = rows.join(sides, "block").select("pair", "right", "rep", "c", "s")
    return write(rows.groupBy("pair").applyInArrow(lambda t: _joining(t, percent), "a long, b long"), "crowd-links")


def near_duplicates(documents: DataFrame, key: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """``doc_id, text_hash, n_shingles, component_id, kept`` of each row: the connected components of documents
    whose sets' shared part is at least ``percent`` hundredths of their union. ``text_hash`` is Spark's xxhash64 of the text."""
    docs = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    sketches = materialise(_sketches(docs), "sketches")
    reps = materialise(_classes(sketches), "classes")
    made: list[DataFrame] = []

    def write(df: DataFrame, name: str) -> DataFrame:
        made.append(materialise(df, name))
        return made[-1]

    members, stars, crowd = _regions(reps, write)

    # Round 1: for each representative the two partners that it meets in the most orders.
    array = F.sort_array(F.collect_list(F.struct("label", "rep")))
    lists = members.groupBy("region").agg(array.alias("m"))
    steps = F.expr("transform(sequence(1, size(m) - 1), i -> struct(m[i].rep AS a, m[i - 1].rep AS b))")
    heads = F.expr("transform(sequence(1, size(m) - 1), i -> struct(m[i].rep AS a, m[0].rep AS b))")
    met = lists.select(F.explode(F.concat(steps, heads)).alias("e")).select("e.a", "e.b", F.lit(1).alias("n")).union(stars)
    met = met.groupBy("a", "b").agg(F.sum("n").alias("n"))
    nearest = met.withColumn("r", F.row_number().over(W.partitionBy("a").orderBy(F.col("n").desc(), "b"))).where("r <= 2")
    first = write(_pairs(nearest), "first")
    sets = _sets(docs, reps, members, stars, write)
    links = _confirm(_likely(first, reps, percent / 100), sets, percent, write)
    joined = materialise(connected_components(links), "joined")

    # Round 2: all other candidates that aren't connected yet.
    part = members.select("region", "rep").join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left")
    part = part.select("region", F.struct(F.coalesce("component", "rep").alias("c"), "rep").alias("x"))
    lists = part.groupBy("region").agg(F.sort_array(F.collect_list("x")).alias("m")).where("m[0].c <> m[size(m) - 1].c")
    cross = F.expr("flatten(transform(m, (x, i) -> transform(filter(m, y -> y.c > x.c), y -> struct(x.rep AS a, y.rep AS b))))")
    inner = lists.select(F.explode(cross).alias("e")).select("e.a", "e.b")
    outer = stars.select("a", "b")
    for side in ("a", "b"):
        names = joined.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}"))
        outer = outer.join(names, side, "left")
    outer = outer.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")
    second = _pairs(inner.union(outer)).join(first, ["a", "b"], "left_anti")
    more = _confirm(_likely(second, reps, percent / 100), sets, percent, write)
    # From the stars of round 1 on: fewer rounds than from its links.
    joining = _crowd_links(crowd, joined, sets, percent, write) if crowd is not None else None
    more = more.union(joining) if joining is not None else more
    found = joined if more.isEmpty() else connected_components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))

    discard(*made, *([joined] if found is not joined else []))

    classes = reps.select("digest", "first", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    classes = materialise(classes.select("digest", "first", F.coalesce("component", "rep").alias("c")), "class-components")
    heads = classes.groupBy("c").agg(F.min("first").alias("head"))
    classes = classes.join(heads, "c").select("digest", "head")
    rows = sketches.select("doc_id", "text_hash", "n_shingles", "digest")
    linked = rows.where("digest IS NOT NULL").join(classes, "digest")
    kept = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_hash") == F.col("head.text_hash"))
    linked = linked.select("doc_id", "text_hash", "n_shingles", F.col("head.doc_id").alias("component_id"), kept.alias("kept"))
    alone = rows.where("digest IS NULL")  # empty sets meet in no join
    return linked.union(alone.select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")))


def deduplicate(documents: DataFrame, key: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """The rows of ``documents`` without near duplicates: one row of each component, and one of rows that repeat an id and text."""
    found = near_duplicates(documents, key, text_col, percent).select("doc_id", "text_hash", "kept")
    by, at = free_name(documents, "key"), free_name(documents, "hash")
    rows = documents.withColumn(by, F.col(key).cast("long")).withColumn(at, F.xxhash64(text_col))

    def meets(other: DataFrame, how: str) -> DataFrame:
        return rows.join(other, F.col(by).eqNullSafe(other["doc_id"]) & (F.col(at) == other["text_hash"]), how)

    once = found.groupBy("doc_id", "text_hash").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n"))
    once = materialise(once.where("NOT kept OR n > 1"), "not-kept-once")
    rows = meets(once.where("NOT kept"), "left_anti")
    repeated = once.where("kept")
    if not repeated.isEmpty():
        rows = meets(repeated, "left_anti").union(meets(repeated, "left_semi").dropDuplicates([by, at]))
    return rows.select(documents.columns)
