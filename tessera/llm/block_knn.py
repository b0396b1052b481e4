"""Exact nearest neighbours by a block matrix join.

Each task packs the vectors that it reads into blocks: int8 codes with their scales, the norms of vectors and of quantisation residuals,
and the original components. Blocks of queries are dealt to groups, blocks of candidates to slices, and each group meets each slice
in one cell, so a candidate is shipped once for each group of up to ``GROUP`` queries and a query once for each slice of up to
``SLICE`` candidates. In a cell, one tile of int8 products gives every approximate inner product at once, and the Cauchy-Schwarz
inequality on the residuals bounds its error. Pairs whose upper bound falls short of the query's k-th lower bound, or of the k-th score found
so far, are dropped; survivors are recomputed in double precision on the original components and merged by heaps, first inside
the cell, then over the cells of a query.

The products of int8 codes are summed by a single-precision matrix product over at most ``EXACT`` dimensions at a time: every partial sum is a
whole number below 2 ** 24, so no product is rounded.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor
do rows with a null id; vectors of different dimensions are never neighbours; ties go to the smaller id;
fewer candidates than k give all of them; an empty table gives an empty table; rows that repeat an id are queries and candidates each, so
each such query has its own list, and only the query's own row is not among its candidates; columns of other names don't matter.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, FloatType

from tessera.llm.common import materialise

#: Vectors of a block; queries of a group and candidates of a slice at most, and bytes of either.
BLOCK, GROUP, SLICE, CELL_BYTES = 1024, 16_384, 65_536, 32 << 20
#: Queries and candidates of a tile; dimensions whose products of codes sum exactly; pairs recomputed at once.
TILE_QUERIES, TILE, EXACT, PAIRS = 256, 4096, 1024, 65_536
_FIELDS = ("rows", "ids", "codes", "stats", "vectors")


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """int8 codes; scales, norms of the vectors and norms of the residuals as columns."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = 1.0
    codes = np.rint(x / scale[:, None])
    rest = x - codes * scale[:, None]
    with np.errstate(over="ignore"):
        norms = np.sqrt((x * x).sum(axis=1)), np.sqrt((rest * rest).sum(axis=1))
    return codes.astype(np.int8), np.stack([scale, *norms], axis=1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of int8 codes."""
    out = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], EXACT):
        out += a[:, k:k + EXACT].astype(np.float32) @ b[:, k:k + EXACT].astype(np.float32).T
    return out


def tile(a: np.ndarray, a_stats: np.ndarray, b: np.ndarray, b_stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of two sets of coded vectors."""
    (s, n, r), (t, m, q) = a_stats.T, b_stats.T
    with np.errstate(over="ignore", invalid="ignore"):
        about = products(a, b)
        about *= s[:, None]
        about *= t
        slack = (r * (1 + 1e-9) + 1e-12 * n)[:, None] * m
        slack += ((n + r) * (1 + 1e-9))[:, None] * q
        low, high = about - slack, about + slack
    if not (np.isfinite(a_stats).all() and np.isfinite(b_stats).all()):  # beyond the range of numbers nothing is bounded
        low[np.isnan(low)], high[np.isnan(high)] = -np.inf, np.inf
    return low, high


class _Side:
    """The vectors of one side of a cell."""

    def __init__(self, blocks: pa.Table, dim: int, real: type):
        raw = {c: b"".join(blocks.column(c).to_pylist()) for c in _FIELDS}
        self.rows, self.ids = (np.frombuffer(raw[c], np.int64) for c in ("rows", "ids"))
        self.codes = np.frombuffer(raw["codes"], np.int8).reshape(-1, dim)
        self.stats = np.frombuffer(raw["stats"], np.float64).reshape(-1, 3)
        self.vectors = np.frombuffer(raw["vectors"], real).reshape(-1, dim)


def _nearest(query: _Side, cand: _Side, k: int) -> list[list[tuple[float, int, int]]]:
    """For each query the k best of (-score, id, row), in order."""
    best: list[list] = [[] for _ in query.ids]
    for i in range(0, len(query.ids), TILE_QUERIES):
        mine = slice(i, i + TILE_QUERIES)
        own = query.rows[mine]
        least = np.full(len(own), -np.inf)
        for j in range(0, len(cand.ids), TILE):
            here = slice(j, j + TILE)
            low, high = tile(query.codes[mine], query.stats[mine], cand.codes[here], cand.stats[here])
            same = own[:, None] == cand.rows[None, here]
            high[same] = -np.inf
            open_ = np.isneginf(least)
            if open_.any() and low.shape[1] > k:
                low[same] = -np.inf
                least[open_] = np.partition(low[open_], -k, axis=1)[:, -k]
            q, c = np.nonzero((high >= least[:, None]) & ~same)
            for p in range(0, len(q), PAIRS):
                a, b = q[p:p + PAIRS], c[p:p + PAIRS]
                score = (cand.vectors[j + b].astype(np.float64) * query.vectors[i + a]).sum(axis=1)
                ids, rows = cand.ids[j + b], cand.rows[j + b]
                order = np.lexsort((rows, ids, -score, a))
                a = a[order]
                first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
                rank = np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)]))
                order, a = order[rank < k], a[rank < k]
                fresh = list(zip((-score[order]).tolist(), ids[order].tolist(), rows[order].tolist()))
                ends = np.r_[np.flatnonzero(a[1:] != a[:-1]) + 1, len(a)].tolist()
                for s, e in zip([0, *ends], ends):
                    at = int(a[s])
                    held = [x for x, _ in zip(heapq.merge(best[i + at], fresh[s:e]), range(k))]
                    best[i + at] = held
                    if len(held) == k:
                        least[at] = max(least[at], -held[-1][0])
    return best


def search(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k candidates of the largest inner product for each query row."""
    spark, v = vectors.sparkSession, F.col("v")
    kind = vectors.schema[vector_col].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    real, width = (np.float32, 4) if single else (np.float64, 8)
    sound = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{'float' if single else 'double'}>").alias("v"),
                           F.coalesce(is_query, F.lit(False)).alias("q"))
    sound = sound.where(F.col("id").isNotNull() & (F.size(v) > 0)
                        & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(v, lambda c: c != 0))
    sound = materialise(sound.withColumn("row", F.monotonically_increasing_id()), "vectors")  # read once; rows keep their numbers
    sizes = sound.agg(F.count("*").alias("n"), F.count_if("q").alias("q"), F.max(F.size(v)).alias("dim")).first()
    each = (1 + width) * (sizes["dim"] or 1) + 40
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, -(-sizes["q"] // min(GROUP, max(1, CELL_BYTES // each))))
    slices = max(1, -(-sizes["n"] // min(SLICE, max(1, CELL_BYTES // each))), min(-(-tasks // groups), -(-sizes["n"] // TILE)))

    def pack(batches):
        base, held = TaskContext.get().partitionId() << 40, {}

        def emit(dim):
            nonlocal base
            rows, ids, x = (np.concatenate(p) for p in zip(*held.pop(dim)))
            codes, stats = quantise(x.astype(np.float64))
            out = [[base], [dim], *([a.tobytes()] for a in (rows, ids, codes, stats, x))]
            base += 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [pa.int64(), pa.int32(), *[pa.binary()] * 5])],
                                              names=["block", "dim", *_FIELDS])

        for batch in batches:
            column = batch.column("v")
            ends = column.offsets.to_numpy()
            flat = column.values.to_numpy(zero_copy_only=False)
            lengths = np.diff(ends)
            rows, ids = batch.column("row").to_numpy(), batch.column("id").to_numpy()
            for dim in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dim)
                for p in range(0, len(at), BLOCK):
                    part = at[p:p + BLOCK]
                    held.setdefault(dim, []).append((rows[part], ids[part], flat[ends[part][:, None] + np.arange(dim)]))
                    if sum(len(h[0]) for h in held[dim]) >= BLOCK:
                        yield emit(dim)
        for dim in list(held):
            yield emit(dim)

    schema = "block long, dim int, rows binary, ids binary, codes binary, stats binary, vectors binary"
    place = lambda n: F.pmod(F.xxhash64("block"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    cand = sound.select("row", "id", "v").mapInArrow(pack, schema).select(every(groups).alias("g"), place(slices).alias("s"), F.lit(False).alias("query"), "dim", *_FIELDS)
    query = sound.where("q").select("row", "id", "v").mapInArrow(pack, schema)
    query = query.select(place(groups).alias("g"), every(slices).alias("s"), F.lit(True).alias("query"), "dim", *_FIELDS)

    def cell(t: pa.Table) -> pa.Table:
        dim, side = t.column("dim")[0].as_py(), t.column("query")
        q, c = (_Side(t.filter(m), dim, real) for m in (side, pa.compute.invert(side)))
        rows = [(r, i, n, -s) for r, i, found in zip(q.rows.tolist(), q.ids.tolist(), _nearest(q, c, k)) for s, n, _ in found]
        return pa.table([pa.array(x, ty) for x, ty in zip(zip(*rows) if rows else [()] * 4, [pa.int64()] * 3 + [pa.float64()])],
                        names=["q_row", "query_id", "vec_id", "score"])

    found = cand.union(query).groupBy("g", "s", "dim").applyInArrow(cell, "q_row long, query_id long, vec_id long, score double")
    order = W.partitionBy("q_row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
