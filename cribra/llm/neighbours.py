"""Nearest neighbours by a block matrix join of int8 tiles.

Queries and candidates are dealt over tiles by the hash of their id; every pair of
a query tile and a candidate tile is one unit of work, reached by an ordinary
shuffle on the tile numbers, so work and memory of a task have fixed bounds. Inside a
unit the int8 product of both tiles (exact in float32) gives each inner product with
a bound on its quantisation error. Pairs whose upper bound stays under the k-th best
value known so far are dropped; the others are computed again from the original
vectors in double precision and kept in a heap of ``k`` per query. Heaps of all tiles
merge by rank. Nothing is approximated away: the result is that of brute force.

Defined cases: a vector that is null, zero, or holds null or non-finite components
takes no part, as query or candidate, nor does a row without id; of rows with one id
the smallest vector counts, once; a query meets candidates of its own dimension
only; with fewer than ``k`` candidates all come; ties go to the smaller id; an empty
table gives an empty result. Columns other than id and vector are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cribra.llm.common import small_batches, stored

K = 20
#: Rows of a query tile and of a candidate tile.
QUERY_TILE, CANDIDATE_TILE = 8192, 16384
#: Queries and candidates of one product, and pairs computed again at once.
QUERY_STEP, CANDIDATE_STEP, PAIR_STEP = 256, 4096, 1 << 16


#: Components that one float32 product may sum: (2**24 - 1) // 127**2 is 1,040.
EXACT = 1024


class Tile:
    """Vectors with their int8 form, scales, norms and quantisation errors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        # Scaled by the largest component first, so that no square over- or underflows.
        self.scale = np.abs(vectors).max(axis=1) / 127
        # A subnormal vector may have a zero step; it then counts as all error.
        step = np.where(self.scale > 0, self.scale, 1.0)[:, None]
        self.small = np.rint(vectors / step).astype(np.int8)
        near = self.small * self.scale[:, None]
        self.norm = np.sqrt((vectors ** 2).sum(axis=1))
        self.near_norm = np.sqrt((near ** 2).sum(axis=1))
        self.error = np.sqrt(((vectors - near) ** 2).sum(axis=1))

    def part(self, s: slice) -> Tile:
        out = object.__new__(Tile)
        out.__dict__ = {k: v[s] for k, v in self.__dict__.items()}
        return out


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row inner products, summed in the order of the components."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def whole_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows. A float32 sum of EXACT products of at most 127 by 127 is a
    whole number below 2**24; longer vectors are cut, and the parts summed as doubles."""
    out = np.zeros((len(a), len(b)))
    for s in range(0, a.shape[1], EXACT):
        out += a[:, s:s + EXACT].astype(np.float32) @ b[:, s:s + EXACT].astype(np.float32).T
    return out


def bounds(q: Tile, c: Tile) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all inner products of two tiles."""
    guess = whole_product(q.small, c.small) * (q.scale[:, None] * c.scale[None, :])
    slack = q.error[:, None] * c.norm[None, :] + q.near_norm[:, None] * c.error[None, :]
    slack += 1e-9 * (q.norm[:, None] * c.norm[None, :]) + 1e-300  # rounding of the bounds themselves
    return guess - slack, guess + slack


def search(q: Tile, c: Tile, heaps: list[list[tuple[float, int]]], k: int) -> None:
    """Merge the best of ``c`` into the heap of every query of ``q``.

    A heap holds ``(score, -id)``, its least entry first.
    """
    low, high = bounds(q, c)
    low = np.where(c.ids[None, :] == q.ids[:, None], -np.inf, low)
    if low.shape[1] > k:
        floor = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k]
    else:
        floor = np.full(len(low), -np.inf)
    known = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps])
    i, j = np.nonzero((high >= np.maximum(floor, known)[:, None]) & (c.ids[None, :] != q.ids[:, None]))
    for s in range(0, len(i), PAIR_STEP):
        a, b = i[s:s + PAIR_STEP], j[s:s + PAIR_STEP]
        score = inner(q.vectors[a], c.vectors[b])
        order = np.lexsort((c.ids[b], -score, a))
        a, b, score = a[order], b[order], score[order]
        start = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
        place = np.arange(len(a)) - np.repeat(start, np.diff(np.concatenate((start, [len(a)]))))
        for x, y, v in zip(a[place < k].tolist(), c.ids[b[place < k]].tolist(),
                           score[place < k].tolist(), strict=True):
            heap = heaps[x]
            if len(heap) < k:
                heapq.heappush(heap, (v, -y))
            elif (v, -y) > heap[0]:
                heapq.heapreplace(heap, (v, -y))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id``, ``v`` (double components) of the vectors that take part, one per id."""
    v = F.col(vector_col).cast("array<double>")
    good = (F.col(id_col).isNotNull() & v.isNotNull()
            & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
            & F.exists(v, lambda x: x != 0.0))
    return (vectors.where(good).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
            .groupBy("id").agg(F.min("v").alias("v")))


def nearest(vectors: DataFrame, is_query: F.Column, id_col: str = "vec_id",
            vector_col: str = "embedding", k: int = K, query_tile: int = QUERY_TILE,
            candidate_tile: int = CANDIDATE_TILE) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of each query's ``k`` largest inner products.

    ``is_query`` is a condition on the column ``id``.
    """
    small_batches(vectors.sparkSession)
    rows = stored(usable(vectors, id_col, vector_col))
    size = rows.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).first()
    across, down = max(1, -(-size["n"] // candidate_tile)), max(1, -(-size["q"] // query_tile))
    spread = F.xxhash64("id")
    queries = rows.where(is_query).select(
        F.lit(0).alias("side"), "id", "v", F.pmod(spread, F.lit(down)).alias("qt"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))).alias("ct"))
    candidates = rows.select(
        F.lit(1).alias("side"), "id", "v",
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long"))).alias("qt"),
        F.pmod(spread, F.lit(across)).alias("ct"))
    units = (queries.unionByName(candidates).withColumn("dim", F.size("v"))
             .repartition("dim", "qt", "ct").sortWithinPartitions("dim", "qt", "ct", "side"))

    def run(batches):
        unit, q, heaps, held, size = None, None, [], [], 0
        asked: list[tuple] = []

        def result():
            found = [(i, -y, s) for i, h in zip(q.ids.tolist(), heaps, strict=True) for s, y in h]
            if found:
                a, b, s = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())],
                    names=["query_id", "vec_id", "score"])

        def compare():
            c = Tile(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
            for s in range(0, len(q.ids), QUERY_STEP):
                at = slice(s, s + QUERY_STEP)
                search(q.part(at), c, heaps[at], k)

        for b in batches:
            side, ids, dim, qt, ct = (b.column(n).to_numpy() for n in (0, 1, 3, 4, 5))
            flat = b.column(2).flatten().to_numpy()
            ends = np.cumsum(dim)
            edge = np.flatnonzero((np.diff(dim) != 0) | (np.diff(qt) != 0) | (np.diff(ct) != 0)
                                  | (np.diff(side) != 0)) + 1
            for s, e in zip([0, *edge.tolist()], [*edge.tolist(), len(ids)], strict=True):
                if s == e:
                    continue
                if (dim[s], qt[s], ct[s]) != unit:
                    if q is not None:
                        if held:
                            compare()
                        yield from result()
                    unit, q, asked, held, size = (dim[s], qt[s], ct[s]), None, [], [], 0
                part = (ids[s:e], flat[ends[s] - dim[s]:ends[e - 1]].reshape(e - s, dim[s]))
                if side[s] == 0:
                    asked.append(part)
                    continue
                if q is None:
                    if not asked:
                        continue  # no query of this dimension and tile
                    q = Tile(np.concatenate([x[0] for x in asked]), np.concatenate([x[1] for x in asked]))
                    heaps = [[] for _ in q.ids]
                held.append(part)
                size += e - s
                if size >= CANDIDATE_STEP:
                    compare()
                    held, size = [], 0
        if q is not None:
            if held:
                compare()
            yield from result()

    best = units.select("side", "id", "v", "dim", "qt", "ct").mapInArrow(
        run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (best.withColumn("rank", rank).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
