"""Exact top-k search by inner product: columnar branch-and-bound over blocks of dimensions.

Vectors are turned into integers and laid out by dimension, the dimensions with most of the queries' mass first. A block
of queries adds up products block of dimensions by block of dimensions; after each, a pair survives only if its sum so
far, plus the products of both vectors' lengths in the blocks that remain, can still reach the query's k-th best score.
Candidates that no query of the block can use are compacted away; once few pairs survive, only these are carried on.
Every task starts from the k-th best score that a query reaches among the first queries, which are candidates too.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, named

K = 5
SCALE = 256
#: Queries that are broadcast at once, and the most bytes of their numbers; queries and vectors compared at once,
#: dimensions of a block.
SLAB, SLAB_BYTES, QUERIES, VECTORS, DIMENSIONS = 16_384, 16 << 20, 64, 4096, 8
#: The share of surviving candidates under which the others are compacted away, and the share of surviving pairs under
#: which single pairs are carried on instead of whole blocks.
COMPACT, SPARSE = 0.7, 1 / 12
#: Queries among which the first bounds of all queries are looked for.
SEEDS = 2048


def whole(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, v) of the rows whose vector has only finite numbers; a null id takes no part."""
    i, v = named(vec_id), named(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.filter(i.isNotNull() & v.isNotNull() & ~bad).select(i.cast("long").alias("id"), v.alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors as columns of floor(SCALE * x); shorter ones end in zeros, which add nothing to a product."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(lengths) and (lengths == lengths[0]).all():
        return np.ascontiguousarray(flat.reshape(len(lengths), -1).T)
    out = np.zeros((int(lengths.max(initial=0)), len(lengths)))
    at = 0
    for i, n in enumerate(lengths.tolist()):
        out[:n, i] = flat[at : at + n]
        at += n
    return out


def _lengths(m: np.ndarray, cuts: list[int]) -> np.ndarray:
    """Lengths of the vectors (columns of m) in each block of dimensions."""
    return np.sqrt(np.array([(m[a:b] ** 2).sum(0) for a, b in zip([0, *cuts], cuts, strict=False)]))


class Best:
    """The k best (score, id) of each query so far: higher scores first, then smaller ids.

    floors: scores that a query's k-th best is known to reach. made and dense count the products of two numbers that
    were computed, and those that a search without bounds would compute.
    """

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray | None = None):
        self.ids, self.queries, self.k = ids, queries, k
        self.floors = np.full(len(ids), -np.inf) if floors is None else floors
        self.order = np.argsort(-(queries**2).sum(1), kind="stable")
        self.laid = queries[self.order]
        self.cuts = [*range(DIMENSIONS, len(queries), DIMENSIONS), len(queries)]
        self.lengths = _lengths(self.laid, self.cuts)
        self.scores = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.made = self.dense = 0

    def add(self, ids: np.ndarray, m: np.ndarray) -> None:
        """Vectors as columns of m. Dimensions that no query has add nothing; those that m lacks are zeros."""
        d = len(self.queries)
        m = np.vstack([m, np.zeros((d - len(m), m.shape[1]))]) if len(m) < d else m[:d]
        m = m[self.order]
        lengths = _lengths(m, self.cuts) * (1 + 1e-9)
        for at in range(0, len(self.ids), QUERIES):
            self._block(slice(at, at + QUERIES), ids, m, lengths)

    def _block(self, rows: slice, ids: np.ndarray, m: np.ndarray, lengths: np.ndarray) -> None:
        q, own = self.laid[:, rows], self.ids[rows]
        q_lengths, worst = self.lengths[:, rows], np.maximum(self.scores[rows, -1], self.floors[rows])
        sums, pairs, before = np.zeros((q.shape[1], m.shape[1])), None, 0
        same = np.searchsorted(own, ids)
        mine = np.flatnonzero((same < len(own)) & (own[np.minimum(same, len(own) - 1)] == ids))
        sums[same[mine], mine] = -np.inf
        self.dense += sums.size * len(m)
        for b, cut in enumerate(self.cuts):
            if pairs is None:
                sums += q[before:cut].T @ m[before:cut]
                self.made += sums.size * (cut - before)
                if cut < len(q):
                    alive = sums + q_lengths[b + 1 :].T @ lengths[b + 1 :] + 1e-3 >= worst[:, None]
                    if np.count_nonzero(alive) <= SPARSE * alive.size:
                        pairs = np.nonzero(alive)
                        part = sums[pairs]
                    elif np.count_nonzero(on := alive.any(0)) <= COMPACT * len(on):
                        ids, m, lengths, sums = ids[on], m[:, on], lengths[:, on], sums[:, on]
            elif len(part):
                i, j = pairs
                part = part + (q[before:cut, i] * m[before:cut, j]).sum(0)
                self.made += part.size * (cut - before)
                alive = part + (q_lengths[b + 1 :, i] * lengths[b + 1 :, j]).sum(0) + 1e-3 >= worst[i]
                pairs, part = (i[alive], j[alive]), part[alive]
            before = cut
        if pairs is None:
            if sums.shape[1] > 4 * self.k:
                worst = np.maximum(worst, np.partition(sums, sums.shape[1] - self.k, 1)[:, sums.shape[1] - self.k])
            i, j = np.nonzero((sums >= worst[:, None]) & np.isfinite(sums))
            part = sums[i, j]
        else:
            i, j = pairs
            on = (part >= worst[i]) & np.isfinite(part)
            i, j, part = i[on], j[on], part[on]
        if len(i):
            self._merge(rows.start, i, part, ids[j])

    def _merge(self, base: int, i: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        hit = np.unique(i)
        row = np.concatenate([i, np.repeat(hit, self.k)])
        score = np.concatenate([scores, self.scores[base + hit].ravel()])
        found = np.concatenate([ids, self.found[base + hit].ravel()])
        order = np.lexsort((found, -score, row))
        row, score, found = row[order], score[order], found[order]
        first = np.searchsorted(row, hit)
        take = first[:, None] + np.arange(self.k)
        self.scores[base + hit], self.found[base + hit] = score[take], found[take]


class Large:
    """The k best vectors of each query in exact integers, for components whose products floats can't hold."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        #: Query's id -> (negated score, id) of its best vectors.
        self.kept: dict[int, list[tuple[int, int]]] = {}

    def add(self, ids: np.ndarray, m: np.ndarray) -> None:
        """Vectors as columns of m."""
        d = min(len(m), len(self.queries))
        m, queries = m[:d], self.queries[:d]
        top = max(1.0, np.abs(m).max(initial=0)) * max(1.0, np.abs(queries).max(initial=0)) * max(d, 1)
        whole = (lambda x: x.astype(np.int64)) if top < 2.0**62 else np.frompyfunc(int, 1, 1)
        m = whole(m)
        for at, own in enumerate(self.ids.tolist()):
            on = ids != own
            scores, of = (whole(queries[:, at]) @ m if d else np.zeros(len(ids), np.int64))[on], ids[on]
            if scores.dtype != object and len(scores) > self.k:
                good = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
                scores, of = scores[good], of[good]
            found = zip((-int(x) for x in scores), of.tolist(), strict=True)
            if best := heapq.nsmallest(self.k, [*self.kept.get(own, []), *found]):
                self.kept[own] = best


def _fits(m: np.ndarray, queries: np.ndarray) -> bool:
    """Whether floats hold all sums of products exactly."""
    top = max(np.abs(m).max(initial=0), np.abs(queries).max(initial=0))
    return top * top * max(len(m), len(queries), 1) < 2.0**53


def floors(ids: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """For each query, its k-th best score among the first SEEDS queries: its k-th best of all is no lower."""
    seeds = Best(ids, queries, k)
    if _fits(queries, queries):
        for at in range(0, min(SEEDS, len(ids)), VECTORS):
            seeds.add(ids[at : min(SEEDS, at + VECTORS)], queries[:, at : min(SEEDS, at + VECTORS)])
    return seeds.scores[:, -1]


def _search(candidates: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    held = candidates.sparkSession.sparkContext.broadcast((ids, queries, floors(ids, queries, k)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, least = held.value
        best, large = Best(ids, queries, k, least), Large(ids, queries, k)
        for batch in batches:
            for at in range(0, batch.num_rows, VECTORS):
                part = batch.slice(at, VECTORS)
                m = _matrix(part.column(1))
                (best if _fits(m, queries) else large).add(part.column(0).to_numpy(), m)
        if large.kept:
            rows = [(q, i, -s) for q, kept in large.kept.items() for s, i in kept]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["query_id", "vec_id", "score"])
        i, j = np.nonzero(np.isfinite(best.scores))
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(best.ids[i]), pa.array(best.found[i, j]), pa.array(best.scores[i, j].astype(np.int64))], names=["query_id", "vec_id", "score"])

    return candidates.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(df: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, slab: int = SLAB) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k best rows by integer inner product of floor(256 * x).

    Ties go to the smaller vec_id. Queries are the rows for which is_query holds, one for each vec_id (of repeated ones
    the least vector); candidates are all rows with another vec_id, each repeated row by itself. Rows whose id or vector
    is null, or whose vector has null or non-finite components, take no part; of vectors of unequal length the
    shorter one counts as ending in zeros. Scores are exact; one among a task's best that 64 bits can't hold is an error. Every candidate
    is scanned once for each `slab` queries, or as many as have SLAB_BYTES of numbers, which are broadcast; a task keeps k
    rows for each of them. An empty table, or one without queries, gives an empty frame.
    """
    candidates = whole(df, vec_id, vector)
    asked = whole(df.filter(is_query), vec_id, vector).groupBy("id").agg(F.min("v").alias("v"))
    n, width = asked.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    slab = max(1, min(slab, SLAB_BYTES // (8 * max(width or 1, 1))))
    slabs = max(1, -(-n * 5 // (4 * slab))) if n > slab else 1
    done = []
    for s in range(slabs):
        rows = asked.filter(F.pmod(F.xxhash64("id"), F.lit(slabs)) == s).orderBy("id").toArrow().combine_chunks()
        ids, queries = rows.column("id").to_numpy(), _matrix(rows.column("v").combine_chunks())
        found = _search(candidates, ids, queries, k)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        ranked = ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        done.append(ranked if slabs == 1 else materialize(ranked))
    return reduce(DataFrame.unionByName, done)


def nearest(embeddings: DataFrame) -> DataFrame:
    return top_k(embeddings, F.col("vec_id") % 50 == 0)
