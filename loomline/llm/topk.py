"""Exact top-k search by inner product over a pivot-distance index.

Vectors become whole numbers, floor(scale * x). Pivots are a bounded, stated sample. Each vector is keyed by its
nearest pivot and its distance to it; in each task's part, a cell's vectors are sorted by that distance and cut into
annuli. For a query q and an annulus around pivot p with radii [lo, hi], the triangle inequality gives
|q - x| >= max(0, d(q, p) - hi, lo - d(q, p)), and q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2 bounds the score from above;
Cauchy's inequality gives q.p + |q| hi. Annuli are visited in order of their bounds until the bound is below the k-th
best score that is known, which starts from the sample. Bounds have slack for rounding; scores are whole numbers.

Queries go out in blocks of up to about `QUERY_BYTES`, one block at a time: it is broadcast, searched, its result written in the
shared folder and the broadcast released. A block's candidates are at most k + 1 rows a query and task, cut again to these
by partial sums before the last ranking. Vectors are dealt evenly, whatever the size of a cell. Rows are held in arrays by
the power of two of their width, so that one very wide vector does not pad the others.

Cases: vectors that are null, or hold null or non-finite components, and rows without an id take no part; shorter vectors
count as padded with zeros; every row that is_query holds for asks, also where several have one id; candidates are all rows
but the query's own (rows alike in id and vector cannot be told apart, so one of them counts as own); ties go to the smaller
vec_id; an empty vector scores 0 with all; a whole number, or a score, beyond 64 bits is the largest or smallest of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_table, stage_table

PIVOTS, SAMPLE, ANNULUS = 64, 4096, 256
#: Bytes of a block of queries, and of the vectors that a task searches at once.
QUERY_BYTES, PART_BYTES = 16 << 20, 32 << 20
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def usable(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and vector (array of long) of the rows that take part."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.col("vec_id").isNotNull() & v.isNotNull() & finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vector"))


@dataclass
class Rows:
    """Ids and vectors of about one width, shorter ones padded with zeros."""

    ids: np.ndarray
    x: np.ndarray


def rows_of(ids: np.ndarray, vectors: pa.ListArray) -> list[Rows]:
    """Rows by the power of two of their width."""
    width = np.diff(vectors.offsets.to_numpy())
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    kind = np.ceil(np.log2(np.maximum(width, 1)))
    starts = np.cumsum(width) - width
    out = []
    for k in np.unique(kind):
        at = np.flatnonzero(kind == k)
        widest = int(width[at].max())
        inside = np.arange(widest) < width[at][:, None]
        x = np.zeros(inside.shape, np.int64)
        x[inside] = values[(starts[at][:, None] + np.arange(widest))[inside]]
        out.append(Rows(ids[at], x))
    return out


def _table_rows(table: pa.Table) -> list[Rows]:
    return [r for batch in table.combine_chunks().to_batches() for r in rows_of(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1))]


def _exact(x: np.ndarray) -> np.ndarray:
    """As doubles where all sums of products are exact in them, else as whole numbers."""
    f = x.astype(np.float64)
    return f if float(np.abs(f).max(initial=0)) ** 2 * max(1, x.shape[1]) < 2**52 else x


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, over the width that both have; beyond 64 bits the largest or smallest of these."""
    w = min(a.shape[1], b.shape[1])
    a, b = a[:, :w], b[:, :w]
    if a.dtype == b.dtype == np.float64:
        return np.rint(a @ b.T).astype(np.int64)
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * max(1, w)
    if most < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    exact = a.astype(np.int64).astype(object) @ b.astype(np.int64).astype(object).T  # Python's whole numbers have no end
    return np.array([[min(max(int(s), int(_LEAST)), int(_MOST)) for s in row] for row in exact], np.int64).reshape(len(a), len(b))


def _square(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.float64) ** 2).sum(1)


def _distance(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner products and distances of all rows of a and b, as doubles."""
    w = min(a.shape[1], b.shape[1])
    dot = a[:, :w].astype(np.float64) @ b[:, :w].astype(np.float64).T
    return dot, np.sqrt(np.maximum(0, _square(a)[:, None] - 2 * dot + _square(b)))


class Index:
    """Cells of one part of the vectors: annuli sorted by their distance to the cell's pivot."""

    def __init__(self, rows: Rows, pivots: np.ndarray):
        _, d = _distance(rows.x, pivots)
        cell = d.argmin(1)
        dist = d[np.arange(len(d)), cell]
        order = np.lexsort((rows.ids, dist, cell))
        self.ids, self.x, norm = rows.ids[order], _exact(rows.x[order]), np.sqrt(_square(rows.x)[order])
        cell, dist = cell[order], dist[order]
        begins = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        self.cuts = np.array([(b, min(b + ANNULUS, e)) for s, e in zip(begins, np.append(begins[1:], len(cell))) for b in range(s, e, ANNULUS)], np.int64)
        self.cell = cell[self.cuts[:, 0]]
        self.lo, self.hi = dist[self.cuts[:, 0]], dist[self.cuts[:, 1] - 1]
        self.widest = np.maximum.reduceat(norm, self.cuts[:, 0])

    def bounds(self, queries: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        """Most that a query can score in each annulus."""
        dot, d = _distance(queries, pivots)
        dot, d, square = dot[:, self.cell], d[:, self.cell], _square(queries)[:, None]
        gap = np.maximum(0, np.maximum(d - self.hi, self.lo - d))
        top = np.minimum((square + self.widest**2 - gap**2) / 2, dot + np.sqrt(square) * self.hi)
        return np.maximum(top + 1e-6 * (1 + np.abs(top) + square + self.widest**2 + self.hi**2), float(_LEAST))  # no score is less than that

    def search(self, asked: Rows, floor: np.ndarray, pivots: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(query's number, candidates' ids, scores, whether id and vector are the query's): the k best of this part that reach the floor."""
        exact = _exact(asked.x)
        for start in range(0, len(exact), 256):
            bound = self.bounds(asked.x[start : start + 256], pivots)
            order = np.argsort(-bound, axis=1, kind="stable")
            for i in range(len(bound)):
                q, least = start + i, int(floor[start + i])
                found_ids, found, found_at = (np.empty(0, np.int64) for _ in range(3))
                at, step = 0, 4
                while at < len(self.cuts):
                    wave = order[i, at : at + step]
                    wave = wave[bound[i, wave] >= least]
                    if not len(wave):
                        break
                    rows = np.concatenate([np.arange(*self.cuts[c]) for c in wave])
                    s = _scores(exact[q : q + 1], self.x[rows])[0]
                    ok = s >= least
                    found_ids, found, found_at = (np.concatenate(x) for x in ((found_ids, self.ids[rows[ok]]), (found, s[ok]), (found_at, rows[ok])))
                    best = _order(found_ids, found, self._same(asked, q, found_ids, found_at))[:k]
                    found_ids, found, found_at = found_ids[best], found[best], found_at[best]
                    if len(found) == k:
                        least = max(least, int(found[-1]))
                    at, step = at + step, step * 2
                if len(found):
                    yield q, found_ids, found, self._same(asked, q, found_ids, found_at)

    def _same(self, asked: Rows, q: int, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = ids == asked.ids[q]
        w = min(asked.x.shape[1], self.x.shape[1])
        for i in np.flatnonzero(out).tolist():
            x, y = asked.x[q], self.x[at[i]]
            out[i] = (x[:w] == y[:w]).all() and not x[w:].any() and not y[w:].any()
        return out


def _order(ids: np.ndarray, scores: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Best first: by score, then by id, the query's own row before others that tie with it."""
    return np.lexsort((~same, ids, ~scores))  # ~s falls as s grows, and has no overflow


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id and score: for each usable row that is_query holds for, its k best other rows."""
    rows = usable(vectors, scale)
    every = max(1, vectors.count() // SAMPLE)
    sample = _table_rows(rows.where(F.pmod(F.xxhash64("vec_id", "vector"), F.lit(every)) == 0).limit(2 * SAMPLE).toArrow())  # fits pivots and first floors only
    pivots = max((s.x for s in sample), key=len, default=np.zeros((1, 1), np.int64))
    pivots = pivots[:: max(1, len(pivots) // PIVOTS)][:PIVOTS]
    asked = stage_table(rows.where(is_query).withColumn("n", F.xxhash64(F.monotonically_increasing_id())), "asked")
    kind = F.ceil(F.log2(F.greatest(F.size("vector"), F.lit(1)).cast("double")))
    found = []
    for r in asked.groupBy(kind.alias("kind")).count().collect():  # as many rows as there are powers of two
        parts = -(-r["count"] // max(1, QUERY_BYTES // (8 << int(r["kind"]))))
        for part in range(parts):
            block = asked.where((kind == r["kind"]) & (F.pmod("n", F.lit(parts)) == part)).select("vec_id", "vector").toArrow()
            found += [_block(rows, q, sample, pivots, k) for q in _table_rows(block) if len(q.ids)]
    drop_table(asked)
    if not found:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = found[0]
    for f in found[1:]:
        out = out.unionAll(f)
    return out


def _block(rows: DataFrame, asked: Rows, sample: list[Rows], pivots: np.ndarray, k: int) -> DataFrame:
    """The ranks of one block of queries, written."""
    floor = np.full(len(asked.ids), _LEAST)
    if sum(len(s.ids) for s in sample) > k:
        q, known = _exact(asked.x), [_exact(s.x) for s in sample]
        for a in range(0, len(floor), 512):
            score = np.concatenate([_scores(q[a : a + 512], s) for s in known], axis=1)
            floor[a : a + 512] = np.partition(score, -(k + 1), axis=1)[:, -(k + 1)]  # one of them may be the query's own row
    sent = rows.sparkSession.sparkContext.broadcast((asked, floor, pivots))
    near = rows.mapInArrow(_searcher(sent, k + 1), "query int, query_id long, vec_id long, score long, same boolean")
    w = W.partitionBy("query")
    first = near.withColumn("n", F.row_number().over(w.orderBy(F.desc("score"), "vec_id", F.desc("same")))).where(F.col("n") <= k + 1)
    own = F.coalesce(F.min(F.when(F.col("same"), F.col("n"))).over(w), F.lit(k + 2))
    ranked = first.withColumn("own", own).where(F.col("n") != F.col("own")).withColumn("rank", F.col("n") - (F.col("n") > F.col("own")).cast("int"))
    out = stage_table(ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "top-k")
    sent.unpersist()
    return out


def _searcher(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, floor, pivots = sent.value
        parts: list[pa.RecordBatch] = []
        size = 0

        def search() -> Iterator[pa.RecordBatch]:
            for rows in _table_rows(pa.Table.from_batches(parts)):
                out = list(Index(rows, pivots).search(asked, floor, pivots, k))
                if out:
                    n = [len(o[1]) for o in out]
                    number = np.repeat([o[0] for o in out], n)
                    columns = (pa.array(number, pa.int32()), pa.array(asked.ids[number]), *(pa.array(np.concatenate([o[j] for o in out])) for j in (1, 2, 3)))
                    yield pa.RecordBatch.from_arrays(list(columns), names=["query", "query_id", "vec_id", "score", "same"])

        for batch in batches:
            if batch.num_rows:
                parts.append(batch)
                size += batch.nbytes
                if size >= PART_BYTES:
                    yield from search()
                    parts, size = [], 0
        if parts:
            yield from search()

    return run
