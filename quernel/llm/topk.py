"""Exact top-k search by inner product with pivot-table elimination.

Vectors become integers, floor(scale * x). The pivot table holds each vector's distances to a few pivots. For a query q and a vector x,
|d(q, p) - d(x, p)| <= d(q, x) for every pivot p; the largest of these lower bounds gives q*x <= (|q|^2 + |x|^2 - bound^2) / 2. Vectors are
scored by falling bound, until the bound of the next is below the k-th best score: exact, and ties are kept in full.

The table is written in chunks. Queries, a stated set, go out in blocks of bounded size, each over all chunks; a chunk returns
at most k rows for a query, and only such as reach the k-th best score among a bounded sample of vectors, which the final k must reach too.

Defined cases: vectors that are null, empty or hold a null or non-finite component take no part, nor do rows without an id; a query's own row is any with its id;
equal scores go to the smaller id; vectors are compared with those of the same length only; repeated rows are candidates each, while
equal query rows count once; an empty table gives an empty result. Components of any size take part, if a double holds them when scaled: they are whole numbers that a double holds, products of which
the norms allow more than a double tells exactly are made of Python's integers, and only a score among the best k that exceeds a long stops the search, with a message.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SCALE, TOP = 1024, 10
PIVOTS, SAMPLE = 32, 2048
#: Share of the product of two norms that rounding changes in sums of doubles, at most.
ROUNDING = 1e-9
#: Vectors in a chunk of the table, queries in a broadcast block.
CHUNK, BLOCK = 4096, 2048


#: Whole numbers below this are exact as doubles, sums and all; squared norms below it are far enough from where they aren't.
EXACT, NARROW = float(1 << 52), float(1 << 50)


def usable(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v: the vectors of the rows that take part, of whole numbers as doubles."""
    x = F.col("embedding")
    fine = F.forall(x, lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a.cast("double") * scale) < float("inf")))

    def whole(a: Column) -> Column:
        scaled = a.cast("double") * scale
        return F.when(F.abs(scaled) < EXACT, F.floor(scaled).cast("double")).otherwise(scaled)

    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & fine).select(F.col("vec_id").cast("long"), F.transform(x, whole).alias("v"))


def by_length(ids: np.ndarray, lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix of the vectors of each length."""
    flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    sizes = np.diff(offsets)
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield ids[rows], flat[offsets[rows][:, None] + np.arange(d)]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", over="ignore"):
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T, 0))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first: each pivot is the sample's vector farthest from those chosen before."""
    chosen, far = [0], distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(n, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def exact_product(x: np.ndarray, y: np.ndarray) -> int:
    return sum(int(a) * int(b) for a, b in zip(x, y, strict=True))


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids, in that order."""
    return np.lexsort((ids, -scores))[:k]


class PivotIndex:
    def __init__(self, vectors: DataFrame, n_pivots: int = PIVOTS, sample: int = SAMPLE):
        """vectors: vec_id, v. The sample (at most `sample` rows, by hash of the id) chooses the pivots; every row is in the table."""
        rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).toArrow().combine_chunks()
        self.sample = {}
        if rows.num_rows:
            lists = rows.column(1).chunk(0) if isinstance(rows.column(1), pa.ChunkedArray) else rows.column(1)
            self.sample = {m.shape[1]: (ids, m) for ids, m in by_length(rows.column(0).to_numpy(), lists)}
        # Pivots are vectors to which distances are exact.
        short = {d: m[np.einsum("ij,ij->i", m, m) < NARROW] for d, (_, m) in self.sample.items()}
        self.pivots = {d: choose_pivots(m, n_pivots) for d, m in short.items() if len(m)}
        self.table = written(self._table(vectors), "pivots")

    def _table(self, vectors: DataFrame) -> DataFrame:
        """dim, ids, vectors, distances: chunks of the pivot table as bytes. Lengths that the sample lacks get no pivots: their bounds are the norms'."""
        pivots = vectors.sparkSession.sparkContext.broadcast(self.pivots)

        def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            waiting: dict[int, list] = {}

            def chunk(d: int) -> pa.RecordBatch:
                ids, m = (np.concatenate(x) for x in zip(*waiting.pop(d), strict=True))
                to = distances(m, pivots.value[d]) if d in pivots.value else np.zeros((len(m), 0))
                return pa.RecordBatch.from_arrays([pa.array([d]), *(pa.array([a.tobytes()], pa.binary()) for a in (ids, m, to))], names=["dim", "ids", "vectors", "distances"])

            for batch in batches:
                for ids, m in by_length(batch.column(0).to_numpy(), batch.column(1)):
                    for i in range(0, len(ids), CHUNK):
                        d = m.shape[1]
                        waiting.setdefault(d, []).append((ids[i : i + CHUNK], m[i : i + CHUNK]))
                        if sum(len(x) for x, _ in waiting[d]) >= CHUNK:
                            yield chunk(d)
            for d in list(waiting):
                yield chunk(d)

        return vectors.mapInArrow(pack, "dim long, ids binary, vectors binary, distances binary")

    def floor(self, ids: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
        """For each query a number that the k-th best score among the sample reaches: the k-th best of all is no lower."""
        if (found := self.sample.get(queries.shape[1])) is None or len(found[0]) <= k:
            return np.full(len(ids), -np.inf)
        with np.errstate(invalid="ignore", over="ignore"):
            norms = np.sqrt((queries * queries).sum(1))[:, None] * np.sqrt((found[1] * found[1]).sum(1))
            scores = queries @ found[1].T - np.where(norms < EXACT, 0, norms * ROUNDING)
        scores[(ids[:, None] == found[0]) | ~np.isfinite(norms) | np.isnan(scores)] = -np.inf
        return np.partition(scores, -k, axis=1)[:, -k]

    def search(self, queries: DataFrame, k: int = TOP) -> DataFrame:
        """query_id, rank, vec_id, score of the queries (vec_id, v)."""
        spark = queries.sparkSession
        asked = queries.distinct()
        n = max(1, math.ceil(asked.count() / BLOCK))
        parts = []
        for b in range(n):
            rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == b).toArrow().combine_chunks()
            sets = {}
            for ids, m in by_length(rows.column(0).to_numpy(), rows.column(1).chunk(0)) if rows.num_rows else ():
                order = np.lexsort((*m.T[::-1], ids))
                ids, m = ids[order], m[order]
                to = distances(m, self.pivots[m.shape[1]]) if m.shape[1] in self.pivots else np.zeros((len(m), 0))
                sets[m.shape[1]] = (ids, m, to, self.floor(ids, m, k))
            parts.append(self.table.mapInArrow(search_chunks(spark.sparkContext.broadcast(sets), k), "block int, dim long, query long, query_id long, vec_id long, score long, beyond int").withColumn("block", F.lit(b)))
        found = parts[0]
        for part in parts[1:]:
            found = found.unionByName(part)
        place = F.row_number().over(Window.partitionBy("block", "dim", "query").orderBy(F.col("beyond").desc(), F.col("score").desc(), "vec_id"))
        score = F.when(F.col("beyond") == 0, F.col("score")).otherwise(F.raise_error(F.lit("a score exceeds a long; use a smaller scale")).cast("long"))
        return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))


def search_chunks(sets, k: int):
    """Function for mapInArrow over the table: the best k of each chunk's vectors for each query. beyond: 1 or -1 where a score exceeds a long."""
    least_long, most_long = -(1 << 63), (1 << 63) - 1

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(invalid="ignore", over="ignore")
        for batch in batches:
            for dim, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if dim not in sets.value:
                    continue
                ids = np.frombuffer(packed[0], dtype=np.int64)
                x = np.frombuffer(packed[1]).reshape(len(ids), dim)
                to = np.frombuffer(packed[2]).reshape(len(ids), -1)
                q_ids, queries, q_to, floors = sets.value[dim]
                squares = (x * x).sum(1)
                norms = np.sqrt(squares)
                out = []
                for i, q in enumerate(queries):
                    square = float((q * q).sum())
                    far = np.abs(to - q_to[i]).max(1, initial=0.0)
                    # A unit more covers rounding; scores are whole numbers. Distances of long vectors are too inexact: their bounds are the norms'.
                    bound = (square + squares - far * far) / 2 * (1 + 1e-12) + 1
                    by_norms = np.nan_to_num(np.sqrt(square) * norms * (1 + ROUNDING) + 1, nan=np.inf, posinf=np.inf)
                    bound = np.where((squares < NARROW) & (square < NARROW), bound, by_norms)
                    bound[ids == q_ids[i]] = -np.inf
                    live = np.flatnonzero((bound >= floors[i]) & (ids != q_ids[i]))
                    live = live[np.argsort(-bound[live], kind="stable")]
                    find = narrow if np.sqrt(square) * norms.max(initial=0) < EXACT else wide
                    got_ids, got = find(q, x, ids, bound, live, floors[i])
                    beyond = np.zeros(len(got), np.int32)
                    if got.dtype == object:
                        beyond = np.array([(s > most_long) - (s < least_long) for s in got], dtype=np.int32)
                        got = np.array([min(max(s, least_long), most_long) for s in got], dtype=np.int64)
                    out.append((np.full(len(got), i), np.full(len(got), q_ids[i]), got_ids, got, beyond))
                query, query_id, vec_id, score, beyond = (np.concatenate(c) for c in zip(*out, strict=True))
                columns = [np.zeros(len(query), np.int32), np.full(len(query), dim), query, query_id, vec_id, score]
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.array(beyond.astype(np.int32))], names=["block", "dim", "query", "query_id", "vec_id", "score", "beyond"])

    def narrow(q: np.ndarray, x: np.ndarray, ids: np.ndarray, bound: np.ndarray, live: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best k, where products are exact as doubles."""
        got_ids, got, at, step = np.empty(0, np.int64), np.empty(0, np.int64), 0, 64
        while at < len(live) and bound[live[at]] >= least:
            now = live[at : at + step]
            score = (x[now] @ q).astype(np.int64)
            fine = score >= least
            got_ids, got = np.concatenate([got_ids, ids[now][fine]]), np.concatenate([got, score[fine]])
            top = best(got_ids, got, k)
            got_ids, got = got_ids[top], got[top]
            if len(got) == k:
                least = max(least, int(got[-1]))
            at, step = at + step, step * 2
        return got_ids, got

    def wide(q: np.ndarray, x: np.ndarray, ids: np.ndarray, bound: np.ndarray, live: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """The same by Python's integers."""

        def near(score: int) -> float:
            """A double that the score reaches."""
            try:
                return float(score) - abs(float(score)) * ROUNDING
            except OverflowError:
                return np.inf if score > 0 else -np.inf

        got: list[tuple[int, int]] = []
        for j in live:
            if bound[j] < least:
                break
            got = sorted([*got, (-exact_product(q, x[j]), int(ids[j]))])[:k]
            if len(got) == k:
                least = max(least, near(-got[-1][0]))
        return np.array([i for _, i in got], dtype=np.int64), np.array([-s for s, _ in got], dtype=object)

    return search


def exact_topk(vectors: DataFrame, is_query: Column, k: int = TOP, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest of all other rows of vectors (vec_id, embedding) for each row with is_query."""
    whole = usable(vectors, scale)
    return PivotIndex(whole).search(whole.where(is_query), k)


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
), ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 10
"""
