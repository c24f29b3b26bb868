"""Approximate vector search: an inverted file of cells, short codes within them, exact scores of the best candidates.

Centres of cells are found by k-means on a sample; every vector goes to the folder of its nearest centre, with a code of what is left: the remainder is cut into parts, and each
part is told by the nearest of at most 256 values, found by k-means on a sample too. A question reads the codes of its nearest cells only, whose scores are sums of looked-up
numbers; its best candidates by these are read in full and scored exactly. What `probes` and `rerank` leave out is the only loss: a search of all cells with all candidates is exact.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part; vectors of another length than the most frequent one lie in a cell of
their own, which is searched exactly; questions of a length that no vector has find nothing; equal scores go to smaller ids; copies of a vector share a cell, however many, which is
read by several tasks; an empty table has no cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import held
from .rank import top
from .retrieve import DIGITS, TaskTop, best_first, by_length, dot, vector_top

#: Cells at most; rows of the samples for each cell and for the codes, about; parts of a vector that get a byte each; steps of k-means.
MOST_CELLS, CELL_SAMPLE, CODE_SAMPLE, CODE_BYTES, STEPS, SEED = 1 << 14, 64, 4096, 16, 10, 11
#: The share of cells that a question reads, and candidates for each row of the result that are scored exactly, unless told otherwise.
PROBED, RERANK = 0.1, 8
#: Questions that are answered at once.
QUESTIONS = 1024
#: The cell of vectors that don't compare with the centres.
OTHERS = -1


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers * centers).sum(1) - 2 * x @ centers.T).argmin(1)


def values_of(x: np.ndarray, most: int = 256, steps: int = STEPS, seed: int = SEED) -> np.ndarray:
    """Centres by Lloyd's steps of a sample that fits one task."""
    rnd = np.random.default_rng(seed)
    found = np.unique(x, axis=0)
    found = found[rnd.permutation(len(found))[:most]]
    for _ in range(steps):
        owner = nearest(x, found)
        counts = np.bincount(owner, minlength=len(found))
        sums = np.stack([np.bincount(owner, weights=x[:, d], minlength=len(found)) for d in range(x.shape[1])], axis=1)
        found = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], found)
    return found.astype(np.float32)


def parts(dim: int) -> list[np.ndarray]:
    return np.array_split(np.arange(dim), min(CODE_BYTES, dim))


def finite(vectors: DataFrame) -> DataFrame:
    """doc_id, vector of the rows that take part."""
    x = F.col("vector")
    fine = F.forall(x, lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf")))
    return vectors.where(x.isNotNull() & (F.size(x) > 0) & fine).select("doc_id", x.cast("array<float>").alias("vector"))


def _sampled(vectors: DataFrame, share: float) -> DataFrame:
    return vectors if share >= 1 else vectors.where(F.pmod(F.xxhash64("doc_id", "vector"), F.lit(1 << 30)) < int(share * (1 << 30)))


def _assigned(centers: np.ndarray, values: list[np.ndarray]):
    """Function for mapInArrow over (doc_id, vector): cell and code of each vector."""

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.full(batch.num_rows, OTHERS, dtype=np.int32)
            codes: list[bytes | None] = [None] * batch.num_rows
            for rows, m in by_length(batch.column(1)):
                if m.shape[1] == centers.shape[1]:
                    cell[rows] = nearest(m, centers)
                    rest = m - centers[cell[rows]]
                    coded = np.stack([nearest(rest[:, p], v) for p, v in zip(parts(m.shape[1]), values, strict=True)], axis=1).astype(np.uint8)
                    for i, code in zip(rows, coded, strict=True):
                        codes[i] = code.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(codes, pa.binary())], names=["doc_id", "vector", "cell", "code"])

    return assign


def save_cells(vectors: DataFrame, path: str, n_cells: int | None = None) -> None:
    """Cells of vectors (doc_id, vector) at the path; without a number, as many as the square root of the vectors, MOST_CELLS at most."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark, rows = vectors.sparkSession, finite(vectors)
    sizes = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.col("count").desc(), "dim").first()
    dim, n = (sizes["dim"], sizes["count"]) if sizes else (0, 0)
    k = max(1, min(n_cells or math.isqrt(n), MOST_CELLS))
    kind = vectors.schema["doc_id"].dataType.simpleString()
    centers, values = np.zeros((0, max(dim, 1)), np.float32), []
    if n:
        compared = rows.where(F.size("vector") == dim)
        sample = held(_sampled(compared, k * CELL_SAMPLE / n), "sample")
        sample = compared if sample.isEmpty() else sample
        model = KMeans(k=k, maxIter=STEPS, seed=SEED, featuresCol="x").fit(sample.select(array_to_vector(F.col("vector").cast("array<double>")).alias("x"))) if k > 1 else None
        centers = np.array(model.clusterCenters(), dtype=np.float32) if model else np.zeros((1, dim), np.float32)
        few = _sampled(sample, CODE_SAMPLE / max(1, sample.count())).select("vector").toArrow().combine_chunks()
        few = few if few.num_rows else sample.limit(CODE_SAMPLE).select("vector").toArrow().combine_chunks()
        x = next(iter(by_length(few.column(0).chunk(0))))[1].astype(np.float32)
        rest = x - centers[nearest(x, centers)]
        values = [values_of(rest[:, p]) for p in parts(dim)]
    dealt = rows.mapInArrow(_assigned(centers, values), f"doc_id {kind}, vector array<float>, cell int, code binary")
    dealt.hint("rebalance", "cell").sortWithinPartitions("cell", "doc_id").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    told = [(OTHERS, i, c.tolist()) for i, c in enumerate(centers)] + [(i, j, v.tolist()) for i, part in enumerate(values) for j, v in enumerate(part)]
    spark.createDataFrame(told, "part int, number int, x array<float>").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")


@dataclass
class VectorCells:
    """vectors: cell, doc_id, vector, code. centers: of the cells; values: of each part of a code. Their sizes are bounded by MOST_CELLS and CODE_BYTES."""

    vectors: DataFrame
    centers: np.ndarray
    values: list[np.ndarray]

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorCells:
        told: dict[int, list] = {}
        for r in spark.read.parquet(f"{path}/model").orderBy("part", "number").collect():
            told.setdefault(r.part, []).append(r.x)
        centers = np.array(told.pop(OTHERS, np.zeros((0, 1))), dtype=np.float32)
        kind = spark.read.parquet(f"{path}/vectors") if len(centers) else None
        return cls(kind, centers, [np.array(told[i], dtype=np.float32) for i in sorted(told)])

    def probed(self, q: np.ndarray, probes: int) -> np.ndarray:
        """[questions, cells]: whether a question reads a cell; the centres of the highest products are read."""
        near = np.argsort(-(q @ self.centers.T), axis=1, kind="stable")[:, :probes]
        out = np.zeros((len(q), len(self.centers)), dtype=bool)
        np.put_along_axis(out, near, True, axis=1)
        return out

    def default_probes(self) -> int:
        return max(1, math.ceil(PROBED * len(self.centers)))

    def candidates(self, numbers: np.ndarray, q: np.ndarray, probes: int, most: int) -> DataFrame:
        """question (its number), cell, doc_id, score: the `most` best of each question by codes, among its cells."""
        reads = self.probed(q, probes)
        cells = np.flatnonzero(reads.any(0)).tolist()
        tables = [q[:, p] @ v.T for p, v in zip(parts(q.shape[1]), self.values, strict=True)]
        kind = self.vectors.schema["doc_id"].dataType.simpleString()
        sent = self.vectors.sparkSession.sparkContext.broadcast((numbers, reads, q @ self.centers.T, tables))

        def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            numbers, reads, base, tables = sent.value
            kept = TaskTop(len(numbers), most)
            for batch in batches:
                cell = batch.column(0).to_numpy()
                coded = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint8).reshape(len(cell), -1)
                for c in np.unique(cell):
                    rows, asking = np.flatnonzero(cell == c), np.flatnonzero(reads[:, c])
                    scores = np.repeat(base[asking, c][:, None], len(rows), axis=1).astype(np.float64)
                    for j, table in enumerate(tables):
                        scores += table[asking][:, coded[rows, j]]
                    kept.add(scores, asking, [batch.column(1).take(pa.array(rows)), pa.array(cell[rows])])
            if (found := kept.best()) is not None and found.num_rows:
                found = found.combine_chunks()
                part = lambda name: found.column(name).chunk(0)
                yield pa.RecordBatch.from_arrays([pa.array(numbers[part("which").to_numpy()]), part("c1"), part("c0"), part("score")], names=["question", "cell", "doc_id", "score"])

        rows = self.vectors.where(F.col("cell").isin(cells)).select("cell", "doc_id", "code")
        found = rows.mapInArrow(search, f"question int, cell int, doc_id {kind}, score double").withColumnRenamed("question", "query_id")
        return top(found, most, best_first()).select(F.col("query_id").alias("question"), "cell", "doc_id")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, rerank: int = RERANK) -> DataFrame:
        """query_id, ord, doc_id, score as vector_top() has them, of the best k in the nearest cells. Questions go out in blocks of QUESTIONS."""
        spark = queries.sparkSession
        asked = queries.select("query_id", F.col("vector").cast("array<float>").alias("vector")).where("vector IS NOT NULL")
        if self.vectors is None:
            return vector_top(asked.select(F.col("query_id").alias("doc_id"), "vector").where(F.lit(False)), asked, k)
        others = self.vectors.where(F.col("cell") == OTHERS).select("doc_id", "vector")
        found = vector_top(others, asked, k).select("query_id", "doc_id", "score")
        probes = min(probes or self.default_probes(), len(self.centers))
        n = max(1, -(-asked.count() // QUESTIONS))
        for b in range(n):
            block = held(asked.where((F.pmod(F.xxhash64("query_id"), F.lit(n)) == b) & (F.size("vector") == self.centers.shape[1])).withColumn("question", F.monotonically_increasing_id()), "questions")
            rows = block.select("question", "vector").orderBy("question").toArrow().combine_chunks()
            if not rows.num_rows:
                continue
            q = next(iter(by_length(rows.column(1).chunk(0))))[1].astype(np.float32)
            numbers = np.arange(rows.num_rows, dtype=np.int32)
            named = spark.createDataFrame([(int(i), int(x)) for i, x in enumerate(rows.column(0).to_pylist())], "number int, question long")
            near = held(self.candidates(numbers, q, probes, rerank * k), "near")
            cells = [r.cell for r in near.select("cell").distinct().collect()]  # as many as the question block reads
            whole = self.vectors.where(F.col("cell").isin(cells)).select("cell", "doc_id", "vector")
            met = whole.join(F.broadcast(near.withColumnRenamed("question", "number")), ["cell", "doc_id"])
            asking = F.broadcast(block.join(F.broadcast(named), "question").select("number", "query_id", F.col("vector").alias("q")))
            found = found.unionByName(met.join(asking, "number").select("query_id", "doc_id", F.round((1 + dot(F.col("vector"), F.col("q"))) / 2, DIGITS).alias("score")))
        return top(found, k, best_first()).select("query_id", "ord", "doc_id", "score")
