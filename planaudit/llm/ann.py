"""Approximate nearest neighbours by inner product: IVF with product-quantised residuals.

Coarse centroids and sub-quantisers are fitted on a bounded sample; every vector
is then assigned to its nearest centroid and its residual is coded. A query visits
the cells whose centroids are nearest to it, ranks their codes by asymmetric
distance tables, and the best candidates are reranked on the original vectors in
double precision.

The index is dealt in blocks of about 131072 coded vectors by hashed id, so a cell
with a large share of all vectors is spread over all of them; each block has its
part of every inverted list, and meets the queries in crowds of at most about 8192;
a query reads the lists of its cells and no other code.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planaudit.llm.common import materialize

FIT_SAMPLE = 16_384
MAX_CELLS = 4096
SUB_DIM, CODES = 4, 256
BLOCK, QUERY_BLOCK = 131_072, 8192
LEAST_TASKS = 16


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v of the rows that take part: no null, zero or non-finite vector, and an id."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull()).where(~bad & F.exists(v, lambda x: x != 0))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 0) -> np.ndarray:
    """Lloyd's algorithm; an empty cell moves to a random point."""
    rng = np.random.default_rng(seed)
    points = np.unique(x, axis=0)
    centers = points[rng.permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        own = nearest(x, centers)
        counts = np.bincount(own, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        full = counts > 0
        centers[full] = sums[full] / counts[full, None]
        centers[~full] = x[rng.integers(0, len(x), int((~full).sum()))]
    return centers


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Index of the nearest center (L2), in pieces of bounded size."""
    half = (centers**2).sum(axis=1) / 2
    step = max(1, 4_000_000 // len(centers))
    return np.concatenate([np.argmax(x[i : i + step] @ centers.T - half, axis=1) for i in range(0, len(x), step)] or [np.zeros(0, np.int64)])


class Index:
    """Coarse centroids and the codebooks of the residuals."""

    def __init__(self, sample: np.ndarray, cells: int) -> None:
        self.dim = sample.shape[1]
        self.centers = kmeans(sample, cells)
        residual = sample - self.centers[nearest(sample, self.centers)]
        self.cuts = [(i, min(i + SUB_DIM, self.dim)) for i in range(0, self.dim, SUB_DIM)]
        self.books = [kmeans(residual[:, a:b], CODES, 8, a + 1) for a, b in self.cuts]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = nearest(x, self.centers)
        residual = x - self.centers[cell]
        return cell, np.stack([nearest(residual[:, a:b], book).astype(np.uint8) for (a, b), book in zip(self.cuts, self.books, strict=True)], axis=1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner product of each part of a query with every codeword: (parts, codes)."""
        out = np.zeros((len(self.books), CODES), np.float32)
        for i, ((a, b), book) in enumerate(zip(self.cuts, self.books, strict=True)):
            out[i, : len(book)] = book @ q[a:b]
        return out


def _encode(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column(1))
            if x.shape[1] != index.dim:
                raise ValueError("vectors differ in length")
            cell, codes = index.encode(x)
            raw = pa.array([row.tobytes() for row in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell.astype(np.int32)), raw], names=["vec_id", "cell", "code"])


class Lists:
    """The inverted lists of one block: ids and codes in order of cell and id, and where each cell's list begins."""

    def __init__(self, codes: pa.Table, cells: int) -> None:
        codes = codes.sort_by([("cell", "ascending"), ("vec_id", "ascending")])
        self.ids = codes.column("vec_id").to_numpy()
        self.at = np.searchsorted(codes.column("cell").to_numpy(), np.arange(cells + 1))
        self.code = np.ascontiguousarray(np.frombuffer(b"".join(codes.column("code").to_pylist()), np.uint8).reshape(len(self.ids), -1).T)

    def visit(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the entries of these cells' lists, and the cell of each."""
        sizes = self.at[cells + 1] - self.at[cells]
        return np.repeat(self.at[cells] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()), np.repeat(cells, sizes)


def _scan(codes: pa.Table, queries: pa.Table, index: Index, probes: int, keep: int) -> pa.Table:
    """Best candidates of one block of the index for one crowd of queries, from the lists that each query visits."""
    out_q, out_v, out_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float64)]
    if codes.num_rows and queries.num_rows:
        lists = Lists(codes, len(index.centers))
        for query, q in zip(queries.column("query_id").to_pylist(), _matrix(queries.column("q").combine_chunks()), strict=True):
            near = (index.centers @ q).astype(np.float32)
            rows, cell = lists.visit(np.argsort(-near, kind="stable")[:probes])
            score = near[cell]
            for part, table in zip(lists.code, index.tables(q), strict=True):
                score += table[part[rows]]
            score[lists.ids[rows] == query] = -np.inf
            if len(rows) > keep:
                often = score >= np.partition(score, len(score) - keep)[len(score) - keep]
                rows, score = rows[often], score[often]
            # ties go to the smaller id
            top = np.lexsort((lists.ids[rows], -score))[:keep]
            top = top[score[top] > -np.inf]
            out_q.append(np.full(len(top), query))
            out_v.append(lists.ids[rows[top]])
            out_s.append(score[top].astype(np.float64))
    return pa.table({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v), "near": np.concatenate(out_s)})


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            score = np.einsum("ij,ij->i", _matrix(batch.column(2)), _matrix(batch.column(3)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], names=["query_id", "vec_id", "score"])


def nearest_neighbours(vectors: DataFrame, every: int = 20, k: int = 20, share: float = 0.65, rerank: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k nearest found.

    Queries are the rows whose id is divisible by `every`; candidates are all rows
    but the query's own. Nearness is the inner product, largest first, ties to the
    smaller id. A query visits the cells with the nearest `share` of centroids (64 at
    least) and reranks `rerank` * k candidates. All is returned if there are fewer
    than k candidates in the visited cells; if all cells are visited, that is all.

    Vectors that are null, zero, or hold a null or non-finite component take no
    part, nor do rows with a null id. Vectors of different lengths are an error.
    An id given twice is one candidate, with the smaller of its vectors (compared
    number by number), so reruns agree. Other columns are ignored, whatever their names. An empty table gives an empty result.

    The fit uses the 16384 vectors with the smallest hashed ids; all are indexed.
    """
    rows = materialize(usable(vectors, id_col, vector_col).groupBy("vec_id").agg(F.min("v").alias("v")))
    schema = "query_id long, rank int, vec_id long, score double"
    n = rows.count()
    if not n:
        return vectors.sparkSession.createDataFrame([], schema)
    sample = np.array([r[0] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_SAMPLE).select("v").collect()])
    index = Index(sample, min(MAX_CELLS, max(1, 2 * isqrt(n)), max(1, len(sample) // 16)))
    probes = min(len(index.centers), max(64, ceil(share * len(index.centers))))
    codes = materialize(rows.mapInArrow(lambda it: _encode(it, index), "vec_id long, cell int, code binary"))
    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    n_blocks = ceil(n / BLOCK)
    n_crowds = max(ceil(queries.count() / QUERY_BLOCK), ceil(LEAST_TASKS / n_blocks))
    numbers = [F.sequence(F.lit(0), F.lit(k - 1)) for k in (n_blocks, n_crowds)]
    asked = queries.select(F.explode(numbers[0]).alias("block"), F.pmod(F.xxhash64("query_id"), F.lit(n_crowds)).cast("int").alias("crowd"), "query_id", "q")
    offered = codes.select(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int").alias("block"), F.explode(numbers[1]).alias("crowd"), "vec_id", "cell", "code")
    keys = ["block", "crowd"]
    keep = k * rerank
    found = offered.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(lambda a, b: _scan(a, b, index, probes, keep), "query_id long, vec_id long, near double")
    best = found.withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("near"), "vec_id"))).where(F.col("at") <= keep).select("query_id", "vec_id").distinct()
    pairs = best.join(rows, "vec_id").join(rows.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id").select("query_id", "vec_id", "q", "v")
    exact = pairs.mapInArrow(_exact, "query_id long, vec_id long, score double")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return exact.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
