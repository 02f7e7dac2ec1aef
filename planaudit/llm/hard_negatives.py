"""Hard negatives from lists that the anchors of a cluster share.

Anchors are clustered by direction. For every cluster, candidates are sorted once by
an angular upper bound: with the candidate at angle t to the centroid and the widest
member at angle w, no member's inner product exceeds its own norm times
|candidate| * cos(max(0, t - w)). Each member walks this list and stops as soon as
the bound is below what it still could use: its k-th best score so far, or the least
score that is allowed. That certifies its result, so all are exact.

Candidates are dealt into blocks of about 131072 rows by hashed id, and anchors into
crowds of whole clusters of at most about 8192 (a larger cluster is split); each block
meets each crowd in one task and gives every anchor its best k of the block. The
positives come first, as their scores bound the scores of their negatives.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planaudit.llm.ann import _matrix, kmeans, nearest
from planaudit.llm.common import materialize

FIT_SAMPLE, MAX_CLUSTERS = 16_384, 256
BLOCK, CROWD = 131_072, 8192
LEAST_TASKS = 16
#: Rows of a list, and members, that are scored at once.
STEP, MEMBERS = 4096, 256
EXACT = float(1 << 53)
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def quantized(vectors: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, label and v (whole numbers as doubles) of the rows that take part, one row for each id: the smallest label and vector."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull()).where(~bad)
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * float(scale)).cast("double"))
    row = F.min(F.struct(F.col(label_col).cast("long").alias("label"), whole.alias("v"))).alias("row")
    return rows.groupBy(F.col(id_col).cast("long").alias("id")).agg(row).select("id", "row.label", "row.v")


def _directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and norms; a zero vector stays zero."""
    norm = np.sqrt((x**2).sum(axis=1))
    return x / np.where(norm > 0, norm, 1)[:, None], norm


def _clustered(batches: Iterator[pa.RecordBatch], centers: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            own = nearest(_directions(_matrix(batch.column(1)))[0], centers)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.astype(np.int32))], names=["anchor", "cluster"])


class Walk:
    """One anchor's way along a list: the best k so far for each range of scores that it asks for."""

    def __init__(self, anchor: int, label: int, ranges: list[tuple[int, int, int]], k: int, alike: bool) -> None:
        self.anchor, self.label, self.k, self.alike = anchor, label, k, alike
        self.tag, self.low, self.high = (np.array(x) for x in zip(*ranges, strict=True))
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ranges]
        self.floor = float(self.low.min())

    def take(self, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> None:
        usable = (labels == self.label) & (ids != self.anchor) if self.alike else labels != self.label
        usable &= (scores >= self.floor) & (scores <= self.high.max())
        ids, scores = ids[usable], scores[usable]
        floors = []
        for i, (low, high) in enumerate(zip(self.low, self.high, strict=True)):
            inside = (scores >= low) & (scores <= high)
            if inside.any():
                score, row = np.concatenate([self.found[i][0], scores[inside]]), np.concatenate([self.found[i][1], ids[inside]])
                top = np.lexsort((row, -score))[: self.k]
                self.found[i] = score[top], row[top]
            best = self.found[i][0]
            floors.append(float(best[-1]) if len(best) == self.k else float(low))
        self.floor = min(floors)


def _bounds(unit: np.ndarray, norm: np.ndarray, members: np.ndarray) -> np.ndarray:
    """What a member of norm 1 cannot score above with each candidate, with room for rounding."""
    directions, size = _directions(members)
    directions = directions[size > 0]
    center = directions.sum(axis=0) if len(directions) else np.zeros(unit.shape[1])
    length = np.sqrt((center**2).sum())
    if not length > 0:
        return norm * (1 + 1e-9)
    center /= length
    wide = np.arccos(np.clip((directions @ center).min(), -1, 1))
    apart = np.arccos(np.clip(unit @ center, -1, 1))
    return norm * (np.cos(np.maximum(0, apart - wide - 1e-6)) + 1e-9)


def _walked(rows: pa.Table, asked: pa.Table, k: int, alike: bool) -> pa.Table:
    """The best k of one block for each (anchor, tag) of a crowd."""
    out_a, out_t, out_i, out_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if rows.num_rows and asked.num_rows:
        x, vectors = _matrix(rows.column("v").combine_chunks()), _matrix(asked.column("v").combine_chunks())
        if x.shape[1] != vectors.shape[1]:
            raise ValueError("vectors differ in length")
        if x.shape[1] * float(np.abs(x).max(initial=0)) * float(np.abs(vectors).max(initial=0)) >= EXACT:
            raise ValueError("scores exceed 2**53")
        unit, norm = _directions(x)
        ids, labels = rows.column("id").to_numpy(), rows.column("label").to_numpy()
        clusters = asked.column("cluster").to_numpy()
        walks = [Walk(a, b, [(r["tag"], r["low"], r["high"]) for r in ranges], k, alike) for a, b, ranges in zip(*(asked.column(c).to_pylist() for c in ("anchor", "label", "ranges")), strict=True)]
        sizes = np.sqrt((vectors**2).sum(axis=1))
        for cluster in np.unique(clusters):
            members = np.flatnonzero(clusters == cluster)
            bound = _bounds(unit, norm, vectors[members])
            order = np.argsort(-bound, kind="stable")
            for low in range(0, len(members), MEMBERS):
                active = members[low : low + MEMBERS]
                for at in range(0, len(order), STEP):
                    floors = np.array([walks[m].floor for m in active])
                    active = active[sizes[active] * bound[order[at]] + 1e-6 * (1 + sizes[active]) >= floors]
                    if not len(active):
                        break
                    part = order[at : at + STEP]
                    scores = (vectors[active] @ x[part].T).astype(np.int64)
                    for m, row in zip(active, scores, strict=True):
                        walks[m].take(ids[part], labels[part], row)
        for walk in walks:
            for tag, (score, row) in zip(walk.tag, walk.found, strict=True):
                out_a.append(np.full(len(row), walk.anchor))
                out_t.append(np.full(len(row), tag))
                out_i.append(row)
                out_s.append(score)
    return pa.table({"anchor": np.concatenate(out_a), "tag": np.concatenate(out_t), "id": np.concatenate(out_i), "score": np.concatenate(out_s)})


def _best(rows: DataFrame, asked: DataFrame, n: int, n_crowds: int, k: int, alike: bool) -> DataFrame:
    """anchor, tag, id, score and rank of the best k rows for each range that asked(crowd, cluster, anchor, label, v, ranges) has."""
    n_blocks = ceil(n / BLOCK)
    n_blocks = max(n_blocks, ceil(LEAST_TASKS / n_crowds))
    blocks, crowds = (F.sequence(F.lit(0), F.lit(c - 1)) for c in (n_blocks, n_crowds))
    offered = rows.select(F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int").alias("block"), F.explode(crowds).alias("crowd"), "id", "label", "v")
    sent = asked.select(F.explode(blocks).alias("block"), "crowd", "cluster", "anchor", "label", "v", "ranges")
    keys = ["block", "crowd"]
    found = offered.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(lambda a, b: _walked(a, b, k, alike), "anchor long, tag long, id long, score long")
    order = Window.partitionBy("anchor", "tag").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, k: int = 10, low: int = 30, high: int = 90, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score and negative_score.

    Components count as floor(scale * x), scores are inner products of these whole
    numbers, higher ones first, ties to the smaller id. Anchors are the rows whose id is
    divisible by `every`; the first `positives` other rows of an anchor's label are its
    positives, and of each of these the first k rows of other labels with
    low * positive <= 100 * negative <= high * positive its negatives (all, if there are
    fewer; a negative positive score allows none unless low >= high).

    Rows with a null id, label or vector, or a null or non-finite component, take no
    part; zero vectors do. Vectors of different lengths are an error, and so are
    scores that could reach 2**53. An id given twice is one row, with its smaller label
    and vector. Other columns are ignored, whatever their names. An empty table gives
    an empty result. The clusters are fitted on the 16384 anchors with the smallest
    hashed ids; they change the work only, not the result.
    """
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = materialize(quantized(vectors, scale, id_col, vector_col, label_col))
    anchors = rows.where(F.col("id") % every == 0)
    n, n_anchors = rows.count(), anchors.count()
    if not n_anchors:
        return vectors.sparkSession.createDataFrame([], schema)
    taken = anchors.orderBy(F.xxhash64("id"), "id").limit(FIT_SAMPLE).select("v").collect()
    if len({len(r[0]) for r in taken}) > 1:
        raise ValueError("vectors differ in length")
    sample = _directions(np.array([r[0] for r in taken]).reshape(len(taken), -1))[0]
    centers = kmeans(sample, min(MAX_CLUSTERS, max(1, isqrt(n_anchors))))
    near = anchors.select("id", "v").mapInArrow(lambda it: _clustered(it, centers), "anchor long, cluster int")
    n_crowds = ceil(n_anchors / CROWD)
    often = near.groupBy("cluster").agg(F.count("*").alias("c"))  # one row for each of at most 256 clusters
    split = F.ceil(F.col("c") / CROWD).cast("int")
    crowd = F.pmod(F.xxhash64("cluster", F.pmod(F.xxhash64("anchor"), split)), F.lit(n_crowds)).cast("int")
    members = near.join(F.broadcast(often), "cluster").select("anchor", "cluster", crowd.alias("crowd"))
    members = materialize(members.join(anchors.withColumnRenamed("id", "anchor"), "anchor"))

    def ranges(tag: Column, least: Column, most: Column) -> Column:
        return F.struct(tag.cast("long").alias("tag"), least.cast("long").alias("low"), most.cast("long").alias("high"))

    all_of = members.withColumn("ranges", F.array(ranges(F.lit(0), F.lit(LEAST), F.lit(MOST))))
    found = materialize(_best(rows, all_of, n, n_crowds, positives, True).select("anchor", F.col("id").alias("positive"), F.col("score").alias("p")))
    least, most = F.expr(f"-((-{low} * p - pmod(-{low} * p, 100)) div 100)"), F.expr(f"({high} * p - pmod({high} * p, 100)) div 100")
    wanted = found.select("anchor", ranges(F.col("positive"), least, most).alias("r")).where("r.low <= r.high").groupBy("anchor").agg(F.collect_list("r").alias("ranges"))
    negatives = _best(rows, members.join(wanted, "anchor"), n, n_crowds, k, False)
    both = negatives.withColumnRenamed("tag", "positive").join(found, ["anchor", "positive"])
    return both.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("p").alias("positive_score"), F.col("score").alias("negative_score"))
