"""Benchmark decontamination by a BM25 index of the test items.

Every passage of every training text (128 words, 64 apart, so that any 65 words in
a row lie in one) is a query against an inverted index of the items, cut into
pieces of at most 64 words. A piece is retrieved if the passage's BM25 score
reaches a share of the score that the piece gives itself.

Retrieval follows block-max WAND. Impacts are divided by the piece's own score, so
that one threshold holds for all. A piece can only be reached through its
essential terms (the rarest ones: the others together stay below the threshold),
so passages without any are skipped on list bounds. For the rest, the sum of block
maxima rules out blocks of pieces, and the pieces of the blocks that remain are
scored. Nothing above the threshold is lost.

A retrieved pair is verified on word trigrams of the question and of the answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planaudit.llm import textops as tx
from planaudit.llm.common import without

PIECE, PASSAGE, STRIDE = 64, 128, 64
K1, B = 1.2, 0.75
BLOCK = 8
PIECES_PER_PASS = 100_000
GRAM = 3

_BREAK = np.ones(256, bool)
_BREAK[48:58] = _BREAK[65:91] = _BREAK[97:123] = _BREAK[128:] = False


def plain_words(column: pa.Array, low: int = 0, high: int | None = None) -> tx.Words:
    """Lower-cased words; ASCII characters that are no letters or digits separate them."""
    text = pc.utf8_lower(column.slice(low, None if high is None else high - low).cast(pa.large_string()))
    data, offsets = tx.buffers(text)
    return tx.Words(np.where(_BREAK[data], np.uint8(32), data), offsets)


def _gram_hashes(hashes: np.ndarray) -> np.ndarray:
    """Distinct trigrams of a part, or the part itself if it is shorter."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    return np.unique(tx.sequence_hash(hashes, min(GRAM, len(hashes))))


def split_items(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, question and answer of items that are one text: the answer is the last sentence, if there are several."""
    text = F.trim(F.col(text_col))
    cut = r"(?s)^(.*[.!?])\s+(\S.*)$"
    has = text.rlike(cut)
    return benchmark.select(F.col(item_col).alias("item_id"), F.when(has, F.regexp_extract(text, cut, 1)).otherwise(text).alias("question"), F.when(has, F.regexp_extract(text, cut, 2)).alias("answer"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of items: term hashes, and the trigrams of question and answer in each."""
    for batch in batches:
        rows = []
        question, answer = plain_words(batch.column(1)), plain_words(batch.column(2))
        for i, item in enumerate(batch.column(0).to_pylist()):
            q, a = (w.hash[w.at[i] : w.at[i + 1]] for w in (question, answer))
            words = np.concatenate([q, a])
            count = -(-len(words) // PIECE)
            for k in range(count):
                low, high = k * PIECE, min((k + 1) * PIECE, len(words))
                qg, ag = _gram_hashes(q[low:high]), _gram_hashes(words[max(low, len(q)) : high])
                rows.append((item, k, *(x.view(np.int64).tolist() for x in (words[low:high], qg, ag))))
        if rows:
            item, piece, terms, qg, ag = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.list_(pa.int64())) for x in (terms, qg, ag))], names=["item_id", "piece", "terms", "qg", "ag"])


class Index:
    """Inverted lists of pieces with their block maxima, with impacts relative to each piece's own score."""

    def __init__(self, rows: list, idf: dict[int, float], mean: float, threshold: float) -> None:
        self.threshold = threshold
        self.items = [(r["item_id"], r["piece"]) for r in rows]
        self.grams = [(np.array(r["qg"], np.int64).view(np.uint64), np.array(r["ag"], np.int64).view(np.uint64)) for r in rows]
        self.terms = np.unique(np.concatenate([np.array(r["terms"], np.int64) for r in rows]).view(np.uint64))
        of, piece, impact, essential = [], [], [], np.zeros(len(self.terms), bool)
        for number, r in enumerate(rows):
            values, tf = np.unique(np.array(r["terms"], np.int64).view(np.uint64), return_counts=True)
            at = np.searchsorted(self.terms, values)
            weight = np.array([idf[int(v)] for v in values.view(np.int64)]) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(r["terms"]) / mean))
            weight /= weight.sum()
            order = np.argsort(-weight, kind="stable")
            # without its heaviest terms a piece stays below the threshold
            rest = 1.0 - np.cumsum(weight[order])
            essential[at[order[: int(np.argmax(rest < threshold - 1e-9)) + 1]]] = True
            of.append(at)
            piece.append(np.full(len(at), number))
            impact.append(weight)
        self.essential = essential
        term, self.piece, self.impact = np.concatenate(of), np.concatenate(piece), np.concatenate(impact)
        order = np.lexsort((self.piece, term))
        term, self.piece, self.impact = term[order], self.piece[order], self.impact[order]
        self.at = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.list_max = np.maximum.reduceat(self.impact, self.at[:-1])
        # the largest impact of each list in each block of pieces that it touches
        block = self.piece // BLOCK
        begin = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])]))
        self.blocks = -(-len(rows) // BLOCK)
        self.block, self.block_max = block[begin], np.maximum.reduceat(self.impact, begin)
        self.block_at = np.searchsorted(term[begin], np.arange(len(self.terms) + 1))

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def _lists(self, at: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Places of the entries of some lists, one list after the other."""
        sizes = at[terms + 1] - at[terms]
        return np.repeat(at[terms] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())

    def search(self, terms: np.ndarray) -> list[tuple[int, float]]:
        """Pieces at or above the threshold for the distinct terms of a passage."""
        if self.list_max[terms].sum() < self.threshold - 1e-6:
            return []
        upper = self._lists(self.block_at, terms)
        alive = np.bincount(self.block[upper], self.block_max[upper], self.blocks) >= self.threshold - 1e-6
        if not alive.any():
            return []
        entries = self._lists(self.at, terms)
        entries = entries[alive[self.piece[entries] // BLOCK]]
        found, where = np.unique(self.piece[entries], return_inverse=True)
        score = np.bincount(where, self.impact[entries])
        return [(int(found[i]), float(score[i])) for i in np.flatnonzero(score >= self.threshold - 1e-9)]


def _retrieve(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    index: Index = shared.value
    for batch in batches:
        text = batch.column(1).cast(pa.large_string())
        ids = batch.column(0).to_pylist()
        _, offsets = tx.buffers(text)
        rows = []
        for low, high in tx.slices(offsets):
            words = plain_words(text, low, high)
            term = index.look_up(words.hash)
            hit = np.flatnonzero((term >= 0) & index.essential[term])
            doc = np.searchsorted(words.at, hit, "right") - 1
            first = words.at[doc]
            # the passages that hold the hit: number p covers words p * STRIDE to p * STRIDE + PASSAGE of its text
            last = (hit - first) // STRIDE
            width = int(last.max()) + 1 if len(hit) else 1
            passages = np.unique(np.concatenate([doc * width + last, doc * width + np.maximum(last - 1, 0)]))
            doc, number = passages // width, passages % width
            begin = words.at[doc] + number * STRIDE
            end = np.minimum(begin + PASSAGE, words.at[doc + 1])
            # list bounds, with repeated words counted each time, rule most passages out at once
            ahead = np.concatenate([[0.0], np.cumsum(np.where(term >= 0, index.list_max[term], 0.0))])
            likely = ahead[end] - ahead[begin] >= index.threshold - 1e-6
            for d, a, b in zip(doc[likely].tolist(), begin[likely].tolist(), end[likely].tolist(), strict=True):
                own = np.unique(term[a:b])
                own = own[own >= 0]
                if not len(own):
                    continue
                found = index.search(own)
                if found:
                    grams = np.concatenate([tx.sequence_hash(words.hash[a:b], m) for m in range(1, min(GRAM, b - a) + 1)])
                    for piece, score in found:
                        q, g = index.grams[piece]
                        rows.append((ids[low + d], *index.items[piece], score, int(np.isin(q, grams).sum()), int(np.isin(g, grams).sum())))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], schema=pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("piece", pa.int32()), ("score", pa.float64()), ("q_hits", pa.int64()), ("a_hits", pa.int64())]))


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.6, overlap: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, score, question_overlap and answer_overlap of every training document that holds a test item.

    items(item_id, question, answer). A piece of an item is retrieved from
    `threshold` of its own BM25 score on; the pair is returned if at least `overlap`
    of the item's question trigrams and of its answer trigrams (if it has one) are
    in the retrieved passages. Parts of one or two words count as one gram.

    Null or empty texts and items match nothing; so do rows with a null id. Long
    texts are read whole, in passages; long items piece by piece. An item given
    twice, or two equal items, are each reported; documents with equal ids are
    reported once, with their best overlap. Other columns are ignored, whatever
    their names. Empty tables give an empty result. The index of at most 100000
    pieces (6.4 million words) is broadcast; the texts are read once for each such
    part of the benchmark.
    """
    schema = "doc_id long, item_id long, piece int, score double, q_hits long, a_hits long"
    known = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("question", F.lit("")).alias("question"), F.coalesce("answer", F.lit("")).alias("answer"))
    pieces = known.mapInArrow(_pieces, "item_id long, piece int, terms array<long>, qg array<long>, ag array<long>")
    stats = pieces.agg(F.count("*"), F.avg(F.size("terms"))).first()
    count, mean = int(stats[0]), float(stats[1] or 1.0)
    parts = -(-count // PIECES_PER_PASS)
    idf = pieces.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = idf.select("term", F.log(1 + (count - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    texts = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    numbered = pieces.withColumn("part", F.pmod(F.xxhash64("item_id", "piece"), F.lit(max(parts, 1))))
    found = docs.sparkSession.createDataFrame([], schema)
    for part in range(parts):
        own = numbered.where(F.col("part") == part)
        rows = own.orderBy("item_id", "piece").collect()
        if not rows:
            continue
        terms = own.select(F.explode("terms").alias("term")).distinct()
        index = Index(rows, {r["term"]: r["idf"] for r in idf.join(terms, "term", "left_semi").collect()}, mean, threshold)
        shared = docs.sparkSession.sparkContext.broadcast(index)
        found = found.unionByName(texts.mapInArrow(lambda it, shared=shared: _retrieve(it, shared), schema))
    sizes = pieces.groupBy("item_id").agg(F.sum(F.size("qg")).alias("nq"), F.sum(F.size("ag")).alias("na"))
    best = found.groupBy("doc_id", "item_id", "piece").agg(F.max("score").alias("score"), F.max("q_hits").alias("q"), F.max("a_hits").alias("a"))
    total = best.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.sum("q").alias("q"), F.sum("a").alias("a")).join(sizes, "item_id")
    share = [F.when(F.col(n) > 0, F.col(h) / F.col(n)).otherwise(1.0) for h, n in (("q", "nq"), ("a", "na"))]
    return total.select("doc_id", "item_id", "score", share[0].alias("question_overlap"), share[1].alias("answer_overlap")).where((F.col("question_overlap") >= overlap) & (F.col("answer_overlap") >= overlap))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options: object) -> DataFrame:
    """docs without those that hold a test item; rows with a null id stay."""
    return without(docs, contaminated(docs, items, id_col=id_col, **options), id_col)
