"""Language identification by rank-order profiles of character n-grams.

A profile is the list of a language's most frequent n-grams in rank order. A
document's own ranking is compared with each profile by the out-of-place
distance: the sum of rank differences, with a fixed penalty for an n-gram that
the profile lacks. The nearest profile wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planaudit.llm import textops as tx
from planaudit.llm.common import materialize

PROFILE = 300
LANGUAGES_PER_PASS = 2000
UNDETERMINED = "und"
EDGE = tx.U(1)


@cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _codes(text: str) -> np.ndarray:
    """Lower-cased letters, with one zero before, between and after words."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    codes = np.zeros(len(raw) + 2, np.uint32)
    codes[1:-1] = np.where(_letters()[raw], raw, 0)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] > 0) | (codes[:-1] > 0)
    return codes[keep]


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 1- to 3-grams within words, 21 bits a character, and their counts.

    A word's start and end count as characters of 2- and 3-grams.
    """
    c = _codes(text).astype(np.uint64)
    if len(c) < 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # a word's edge has a code of its own, or n-grams of different length would be one
    marked = np.where(c > 0, c, EDGE)
    two = (marked[:-1] << tx.U(21)) | marked[1:]
    three = (two[:-1] << tx.U(21)) | marked[2:]
    found = np.concatenate([c[c > 0], two[(c[:-1] > 0) | (c[1:] > 0)], three[c[1:-1] > 0]])
    return np.unique(found, return_counts=True)


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram counts per language, summed over each batch of texts."""
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        texts = batch.column(1).to_pylist()
        parts: dict[str, list] = {}
        for lang in set(langs.tolist()):
            rows = np.flatnonzero(langs == lang).tolist()
            low = 0
            while low < len(rows):
                high, size = low, 0
                while high < len(rows) and (high == low or size + len(texts[rows[high]]) < 1_000_000):
                    size += len(texts[rows[high]])
                    high += 1
                parts.setdefault(lang, []).append(ngrams("\n".join(texts[i] for i in rows[low:high])))
                low = high
        for lang, found in parts.items():
            keys, where = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
            counts = np.zeros(len(keys), np.int64)
            np.add.at(counts, where, np.concatenate([n for _, n in found]))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts)], names=["lang", "gram", "n"])


def train_profiles(docs: DataFrame, size: int = PROFILE, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, gram and rank (from 0) of the `size` most frequent n-grams of each language; ties go to the smaller code."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = rows.mapInArrow(_learn, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # a bound on the row number itself lets every task cut its own n-grams of a language before they are gathered
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("place", F.row_number().over(best)).where(F.col("place") <= size)
    return top.select("lang", "gram", (F.col("place") - 1).alias("rank"))


class Profiles:
    """Some languages' profiles by n-gram: for each n-gram in order, the languages that have it and its ranks there."""

    def __init__(self, names: list[str], lang: np.ndarray, gram: np.ndarray, rank: np.ndarray) -> None:
        self.names = names
        order = np.argsort(gram, kind="stable")
        self.grams, first = np.unique(gram[order], return_index=True)
        self.at = np.append(first, len(gram))
        self.lang, self.rank = lang[order].astype(np.int32), rank[order].astype(np.int32)

    def distances(self, keys: np.ndarray, size: int) -> np.ndarray:
        """Out-of-place distance of a document's n-grams in rank order to each language."""
        own = np.minimum(np.searchsorted(self.grams, keys), len(self.grams) - 1)
        known = np.flatnonzero(self.grams[own] == keys)
        begin, count = self.at[own[known]], self.at[own[known] + 1] - self.at[own[known]]
        rows = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        saved = size - np.abs(self.rank[rows] - np.repeat(known, count))
        return len(keys) * size - np.bincount(self.lang[rows], np.maximum(saved, 0), len(self.names)).astype(np.int64)


def _ranked(text: str, size: int) -> np.ndarray:
    """A text's `size` most frequent n-grams in rank order."""
    keys, counts = ngrams(text)
    if len(keys) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        often = counts >= least
        keys, counts = keys[often], counts[often]
    return keys[np.argsort(-counts, kind="stable")][:size]


def _nearer(batches: Iterator[pa.RecordBatch], profiles: Profiles, size: int) -> Iterator[pa.RecordBatch]:
    """lang_pred and far (a share of the largest distance) of (doc_id, text, held_out, lang_pred, far), where these languages are nearer."""
    for batch in batches:
        lang, far = batch.column(3).to_pylist(), batch.column(4).to_pylist()
        for i, text in enumerate(batch.column(1).to_pylist()):
            keys = _ranked(text or "", size)
            if len(keys):
                distance = profiles.distances(keys, size)
                best = int(distance.argmin())
                share = float(distance[best]) / (len(keys) * size)
                if lang[i] == UNDETERMINED or share < far[i]:
                    lang[i], far[i] = profiles.names[best], share
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(lang, pa.string()), pa.array(far, pa.float64())], names=["doc_id", "text", "held_out", "lang_pred", "far"])


def identify_languages(docs: DataFrame, size: int = PROFILE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score (0 to 1, 1 is nearest) for every row.

    Profiles come from text and lang of the rows that are not held out (crc32 of
    the id as text modulo 5 is 0) and have a lang. A null text, or one without
    letters, is `und` with score 0, as is every text if there is nothing to learn
    from. Ties go to the language first in code-point order. Long texts are read
    whole. Rows with a null id are not held out; equal ids come back one by one.
    Other columns are ignored, whatever their names. An empty table gives an empty
    result. The profiles of up to 2000 languages (16 bytes for each n-gram) are sent to
    the tasks at once; the texts are read once for each such part of the languages.
    """
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), held.alias("held_out"))
    profiles = materialize(train_profiles(rows.where("not held_out"), size))
    names = sorted(r.lang for r in profiles.select("lang").distinct().collect())
    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.select("doc_id", "text", "held_out", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(1.0).alias("far"))
    for low in range(0, len(names), LANGUAGES_PER_PASS):
        own = names[low : low + LANGUAGES_PER_PASS]
        found = profiles.where(F.col("lang").between(own[0], own[-1])).toPandas()
        part = Profiles(own, np.searchsorted(np.array(own, object), found["lang"].to_numpy(object)), found["gram"].to_numpy(np.int64).view(np.uint64), found["rank"].to_numpy(np.int64))
        out = (materialize(out) if low else out).mapInArrow(lambda it, part=part: _nearer(it, part, size), f"doc_id {kind}, text string, held_out boolean, lang_pred string, far double")
    return out.select("doc_id", "held_out", "lang_pred", (1.0 - F.col("far")).alias("score"))
