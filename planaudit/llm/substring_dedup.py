"""Exact removal of repeated word windows by prefix-partitioned suffix trees.

The suffixes of all texts, cut at `window` words, are dealt to groups by a prefix
of variable length: the words up to and including the first one that is not
globally frequent (with more than 4096 groups the second, and so on; all `window`
words if there are too few), so a group stays of a size that fits in memory. In a group, suffixes are sorted as the leaves of its
subtree; leaves with an equal path label of `window` words hang below one deep
internal node, and the node's smallest document is the only one that keeps them.

Path labels travel as 64-bit fingerprints, and equal labels meet in the same
prefix group, which adds the group's bits. Suffixes of one batch of documents
travel together: sorted, distinct, delta-packed, with their smallest document in
the batch. A group answers with one bit for each of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planaudit.llm import textops as tx

BATCH_BYTES = 8 << 20
GROUP_SUFFIXES = 3_000_000


def _census(batches: Iterator[pa.RecordBatch], share: int) -> Iterator[pa.RecordBatch]:
    """Bytes and words of the texts, and words that hold 1/share of the words of a slice."""
    for batch in batches:
        data, offsets = tx.buffers(batch.column(0))
        for low, high in tx.slices(offsets, 4 << 20):
            words = tx.Words(data, offsets[low : high + 1])
            values, counts = np.unique(words.hash, return_counts=True)
            often = counts * share >= len(words.hash)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(values[often].view(np.int64), 0)), pa.array(np.append(counts[often], len(words.hash)).astype(np.int64)), pa.array(np.append(np.zeros(int(often.sum()), np.int64), len(words.data)))],
                names=["word", "n", "n_bytes"],
            )


class _Suffixes:
    """Distinct truncated suffixes of one batch of documents, sorted by (group, fingerprint)."""

    def __init__(self, table: pa.Table, window: int, groups: int, frequent: np.ndarray) -> None:
        table = table.sort_by("doc_id")
        self.ids = table.column("doc_id").to_numpy()
        data, offsets = tx.buffers(table.column("text"))
        keys, homes, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        self.parts = []
        for low, high in tx.slices(offsets):
            words = tx.Words(data, offsets[low : high + 1])
            grams = words.grams(window)
            counts = np.diff(words.at)
            starts = np.maximum(counts - window + 1, 0)
            where = np.repeat(words.at[:-1] - np.concatenate([[0], np.cumsum(starts)[:-1]]), starts) + np.arange(starts.sum())
            self.parts.append((low, words, where))
            keys.append(grams[where])
            homes.append(_prefix_group(words.hash, where, window, groups, frequent))
            docs.append(np.repeat(np.arange(low, high, dtype=np.int32), starts))
        self.key, self.home, self.doc = np.concatenate(keys), np.concatenate(homes), np.concatenate(docs)
        # rows are in order of doc_id, and the sort is stable: the first of equal suffixes is of the smallest document
        self.order = np.lexsort((self.key, self.home))
        key, home = self.key[self.order], self.home[self.order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (home[1:] != home[:-1])
        self.first = np.flatnonzero(fresh)
        self.node = np.cumsum(fresh) - 1
        self.keys, self.homes, self.owner = key[fresh], home[fresh], self.doc[self.order][fresh]


def _prefix_group(hashes: np.ndarray, where: np.ndarray, window: int, groups: int, frequent: np.ndarray) -> np.ndarray:
    """Group of each suffix, from the hash of its words up to the infrequent one that makes it rare enough."""
    if not len(hashes):
        return np.zeros(0, np.int32)
    rare = np.ones(len(hashes), bool)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        rare = frequent[at] != hashes
    label = np.zeros(len(where), np.uint64)
    left = np.full(len(where), max(1, -(-(groups - 1).bit_length() // 12)))
    going = np.arange(len(where))
    for i in range(window):
        at = where[going] + i
        label[going] = tx.mix(label[going] * tx.U(0x9E3779B97F4A7C15) + hashes[at])
        left[going] -= rare[at]
        going = going[left[going] > 0]
        if not len(going):
            break
    return ((label >> tx.U(32)) % tx.U(groups)).astype(np.int32)


def _deal(table: pa.Table, window: int, groups: int, frequent: np.ndarray) -> pa.Table:
    """One row for each group that a batch of documents has suffixes of."""
    s = _Suffixes(table, window, groups, frequent)
    batch = table.column("batch")[0].as_py()
    begin = np.flatnonzero(np.concatenate([[True], s.homes[1:] != s.homes[:-1]])) if len(s.homes) else np.zeros(0, np.int64)
    end = np.append(begin[1:], len(s.homes))[: len(begin)]
    rows = [(int(s.homes[a]), batch, tx.pack_sorted(s.keys[a:b]), _owners(s.ids, s.owner[a:b])) for a, b in zip(begin, end, strict=True)]
    return pa.table(
        {"home": pa.array([r[0] for r in rows], pa.int32()), "batch": pa.array([r[1] for r in rows], pa.int64()), "keys": pa.array([r[2] for r in rows], pa.binary()), "owners": pa.array([r[3] for r in rows], pa.binary())}
    )


def _owners(ids: np.ndarray, owner: np.ndarray) -> bytes:
    """The documents of a list of suffixes: their distinct ids, then 16-bit or 32-bit positions among them."""
    used, at = np.unique(owner, return_inverse=True)
    kind = np.uint16 if len(used) < 1 << 16 else np.uint32
    return np.int64(len(used)).tobytes() + ids[used].astype(np.int64).tobytes() + at.astype(kind).tobytes()


def _owner_ids(raw: bytes) -> np.ndarray:
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    kind = np.uint16 if n < 1 << 16 else np.uint32
    return np.frombuffer(raw, np.int64, n, 8)[np.frombuffer(raw, kind, -1, 8 + 8 * n)]


def _subtree(table: pa.Table) -> pa.Table:
    """Of each batch's suffixes in one group, those that a smaller document has as well."""
    batches, packed, owners = (table.column(c).to_pylist() for c in ("batch", "keys", "owners"))
    keys = [tx.unpack_sorted(x) for x in packed]
    docs = np.concatenate([_owner_ids(x) for x in owners])
    leaves = np.concatenate(keys)
    order = np.argsort(leaves, kind="stable")
    ordered = leaves[order]
    begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    least = np.minimum.reduceat(docs[order], begin)
    beaten = np.empty(len(leaves), bool)
    beaten[order] = docs[order] > np.repeat(least, np.diff(np.append(begin, len(ordered))))
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    bits = [np.packbits(x).tobytes() for x in np.split(beaten, cuts)]
    return pa.table({"home": table.column("home"), "batch": pa.array(batches, pa.int64()), "bits": pa.array(bits, pa.binary())})


def _apply(table: pa.Table, answers: pa.Table, window: int, groups: int, frequent: np.ndarray, texts: bool) -> pa.Table:
    """The kept words of each document of a batch."""
    if not table.num_rows:
        return _result([], texts)
    s = _Suffixes(table, window, groups, frequent)
    beaten = np.zeros(len(s.keys), bool)
    for home, bits in zip(answers.column("home").to_pylist(), answers.column("bits").to_pylist(), strict=True):
        a, b = np.searchsorted(s.homes, [home, home + 1])
        beaten[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
    covered = np.zeros(len(s.key), bool)
    covered[s.order] = beaten[s.node] | (s.ids[s.doc[s.order]] > s.ids[s.owner[s.node]])
    rows, done = [], 0
    for low, words, where in s.parts:
        hit = where[covered[done : done + len(where)]]
        done += len(where)
        edge = np.zeros(len(words.hash) + 1, np.int32)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + window, -1)
        gone = np.cumsum(edge[:-1]) > 0
        raw = words.data.tobytes()
        for i, (a, b) in enumerate(zip(words.at[:-1], words.at[1:], strict=True), low):
            left = np.flatnonzero(~gone[a:b]) + a
            kept = b" ".join([raw[x:y] for x, y in zip(words.start[left].tolist(), words.end[left].tolist(), strict=True)])
            rows.append((int(s.ids[i]), int(b - a), int(b - a - len(left)), kept))
    return _result(rows, texts)


def _whole(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    """All words of texts without an id."""
    for batch in batches:
        data, offsets = tx.buffers(batch.column(0))
        for low, high in tx.slices(offsets):
            words = tx.Words(data, offsets[low : high + 1])
            raw = words.data.tobytes()
            spans = [list(zip(words.start[a:b].tolist(), words.end[a:b].tolist(), strict=True)) for a, b in zip(words.at[:-1], words.at[1:], strict=True)]
            yield from _result([(None, len(own), 0, b" ".join([raw[x:y] for x, y in own])) for own in spans], texts).to_batches()


def _result(rows: list, texts: bool) -> pa.Table:
    out = {"doc_id": pa.array([r[0] for r in rows], pa.int64()), "n_words": pa.array([r[1] for r in rows], pa.int64()), "n_removed": pa.array([r[2] for r in rows], pa.int64()), "kept_sha256": pa.array([hashlib.sha256(r[3]).hexdigest() for r in rows], pa.string())}
    if texts:
        out["kept_text"] = pa.array([r[3].decode("utf-8") for r in rows], pa.string())
    return pa.table(out)


def remove_repeats(docs: DataFrame, window: int = 13, texts: bool = False, batch_bytes: int = BATCH_BYTES, group_suffixes: int = GROUP_SUFFIXES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) of every document.

    A word is removed if a window of `window` consecutive words over it also starts
    in a document with a smaller id; windows are judged on the input. Repeats within
    one document stay. A null, empty or short text loses nothing (a null has no
    words). Rows with a null id lose nothing either, and take nothing from others, as
    smaller is undefined for them; rows that share an id count as one document for
    the comparison and come back one by one. Other columns are ignored, whatever their names. An
    empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    nameless, docs = docs.where("doc_id is null").select("text"), docs.where("doc_id is not null")
    share = 256
    census = docs.select("text").mapInArrow(lambda it: _census(it, share), "word long, n long, n_bytes long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_bytes").alias("n_bytes"))
    total = census.where("n_bytes > 0").agg(F.sum("n"), F.sum("n_bytes")).first()
    n_words, n_bytes = (int(x or 0) for x in total)
    groups = max(1, -(-n_words // group_suffixes))
    n_batches = max(1, -(-n_bytes // batch_bytes))
    # at most 16 * share words can hold 1/(16 * share) of all words: a bounded list
    top = census.where(F.col("n_bytes") == 0).where(F.col("n") * 16 * share >= n_words).select("word")
    frequent = np.sort(np.array([r[0] for r in top.collect()], np.int64).view(np.uint64))
    dealt = docs.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(n_batches))).repartition("batch")
    suffixes = dealt.groupBy("batch").applyInArrow(lambda t: _deal(t, window, groups, frequent), "home int, batch long, keys binary, owners binary")
    answers = suffixes.groupBy("home").applyInArrow(_subtree, "home int, batch long, bits binary")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts
    kept = dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(lambda a, b: _apply(a, b, window, groups, frequent, texts), schema)
    return kept.unionByName(nameless.mapInArrow(lambda it: _whole(it, texts), schema))
