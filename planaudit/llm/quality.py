"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

The model is one of whole characters (any code point; digits and blanks are folded
into one each), of order 4. Counts of n-grams come from all trusted text but a
quarter; they are summed and joined with the sums of their contexts and with the
probabilities of the next lower order, one order after the other. What they give
is a table of n-grams with log-probabilities and back-off weights. It grows with
the trusted text and is held by nobody as a whole.

Documents are scored by joins with it. Texts are packed into slices; each slice asks
the shards of the table for its distinct n-grams, once each. A shard of the table
meets the questions of a chunk of slices at a time, so that neither the questions
nor the table must fit in one task. The answers go back to their slice, where the
sum over the characters of each document gives its perplexity.

A document's perplexity is compared with quantiles of the trusted documents of its
own language that did not train the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planaudit.llm import textops as tx
from planaudit.llm.common import join_hot, materialize

ORDER = 4
START = "\x02"
SLICE, PART = 16 << 20, 1 << 19
#: Keys that wait to be made distinct.
WAITING = 2_000_000
CHUNK = 64
SHARD_GRAMS = 1_000_000
FLUSH_GRAMS = 1_000_000
MAX_BROADCAST_IDS = 4_000_000
LEAST_TRUSTED = 30
SHORT = 200.0
OTHER, TRAINS, HELD_OUT = 0, 1, 2
PACKED = "slice long, ids array<{kind}>, langs array<string>, parts array<int>, sizes array<int>, texts binary"
_STEP = tx.U(0x9E3779B97F4A7C15)


@cache
def _fold() -> np.ndarray:
    """Code point -> code point with digits and blanks folded, and the start symbol out of the way."""
    table = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isdigit():
            table[i] = ord("0")
        elif c.isspace():
            table[i] = ord("\n") if c == "\n" else ord(" ")
    table[ord(START)] = 0x1A
    return table


def _points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of texts with ORDER - 1 start symbols before each, and the place of each text's first character."""
    own = data[offsets[0] : offsets[-1]]
    ahead = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])[offsets - offsets[0]]
    points = _fold()[np.frombuffer(own.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)]
    pad = ORDER - 1
    codes = np.full(len(points) + pad * (len(ahead) - 1), ord(START), np.uint32)
    codes[np.arange(len(points)) + pad * np.repeat(np.arange(1, len(ahead)), np.diff(ahead))] = points
    return codes, ahead + pad * np.arange(len(ahead))


def _key(codes: np.ndarray) -> np.ndarray:
    """64-bit key of each row of code points."""
    key = np.full(len(codes), tx.U(codes.shape[1]), np.uint64)
    for column in codes.T:
        key = tx.mix(key * _STEP + column)
    return key


class _Grams:
    """The distinct n-grams of order ORDER that end at the characters of some texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        codes, at = _points(data, offsets)
        pad = ORDER - 1
        # characters stand behind the start symbols of their text
        here = np.ones(len(codes), bool)
        for k in range(pad):
            here[at[:-1] + k] = False
        self.place = np.flatnonzero(here)
        key = np.zeros(len(self.place), np.uint64)
        wide = codes.astype(np.uint64)
        for back in range(pad, -1, -1):
            key = key * _STEP + wide[self.place - back]
        self.which, distinct = pd.factorize(key)
        first = np.full(len(distinct), len(key), np.int64)
        np.minimum.at(first, self.which[::-1], np.arange(len(key))[::-1])
        self.codes = codes[self.place[first][:, None] + np.arange(-pad, 1)] if len(first) else np.zeros((0, ORDER), np.uint32)
        self.ends = np.searchsorted(self.place, at[1:])

    def counts(self) -> np.ndarray:
        return np.bincount(self.which, minlength=len(self.codes))

    def keys(self) -> dict[tuple[int, int], np.ndarray]:
        """(first, last) -> key of these characters of each n-gram, for all that a back-off may need."""
        return {(a, b): _key(self.codes[:, a:b]) for b in (ORDER - 1, ORDER) for a in range(b)}


def _texts(codes: np.ndarray) -> list[str]:
    """Rows of code points as strings."""
    width = codes.shape[1]
    joined = codes.astype("<u4").tobytes().decode("utf-32-le")
    return [joined[i : i + width] for i in range(0, len(joined), width)]


def _parts(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    return tx.slices(offsets, PART)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of (id, lang, part, text), their texts compressed."""
    press = zstandard.ZstdCompressor(6)
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        data, offsets = tx.buffers(batch.column(3))
        for low, high in tx.slices(offsets, SLICE):
            sizes = pa.array(np.diff(offsets[low : high + 1]).astype(np.int32))
            bounds = pa.array([0, high - low], pa.int32())
            lists = [pa.ListArray.from_arrays(bounds, x) for x in (*(batch.column(i).slice(low, high - low) for i in range(3)), sizes)]
            text = press.compress(data[offsets[low] : offsets[high]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists, pa.array([text], pa.binary())], names=[x.split()[0] for x in PACKED.split(", ")])
            number += 1


def _unpack(texts: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(texts, max_output_size=max(1, int(offsets[-1]))), np.uint8), offsets


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the n-grams of the texts that train, summed over many texts."""
    held: dict[str, int] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["gram", "n"])

    for batch in batches:
        for texts, sizes, parts in zip(batch.column("texts").to_pylist(), batch.column("sizes"), batch.column("parts"), strict=True):
            data, offsets = _unpack(texts, sizes.values.to_numpy())
            wanted = np.flatnonzero(parts.values.to_numpy(zero_copy_only=False) == TRAINS)
            if not len(wanted):
                continue
            spans = [data[offsets[i] : offsets[i + 1]] for i in wanted.tolist()]
            data, offsets = np.concatenate(spans), np.concatenate([[0], np.cumsum([len(x) for x in spans])])
            for low, high in _parts(offsets):
                grams = _Grams(data, offsets[low : high + 1])
                for gram, n in zip(_texts(grams.codes), grams.counts().tolist(), strict=True):
                    held[gram] = held.get(gram, 0) + n
                if len(held) > FLUSH_GRAMS:
                    yield out()
                    held.clear()
    yield out()


def _discounts(counts: DataFrame) -> tuple[list[float], float, int]:
    """D1, D2 and D3+ from the counts of counts, the sum of all counts and their number."""
    *often, total, rows = counts.agg(*[F.count_if(F.col("n") == i) for i in (1, 2, 3, 4)], F.sum("n"), F.count("*")).first()
    n1, n2, n3, n4 = (float(x or 0) for x in often)
    if not n1 or not n2 or not n3:
        return [0.5, 0.75, 0.9], float(total or 0), int(rows)
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.05), i - 0.05) for i, d in enumerate(raw, 1)], float(total or 0), int(rows)


def train(packed: DataFrame) -> tuple[DataFrame, float]:
    """gram, log_p and log_back of all n-grams up to ORDER of the texts that train; and the log-probability of a character never seen.

    log_p is null for a mere context of start symbols, log_back for what is no
    context. The probabilities behind any context, with one unseen character, sum
    to one. No text gives an empty table and a log-probability of 0.
    """
    counts = materialize(packed.mapInArrow(_count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    levels = [counts]
    for k in range(ORDER - 1, 0, -1):
        # a lower order counts the distinct characters before it
        levels.append(materialize(levels[-1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n"))))
    found, lower, unseen = [], None, 0.0
    for k, level in enumerate(reversed(levels), 1):
        (d1, d2, d3), total, rows = _discounts(level)
        less = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        if lower is None:
            # (rows + 1) characters share what the discounts leave
            spared = level.agg(F.sum(less)).first()[0] or 0.0
            unseen = spared / total / (rows + 1) if total else 1.0
            lower = level.select("gram", ((F.col("n") - less) / max(total, 1.0) + unseen).alias("p"))
            found.append(lower.select("gram", F.log("p").alias("log_p"), F.lit(None).cast("double").alias("log_back")))
            continue
        # the rows of one context are at most as many as there are characters
        context = Window.partitionBy("context")
        split = level.select("gram", "n", F.substring("gram", 1, k - 1).alias("context"), less.alias("less"))
        split = split.withColumn("total", F.sum("n").over(context)).withColumn("back", F.sum("less").over(context) / F.col("total"))
        below = lower.select(F.col("gram").alias("suffix"), F.col("p").alias("lower"))
        joined = split.withColumn("suffix", F.substring("gram", 2, k - 1)).join(below, "suffix")
        lower = materialize(joined.select("gram", "context", "back", ((F.col("n") - F.col("less")) / F.col("total") + F.col("back") * F.col("lower")).alias("p")))
        found.append(lower.select("gram", F.log("p").alias("log_p"), F.lit(None).cast("double").alias("log_back")))
        found.append(lower.groupBy(F.col("context").alias("gram")).agg(F.log(F.max("back")).alias("log_back")).select("gram", F.lit(None).cast("double").alias("log_p"), "log_back"))
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("gram").agg(F.max("log_p").alias("log_p"), F.max("log_back").alias("log_back")), float(np.log(unseen))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys in place of the n-grams' texts."""
    for batch in batches:
        grams = batch.column(0).to_pylist()
        width = np.array([len(x) for x in grams])
        key = np.zeros(len(grams), np.uint64)
        for k in np.unique(width).tolist():
            own = np.flatnonzero(width == k)
            key[own] = _key(np.frombuffer("".join(grams[i] for i in own.tolist()).encode("utf-32-le"), np.uint32).reshape(-1, k))
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *(batch.column(i).cast(pa.float32()) for i in (1, 2))], names=["key", "log_p", "log_back"])


def _ask(batches: Iterator[pa.RecordBatch], shards: int, chunks: int) -> Iterator[pa.RecordBatch]:
    """The distinct keys of each slice, by shard."""
    for batch in batches:
        for number, texts, sizes in zip(batch.column("slice").to_pylist(), batch.column("texts").to_pylist(), batch.column("sizes"), strict=True):
            data, offsets = _unpack(texts, sizes.values.to_numpy())
            parts = [np.zeros(0, np.uint64)]
            for low, high in _parts(offsets):
                parts += [np.unique(x) for x in _Grams(data, offsets[low : high + 1]).keys().values()]
                if sum(map(len, parts)) > WAITING:
                    parts = [np.unique(np.concatenate(parts))]
            keys = np.unique(np.concatenate(parts))
            home = keys.view(np.int64) % shards
            rows = [(int(h), tx.pack_sorted(keys[home == h])) for h in np.unique(home)]
            yield pa.RecordBatch.from_arrays([pa.array([chunk_of(number, chunks)] * len(rows), pa.int32()), pa.array([h for h, _ in rows], pa.int32()), pa.array([number] * len(rows), pa.int64()), pa.array([x for _, x in rows], pa.binary())], names=["chunk", "shard", "slice", "keys"])


def chunk_of(number: int, chunks: int) -> int:
    return int(tx.mix(np.array([number], np.uint64))[0] % tx.U(chunks))


def _answer(asked: pa.Table, known: pa.Table) -> pa.Table:
    """Of each question the keys that the shard knows, with what it knows."""
    known = known.sort_by("key")
    key = known.column("key").to_numpy()
    values = [known.column(c).fill_null(np.nan).to_numpy() for c in ("log_p", "log_back")]
    out = []
    for number, packed in zip(asked.column("slice").to_pylist(), asked.column("keys").to_pylist(), strict=True):
        keys = tx.unpack_sorted(packed)
        wanted = keys.view(np.int64)
        at = np.minimum(np.searchsorted(key, wanted), max(len(key) - 1, 0))
        there = key[at] == wanted if len(key) else np.zeros(len(wanted), bool)
        out.append((number, tx.pack_sorted(keys[there]), *(v[at[there]].tobytes() for v in values)))
    columns = list(zip(*out, strict=True)) or [()] * 4
    return pa.table({n: pa.array(c, pa.int64() if n == "slice" else pa.binary()) for n, c in zip(("slice", "keys", "log_p", "log_back"), columns, strict=True)})


def _score(packed: pa.Table, answers: pa.Table, unseen: float) -> pa.Table:
    """Characters and perplexity of each document of a slice."""
    keys = np.concatenate([np.zeros(0, np.uint64), *(tx.unpack_sorted(x) for x in answers.column("keys").to_pylist())])
    order = np.argsort(keys)
    keys = keys[order]
    log_p, log_back = (np.frombuffer(b"".join(answers.column(c).to_pylist()), np.float32)[order] for c in ("log_p", "log_back"))

    def look_up(wanted: np.ndarray, values: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.full(len(wanted), np.nan, np.float32)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], np.nan)

    columns: list[list] = [[] for _ in range(5)]
    for row in packed.to_batches():
        for i in range(row.num_rows):
            ids, langs, parts, sizes = (row.column(c)[i].values for c in ("ids", "langs", "parts", "sizes"))
            data, offsets = _unpack(row.column("texts")[i].as_py(), sizes.to_numpy())
            sums, lengths = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
            for low, high in _parts(offsets):
                grams = _Grams(data, offsets[low : high + 1])
                key = grams.keys()
                value = np.full(len(grams.codes), unseen)
                for first in range(ORDER - 1, -1, -1):
                    # the longer n-gram's own value, else the weight of its context and the shorter one's
                    back = np.nan_to_num(look_up(key[first, ORDER - 1], log_back), nan=0.0) if first < ORDER - 1 else 0.0
                    own = look_up(key[first, ORDER], log_p)
                    value = np.where(np.isnan(own), value + back, own)
                ahead = np.concatenate([[0.0], np.cumsum(value[grams.which])])
                ends = np.concatenate([[0], grams.ends])
                sums[low:high] = np.diff(ahead[ends])
                lengths[low:high] = np.diff(ends)
            perplexity = np.exp(-sums / np.maximum(lengths, 1))
            for column, x in zip(columns, (ids, langs, parts, pa.array(lengths), pa.array(perplexity, mask=lengths == 0)), strict=True):
                column.append(x)
    kinds = (packed.schema.field("ids").type.value_type, pa.string(), pa.int32(), pa.int64(), pa.float64())
    return pa.table({n: pa.chunked_array(x, k) for n, x, k in zip(("doc_id", "lang", "part", "n_chars", "perplexity"), columns, kinds, strict=True)})


def pack(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """docs in slices, as a written table. A quarter of the trusted documents is marked as held out, the others train."""
    ids = trusted.where("doc_id is not null").select(F.col("doc_id").alias("_id")).distinct()
    small = ids.count() <= MAX_BROADCAST_IDS
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    part = F.when(F.col("_id").isNull(), OTHER).when(F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(4)) == 0, HELD_OUT).otherwise(TRAINS)
    marked = rows.join(F.broadcast(ids) if small else ids, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "lang", part.alias("part"), "text")
    return materialize(marked.mapInArrow(_pack, PACKED.format(kind=docs.schema[id_col].dataType.simpleString())))


def score(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang, part, n_chars and perplexity (null for a null or empty text) of every row, as a written table."""
    packed = pack(docs, trusted, id_col, text_col, lang_col)
    model, unseen = train(packed)
    known = materialize(model.mapInArrow(_keyed, "key long, log_p float, log_back float"))
    shards = max(1, -(-known.count() // SHARD_GRAMS))
    chunks = max(1, -(-packed.count() // CHUNK))
    asked = packed.select("slice", "sizes", "texts").mapInArrow(lambda it: _ask(it, shards, chunks), "chunk int, shard int, slice long, keys binary")
    offered = known.select(F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.pmod("key", F.lit(shards)).cast("int").alias("shard"), "key", "log_p", "log_back")
    answers = asked.groupBy("chunk", "shard").cogroup(offered.groupBy("chunk", "shard")).applyInArrow(_answer, "slice long, keys binary, log_p binary, log_back binary")
    kind = docs.schema[id_col].dataType.simpleString()
    scored = packed.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(lambda a, b: _score(a, b, unseen), f"doc_id {kind}, lang string, part int, n_chars long, perplexity double")
    return materialize(scored)


def limits(scored: DataFrame, middle: float = 0.5, high: float = 0.95, margin: float = 3.0) -> DataFrame:
    """lang, middle, below and above from quantiles of the held-out trusted documents of each language; the row with a null lang is for all others.

    A perplexity may lie `above` = margin * (Q(high) - Q(middle)) over the middle, or
    `below` = margin * (Q(middle) - Q(1 - high)) under it. A language with under 30
    held-out documents gets the pooled row.
    """
    own = scored.where(f"part = {HELD_OUT} and perplexity is not null")
    cut = F.percentile_approx("perplexity", F.array(F.lit(1 - high), F.lit(middle), F.lit(high)), F.lit(10000)).alias("q")
    by = own.where("lang is not null").groupBy("lang").agg(cut, F.count("*").alias("n")).where(F.col("n") >= LEAST_TRUSTED).select("lang", "q")
    rows = by.unionByName(own.agg(cut).select(F.lit(None).cast("string").alias("lang"), "q"))
    q = [F.element_at("q", i) for i in (1, 2, 3)]
    return rows.select("lang", q[1].alias("middle"), (margin * (q[1] - q[0])).alias("below"), (margin * (q[2] - q[1])).alias("above"))


def classify(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang, perplexity and keep for every row.

    trusted(doc_id) names the documents that train the model, but for a quarter of
    them, by hashed id, that set the limits. A document is kept if its perplexity
    lies between the limits of its language (those of all languages together if it
    has none, or one with too few held-out documents), widened by 1 + 200 /
    characters, as short texts vary more. A null or empty text has no perplexity
    and is not kept. With no held-out text there is no limit and every text is
    kept. Rows with equal or null ids are judged one by one. Long texts are scored
    whole. Other columns are ignored, whatever their names. An empty table gives an
    empty result.
    """
    scored = score(docs, trusted, id_col, text_col, lang_col)
    bounds = materialize(limits(scored))
    pooled = bounds.where("lang is null").select("middle", "below", "above").first()
    if pooled is None or pooled[0] is None:
        return scored.select("doc_id", "lang", "perplexity", F.col("perplexity").isNotNull().alias("keep"))
    both = join_hot(scored, bounds.where("lang is not null"), ["lang"])
    middle, below, above = (F.coalesce(F.col(c), F.lit(float(pooled[c]))) for c in ("middle", "below", "above"))
    wide = 1 + SHORT / F.greatest("n_chars", F.lit(1))
    inside = F.coalesce(F.col("perplexity").between(middle - wide * below, middle + wide * above), F.lit(False))
    return both.select("doc_id", "lang", "perplexity", inside.alias("keep"))
