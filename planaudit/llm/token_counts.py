"""Token counts of whole texts without materialising ids.

A text is cut into pre-tokens (a run of spaces with the run of other characters
after it). No piece of the vocabulary holds a space after another character, so
no merge crosses a cut and a text's pieces are the sum over its pre-tokens. Every
slice of documents sends each of its distinct pre-tokens once to the shard of its
hash, with the frequencies per document; a shard counts the pieces of each
distinct pre-token once, joins them to the frequencies and sums, one row for each
slice; the sums of a slice's shards are added up.

Slices share shards in chunks of about CHUNK_BYTES of text, so a slice never has
more than CHUNK_BYTES / SHARD_BYTES rows, however large the table; a pre-token is
counted once in each chunk. One that many documents of a slice have is counted by
the slice itself, so no shard gets an entry for every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planaudit.llm import textops as tx

SLICE = 3 << 20
SHARD_BYTES = 24 << 20
CHUNK_BYTES = 1 << 30
COMMON = 64
#: Stands for a first pre-token that is one space alone: the library gives it one piece.
LONE = b"\x00 "
SCHEMA = "home long, slice long, rows binary, doc binary, piece binary, times binary, text binary, size binary, ids binary, known binary"


@cache
def processor(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


def check_vocabulary(path: str) -> None:
    """Refuse a model whose pieces may cross a cut, or that rewrites texts."""
    sp = processor(path)
    if any("▁" in sp.id_to_piece(i).lstrip("▁") for i in range(sp.vocab_size())):
        raise ValueError("the model has pieces with a space after another character")
    if sp.encode("a  b ", out_type=str).count("▁") != 2:
        raise ValueError("the model rewrites runs of spaces")


def _small(values: np.ndarray) -> bytes:
    """Non-negative integers in the narrowest type, behind its width."""
    top = int(values.max()) if len(values) else 0
    kind = np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64
    return bytes([np.dtype(kind).itemsize]) + values.astype(kind).tobytes()


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[raw[0]], -1, 1).astype(np.int64)


def _spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of the pre-tokens, and the first one of each text. The bytes begin at offsets[0]."""
    edges = offsets - offsets[0]
    space = data == 0x20
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    begins[edges[:-1][edges[:-1] < len(data)]] = True
    start = np.flatnonzero(begins)
    return start, np.append(start[1:], len(data))[: len(start)], np.searchsorted(start, edges)


def _pieces(sp: sentencepiece.SentencePieceProcessor, texts: list[bytes]) -> list[int]:
    return list(map(len, sp.encode([t.decode("utf-8") for t in texts], num_threads=1)))


def _pre_tokens(raw: bytes, start: np.ndarray, end: np.ndarray, head: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Texts of the pre-tokens at these places, without the space that the library adds by itself."""
    return [raw[start[j] + (0 if head[j] else 1) : end[j]] or LONE for j in at.tolist()]


def _deal(batches: Iterator[pa.RecordBatch], path: str, shards: int, chunks: int) -> Iterator[pa.RecordBatch]:
    sp = processor(path)
    common: dict[bytes, int] = {LONE: 1}
    for batch in batches:
        spaced = pc.replace_substring(batch.column(1).cast(pa.large_string()), "▁", " ")
        data, offsets = tx.buffers(spaced)
        rows_of = batch.column(0).to_numpy(zero_copy_only=False)
        known = pc.is_valid(batch.column(2)).to_numpy(zero_copy_only=False)
        ids = batch.column(2).fill_null(0).to_numpy(zero_copy_only=False)
        _, shown = tx.buffers(batch.column(1))
        for low, high in tx.slices(offsets, SLICE):
            # the rows themselves, so that those without a token are counted too
            each = rows_of[low:high].astype(np.int64)
            sizes = np.diff(shown[low : high + 1])
            empty = b"\x01"
            first_home = int(tx.mix(each[:1].view(np.uint64))[0] % tx.U(chunks)) * shards
            sums_here = np.zeros(high - low, np.int64)
            out: list[tuple] = []
            own = data[offsets[low] : offsets[high]]
            start, end, at = _spans(own, offsets[low : high + 1])
            kept = (_small(sizes), ids[low:high].astype(np.int64).tobytes(), known[low:high].tobytes())
            if not len(start):
                yield _rows([(first_home + int(each[0]) % shards, int(each[0]), each.tobytes(), _small(sums_here), empty, empty, b"", *kept)])
                continue
            up, down = tx.powers(len(own) + 1)
            sums = np.zeros(len(own) + 1, np.uint64)
            np.cumsum(tx._BYTES[own] * up[: len(own)], out=sums[1:])
            # the first pre-token of a text has a space more than the text shows
            head = np.zeros(len(start), np.uint64)
            filled = np.diff(at) > 0
            head[at[:-1][filled]] = 1
            value = tx.mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) + head * tx.U(0x632BE59BD9B4E019))
            keys, first, which = np.unique(value, return_index=True, return_inverse=True)
            doc = np.repeat(np.arange(high - low), np.diff(at))
            pairs, times = np.unique(doc * len(keys) + which, return_counts=True)
            doc, which = pairs // len(keys), pairs % len(keys)
            raw = own.tobytes()
            often = np.bincount(which, minlength=len(keys)) >= COMMON
            if often.any():
                texts = _pre_tokens(raw, start, end, head, first[often])
                fresh = [t for t in texts if t not in common]
                common.update(zip(fresh, _pieces(sp, fresh), strict=True))
                pieces = np.zeros(len(keys), np.int64)
                pieces[often] = [common[t] for t in texts]
                np.add.at(sums_here, doc, pieces[which] * times)
                if len(common) > 200_000:
                    common = {LONE: 1}
                rare = ~often[which]
                doc, which, times = doc[rare], which[rare], times[rare]
            home = ((keys >> tx.U(33)) % tx.U(shards)).astype(np.int64)
            place = np.zeros(len(keys), np.int64)
            order = np.argsort(home[which], kind="stable")
            cuts = np.searchsorted(home[which][order], np.arange(shards + 1))
            by_home = np.flatnonzero(~often)
            by_home = by_home[np.argsort(home[by_home], kind="stable")]
            key_cuts = np.searchsorted(home[by_home], np.arange(shards + 1))
            for h in np.unique(home[by_home]).tolist():
                mine = by_home[key_cuts[h] : key_cuts[h + 1]]
                place[mine] = np.arange(len(mine))
                sel = order[cuts[h] : cuts[h + 1]]
                rows, at_row = np.unique(doc[sel], return_inverse=True)
                texts = _pre_tokens(raw, start, end, head, first[mine])
                out.append((first_home + h, int(each[0]), _small(rows), _small(at_row), _small(place[which[sel]]), _small(times[sel]), b"".join(texts), _small(np.array([len(t) for t in texts])), None, None))
            yield _rows([(first_home + int(each[0]) % shards, int(each[0]), each.tobytes(), _small(sums_here), empty, empty, b"", *kept), *out])


def _rows(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True))
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[2:])], names=names)


def _count(table: pa.Table, path: str) -> pa.Table:
    """Pieces of each distinct pre-token of a shard, summed per document: one row for each slice."""
    sp = processor(path)
    known: dict[bytes, int] = {LONE: 1}
    out = []
    for x in table.to_pylist():
        if x["ids"] is not None:
            out.append((x["slice"], None, x["doc"], x["ids"], x["known"], x["size"]))
            continue
        ends = np.cumsum(_wide(x["size"])).tolist()
        texts = [x["text"][a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        fresh = [t for t in texts if t not in known]
        for low in range(0, len(fresh), 20_000):
            part = fresh[low : low + 20_000]
            known.update(zip(part, _pieces(sp, part), strict=True))
        pieces = np.array([known[t] for t in texts], np.int64)
        total = np.zeros(len(_wide(x["rows"])), np.int64)
        np.add.at(total, _wide(x["doc"]), pieces[_wide(x["piece"])] * _wide(x["times"]))
        out.append((x["slice"], x["rows"], _small(total), None, None, None))
    columns = list(zip(*out, strict=True))
    return pa.table({n: pa.array(c, pa.int64() if n == "slice" else pa.binary()) for n, c in zip(("slice", "at", "n", "ids", "known", "size"), columns, strict=True)})


def _sum(table: pa.Table) -> pa.Table:
    """The documents of one slice with the sums of all shards."""
    parts = table.to_pylist()
    base = next(x for x in parts if x["ids"] is not None)
    ids = np.frombuffer(base["ids"], np.int64)
    total = _wide(base["n"]).copy()
    for x in parts:
        if x["ids"] is None:
            total[_wide(x["at"])] += _wide(x["n"])
    return pa.table({"doc_id": pa.array(ids, mask=~np.frombuffer(base["known"], bool)), "n_bytes": pa.array(_wide(base["size"])), "n_tokens": pa.array(total)})


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) for every row.

    Counts are those of the model's library for whole texts, with no begin or end
    marks; marks written in a text are ordinary text. Null and empty texts have no
    bytes and no tokens. Long texts are counted whole. Rows with equal or null ids
    are counted and returned one by one. Other columns are ignored, whatever their
    names. An empty table gives an empty result.
    """
    check_vocabulary(model)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n_bytes = int(docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0)
    chunks = max(1, -(-n_bytes // CHUNK_BYTES))
    shards = max(1, -(-n_bytes // (chunks * SHARD_BYTES)))
    marked = docs.select(F.monotonically_increasing_id().alias("row"), "text", F.col("doc_id").cast("long").alias("doc_id"))
    shared = marked.mapInArrow(lambda it: _deal(it, model, shards, chunks), SCHEMA).groupBy("home").applyInArrow(lambda t: _count(t, model), "slice long, at binary, n binary, ids binary, known binary, size binary")
    done = shared.groupBy("slice").applyInArrow(_sum, "doc_id long, n_bytes long, n_tokens long")
    return done.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
