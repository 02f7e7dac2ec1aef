"""SimHash near-duplicates: fingerprints joined by the generalised pigeonhole principle.

Of m parts of the bits, with r + 1 units dealt to them, some part with u > 0 units
differs in less than u bits whenever two fingerprints differ in r bits at most. Bits
that go together stand in one part. How many parts there are, and for every
fingerprint which parts get how many units, follows from estimated candidate counts
by dynamic programming: a fingerprint asks for nothing where its value is common,
and for its neighbours, too, where it is rare. The rows of a part's value are then
probed, and each pair is verified on all bits where it is found.

A value that more than CROWDED distinct fingerprints have or ask for yields no pairs.
These fingerprints list everything within one bit of themselves instead, 65 values
each: two of them are within two bits of each other if and only if they list a
common value, and at most 65 fingerprints can list one. So the work of a group grows
with its size, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planaudit.llm import textops as tx
from planaudit.llm.common import HOT_KEYS, connected_components, join_hot, materialize

BITS, RADIUS, SEED = 64, 2, 42
PARTS = (2, 3, 4)
#: Bits of which a histogram is kept.
BLOCK_BITS = 8
CROWDED = 128
LANE = 128


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of the shingles of each text, repeats included, and how many each text has."""
    words = tx.Words(data, offsets, lower=True, hashed=False)
    size = words.end - words.start
    n = len(size)
    # the words with one blank after each
    joined = np.full(int(size.sum()) + n, 0x20, np.uint8)
    begin = np.cumsum(size + 1) - size - 1
    joined[np.arange(int(size.sum())) + np.repeat(np.arange(n), size)] = words.data[words.inside]
    raw = joined.tobytes()
    per_text = np.diff(words.at)
    count = np.maximum(per_text - width + 1, np.minimum(per_text, 1))
    first = np.repeat(words.at[:-1] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    last = first + np.repeat(np.minimum(per_text, width), count) - 1
    spans = zip(begin[first].tolist(), (begin + size)[last].tolist(), strict=True)
    return np.fromiter((xxhash.xxh64_intdigest(raw[a:b], SEED) for a, b in spans), np.uint64, len(first)), count


def unpacked(values: np.ndarray) -> np.ndarray:
    """One row of 64 zeros and ones for each value, the lowest bit first."""
    return np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def majority(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Fingerprint of each text: the bits set in over half of its hashes."""
    sums = np.zeros((len(count), BITS), np.int64)
    text = np.repeat(np.arange(len(count)), count)
    for low in range(0, len(hashes), tx.SLICE_BYTES // 16):
        part = text[low : low + tx.SLICE_BYTES // 16]
        begins = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        # up to 128 ones at a time are summed in bytes, eight bytes at once
        cuts = np.union1d(begins, np.arange(0, len(part), LANE))
        bits = unpacked(hashes[low : low + tx.SLICE_BYTES // 16]).view(np.uint64)
        lanes = np.add.reduceat(bits, cuts, axis=0).view(np.uint8)
        sums[part[begins]] += np.add.reduceat(lanes, np.searchsorted(cuts, begins), axis=0, dtype=np.int64)
    return np.packbits(2 * sums > count[:, None], axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def _fingerprints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = tx.buffers(batch.column(1))
        for low, high in tx.slices(offsets):
            values = majority(*shingle_hashes(data, offsets[low : high + 1], width))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(values.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda it: _fingerprints(it, width), "doc_id long, fp long")


def _values(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return batch.column(column).to_numpy(zero_copy_only=False).view(np.uint64)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of the task's fingerprints have both bits, for every pair of bits."""
    both = np.zeros((BITS, BITS), np.int64)
    for batch in batches:
        bits = unpacked(_values(batch, 0)).astype(np.float64)
        both += np.rint(bits.T @ bits).astype(np.int64)
    i, j = np.indices(both.shape)
    yield pa.RecordBatch.from_arrays([pa.array(x.ravel()) for x in (i, j, both)], names=["i", "j", "n"])


def parted(both: np.ndarray, n: int, parts: int) -> list[np.ndarray]:
    """The bits in `parts` groups of nearly equal size, those that go together in one: each group grows by the bit most correlated with it."""
    ones = np.diag(both).astype(float)
    spread = np.sqrt(np.outer(ones * (n - ones), ones * (n - ones)))
    related = np.abs(np.divide(n * both - np.outer(ones, ones), spread, out=np.zeros(both.shape), where=spread > 0))
    np.fill_diagonal(related, 0)
    left, out = list(range(BITS)), []
    for k in range(parts):
        group: list[int] = []
        while len(group) < (BITS * (k + 1)) // parts - (BITS * k) // parts:
            pull = related[np.ix_(left, group or left)].sum(axis=1)
            group.append(left.pop(int(np.argmax(pull))))
        out.append(np.array(group))
    return out


def picked(values: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The named bits of each value, as a number."""
    out = np.zeros(len(values), np.uint64)
    for at, bit in enumerate(bits.tolist()):
        out |= ((values >> tx.U(bit)) & tx.U(1)) << tx.U(at)
    return out


def _blocks(group: np.ndarray) -> list[np.ndarray]:
    return np.array_split(group, -(-len(group) // BLOCK_BITS))


def _histograms(batches: Iterator[pa.RecordBatch], plans: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    blocks = [block for plan in plans.values() for group in plan for block in _blocks(group)]
    counts = np.zeros((len(blocks), 1 << BLOCK_BITS), np.int64)
    for batch in batches:
        for row, block in zip(counts, blocks, strict=True):
            row += np.bincount(picked(_values(batch, 0), block).astype(np.int64), minlength=len(row))
    i, j = np.indices(counts.shape)
    yield pa.RecordBatch.from_arrays([pa.array(x.ravel()) for x in (i, j, counts)], names=["i", "j", "n"])


class Plan:
    """Parts of the bits and what a fingerprint's probes in each are expected to cost."""

    def __init__(self, groups: list[np.ndarray], counts: list[np.ndarray], n: int) -> None:
        self.groups, self.n = groups, n
        rows, self.near = iter(counts), []
        for group in groups:
            # share of the fingerprints that differ from a block's value in 0, 1, 2 bits
            tables = []
            for block in _blocks(group):
                hist = next(rows)[: 1 << len(block)] / max(n, 1)
                apart = np.bitwise_count(np.arange(len(hist))[:, None] ^ np.arange(len(hist))[None, :])
                tables.append(np.stack([(apart == e) @ hist for e in range(RADIUS + 1)], axis=1))
            self.near.append(tables)

    def costs(self, values: np.ndarray) -> np.ndarray:
        """(fingerprints, parts, units): rows that u units in a part make, taking the blocks of a part as independent."""
        out = np.zeros((len(values), len(self.groups), RADIUS + 2))
        for i, (group, tables) in enumerate(zip(self.groups, self.near, strict=True)):
            share = np.zeros((len(values), RADIUS + 1))
            share[:, 0] = 1
            for block, table in zip(_blocks(group), tables, strict=True):
                own = table[picked(values, block).astype(np.int64)]
                share = np.stack([sum(share[:, a] * own[:, e - a] for a in range(e + 1)) for e in range(RADIUS + 1)], axis=1)
            probes = np.cumsum([comb(len(group), e) for e in range(RADIUS + 1)])
            out[:, i, 1:] = probes + self.n * np.cumsum(share, axis=1)
        return out

    def allocate(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units of each part for each fingerprint (they sum to r + 1), and the cost of that."""
        costs, units = self.costs(values), RADIUS + 1
        best = np.full((len(values), units + 1), np.inf)
        best[:, 0] = 0
        taken = []
        for i in range(len(self.groups)):
            options = np.stack([np.stack([best[:, j - u] + costs[:, i, u] if u <= j else np.full(len(values), np.inf) for u in range(units + 1)], axis=1) for j in range(units + 1)], axis=1)
            taken.append(np.argmin(options, axis=2))
            best = np.min(options, axis=2)
        out, left = np.zeros((len(values), len(self.groups)), np.int64), np.full(len(values), units)
        for i in reversed(range(len(self.groups))):
            out[:, i] = taken[i][np.arange(len(values)), left]
            left = left - out[:, i]
        return out, best[:, units]


def _spent(batches: Iterator[pa.RecordBatch], plans: dict[int, Plan]) -> Iterator[pa.RecordBatch]:
    cost = dict.fromkeys(plans, 0.0)
    for batch in batches:
        for parts, plan in plans.items():
            cost[parts] += float(plan.allocate(_values(batch, 0))[1].sum())
    yield pa.RecordBatch.from_arrays([pa.array(list(cost), pa.int32()), pa.array(list(cost.values()), pa.float64())], names=["parts", "cost"])


def _probes(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp, asks): a fingerprint at its own value of every part, and at those values near by that it asks for."""
    for batch in batches:
        everything = _values(batch, 0)
        for low in range(0, len(everything), 4096):
            values = everything[low : low + 4096]
            units, _ = plan.allocate(values)
            for i, group in enumerate(plan.groups):
                own, part = picked(values, group), tx.U(i << 40)
                yield _rows(part | own, values, units[:, i] > 0)
                for e in range(1, RADIUS + 1):
                    who = np.flatnonzero(units[:, i] > e)
                    if len(who):
                        flips = np.array([sum(1 << b for b in bits) for bits in combinations(range(len(group)), e)], np.uint64)
                        for some in np.array_split(who, -(-len(who) * len(flips) // (1 << 20))):
                            yield _rows(part | (own[some][:, None] ^ flips).ravel(), np.repeat(values[some], len(flips)), np.ones(len(some) * len(flips), bool))


def _rows(key: np.ndarray, fp: np.ndarray, asks: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(asks)], names=["key", "fp", "asks"])


def _verified(batches: Iterator[pa.RecordBatch], crowded: int) -> Iterator[pa.RecordBatch]:
    """Links among rows (key, fp, asks) in order of key: pairs of one key, one of which asks, that differ in r bits at most; of a crowded key (a, null) for all its rows."""

    def out(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))], names=["a", "b"])

    def settle(key: np.ndarray, fp: np.ndarray, asks: np.ndarray) -> Iterator[pa.RecordBatch]:
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(key)))
        many = np.repeat(size > crowded, size)
        if many.any():
            yield out(fp[many], None)
        end = np.repeat(begin + size, size)
        at, apart = np.flatnonzero(~many), 1
        while len(at := at[at + apart < end[at]]):
            a, b = fp[at], fp[at + apart]
            linked = (asks[at] | asks[at + apart]) & (np.bitwise_count(a ^ b) <= RADIUS) & (a != b)
            if linked.any():
                yield out(a[linked], b[linked])
            apart += 1

    key, fp, asks = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.concatenate([key, batch.column(0).to_numpy(zero_copy_only=False)])
        fp = np.concatenate([fp, _values(batch, 1)])
        asks = np.concatenate([asks, batch.column(2).to_numpy(zero_copy_only=False)])
        last = int(np.searchsorted(key, key[-1]))
        yield from settle(key[:last], fp[:last], asks[:last])
        key, fp, asks = key[last:], fp[last:], asks[last:]
        if len(key) > 2 * crowded:
            # the key is crowded: only so many rows wait for more of it as show that
            yield out(fp[crowded + 1 :], None)
            key, fp, asks = key[: crowded + 1], fp[: crowded + 1], asks[: crowded + 1]
    yield from settle(key, fp, asks)


def links(values: DataFrame, crowded: int = CROWDED, parts: tuple[int, ...] = PARTS) -> DataFrame:
    """a, b: links among the distinct fingerprints values(fp) that have the same components as all pairs within two bits."""
    values = values.select("fp")

    def gathered(df: DataFrame, shape: tuple[int, int]) -> np.ndarray:
        table = np.zeros(shape, np.int64)
        for row in df.groupBy("i", "j").agg(F.sum("n").alias("n")).collect():  # 64 * 64, or 256 for each block
            table[row.i, row.j] = row.n
        return table

    counts = "i long, j long, n long"
    n = values.count()
    both = gathered(values.mapInArrow(_together, counts), (BITS, BITS))
    groups = {m: parted(both, n, m) for m in parts}
    sizes = {m: sum(len(_blocks(g)) for g in plan) for m, plan in groups.items()}
    hist = list(gathered(values.mapInArrow(lambda it: _histograms(it, groups), counts), (sum(sizes.values()), 1 << BLOCK_BITS)))
    plans = {m: Plan(plan, [hist.pop(0) for _ in range(sizes[m])], n) for m, plan in groups.items()}
    spent = values.mapInArrow(lambda it: _spent(it, plans), "parts int, cost double").groupBy("parts").agg(F.sum("cost").alias("cost")).orderBy("cost", "parts").first()
    plan = plans[spent.parts if spent else parts[0]]
    rows = materialize(values.mapInArrow(lambda it: _probes(it, plan), "key long, fp long, asks boolean"))
    often = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("asks").alias("asks"))
    # keys with over a thousandth of the rows are at most 1000
    total = often.agg(F.sum("n").alias("t"))
    hot = F.broadcast(often.join(F.broadcast(total), (F.col("n") * HOT_KEYS > F.col("t")) & (F.col("n") > crowded)).select("key", F.col("asks").alias("asked")).limit(HOT_KEYS))
    rest = rows.join(hot, "key", "left_anti").repartition("key").sortWithinPartitions("key", "fp")
    found = materialize(rest.mapInArrow(lambda it: _verified(it, crowded), "a long, b long"))
    crowd = rows.join(hot.where("asked"), "key", "left_semi").select("fp").unionByName(found.where("b is null").select(F.col("a").alias("fp"))).distinct()
    around = F.expr("transform(sequence(0, 64), j -> if(j = 64, fp, fp ^ shiftleft(1L, j)))")
    # a value is within one bit of 65 fingerprints at most
    meeting = crowd.select("fp", F.explode(around).alias("near")).groupBy("near").agg(F.collect_set("fp").alias("m")).where(F.size("m") > 1)
    stars = meeting.select(F.explode("m").alias("a"), F.array_min("m").alias("b")).where("a <> b")
    return found.where("b is not null").unionByName(stars)


def near_duplicates(docs: DataFrame, width: int = 3, crowded: int = CROWDED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    Words are runs of non-space bytes after lower-casing A-Z; shingles are `width`
    words joined by blanks, counted as often as they stand in the text, or all words
    of a shorter text. Texts without words, and null ones, have fingerprint zero and
    link like any other. Rows link at two or fewer differing bits; component_id is
    the smallest doc_id of the class. A null id comes back with its fingerprint and
    the component of its class, if that has an id at all, but names no class. Rows
    with an equal id are placed one by one, each by its own text. Texts are read
    whole, a slice at a time. Other columns are ignored, whatever their names. An
    empty table gives an empty result.
    """
    rows = materialize(fingerprints(docs, width, id_col, text_col))
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    parts = connected_components(links(classes, crowded))
    placed = materialize(classes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("component")))
    least = materialize(placed.groupBy("component").agg(F.min("low").alias("component_id")))
    named = materialize(join_hot(placed, least, ["component"]).select("fp", "component_id"))
    return join_hot(rows, named, ["fp"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
