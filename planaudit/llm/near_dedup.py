"""MinHash near-duplicates with bottom-k sketches from one hash function.

Every document is the set of its distinct word shingles, hashed once. The
smallest values are retained; how many follows from the set's size, so that two
sets at or above the threshold share at least `margin` retained values. Inverted
lists of retained values generate overlaps, an estimate from the union sketch
filters them, and the exact Jaccard of the full sets verifies.

No list is expanded into all pairs. A list first yields a star (each member with
its smallest member); once verified stars have been merged into components, a
list only yields pairs whose ends are still in different components. A value
retained by more than `hot` documents yields nothing: a linked pair shares a rarer
one too, unless both documents hold as many such values as they must share. Those
few documents are joined among themselves on the rarest values of their full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planaudit.llm import textops as tx
from planaudit.llm.common import HOT_KEYS, connected_components, materialize

ESTIMATE = 32
_ODD = tx.U(0xD6E8FEB86659FD93)


def _unsigned(x: int) -> int:
    return x & 0xFFFFFFFFFFFFFFFF


def retained(n: int, percent: int) -> tuple[int, int]:
    """Values kept of a set of n, and how many of them a linked pair shares at least."""
    spare = n - -(-percent * n // 100)
    margin = 2 + spare // 4 + min(spare, 12)
    return min(n, spare + margin), margin


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text: `width` words, or all words of a shorter text."""
    words = tx.Words(data, offsets, lower=True)
    grams = words.grams(width)
    for a, b in zip(words.at[:-1], words.at[1:], strict=True):
        if b - a >= width:
            yield np.unique(grams[a : b - width + 1])
        elif b > a:
            yield tx.sequence_hash(words.hash[a:b], int(b - a))
        else:
            yield np.zeros(0, np.uint64)


def _sketch(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = tx.buffers(batch.column(1))
        ids = batch.column(0)
        for low, high in tx.slices(offsets):
            sizes, first, second, kept = [], [], [], []
            for values in shingle_sets(data, offsets[low : high + 1], width):
                sizes.append(len(values))
                mixed = tx.mix(values ^ _ODD)
                first.append(int(mixed.sum(dtype=np.uint64)))
                second.append(int(np.bitwise_xor.reduce(mixed * _ODD)) if len(values) else 0)
                kept.append(values[: retained(len(values), percent)[0]])
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in kept])]).astype(np.int32)
            flat = np.concatenate(kept).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(low, high - low),
                    pa.array(np.array(sizes, np.int64)),
                    pa.array(np.array(first, np.uint64).view(np.int64)),
                    pa.array(np.array(second, np.uint64).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat)),
                ],
                names=["doc_id", "n", "d1", "d2", "kept"],
            )


def _lists(batches: Iterator[pa.RecordBatch], hot: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Inverted lists of (value, doc, set size), streamed in (value, doc) order: stars, short lists and members of hot lists.

    kind 0: star pair (a, b = smallest member) that the sizes allow; kind 1: (a,
    value) in a hot list; kind 2: the members of a short list of three or more, once
    for each set of members, and their sizes.
    """
    seen: set[bytes] = set()
    carry_v = carry_d = carry_n = np.zeros(0, np.int64)
    open_hot: int | None = None

    def out(kind: int, a: np.ndarray, b: np.ndarray, members: list[np.ndarray] | None = None, sizes: list[np.ndarray] | None = None) -> pa.RecordBatch:
        lists = members if members is not None else []
        bounds = pa.array((np.concatenate([[0], np.cumsum([len(x) for x in lists])]) if members is not None else np.zeros(len(a) + 1)).astype(np.int32))
        flat = [pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))) for x in (lists, sizes or [])]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), *flat], names=["kind", "a", "b", "members", "sizes"])

    def flush(v: np.ndarray, d: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(v):
            return
        begin = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        size = np.diff(np.append(begin, len(v)))
        of = np.repeat(np.arange(len(begin)), size)
        count, pivot = size[of], d[begin][of]
        least, most = np.minimum(n, n[begin][of]), np.maximum(n, n[begin][of])
        star = (count >= 2) & (count <= hot) & (d != pivot) & (100 * least >= percent * most)
        if star.any():
            pairs = np.unique(np.stack([d[star], pivot[star]]), axis=1)
            yield out(0, pairs[0], pairs[1])
        is_hot = count > hot
        if is_hot.any():
            yield out(1, d[is_hot], v[is_hot])
        fresh, sized = [], []
        for i in np.flatnonzero((size >= 3) & (size <= hot)):
            members = d[begin[i] : begin[i] + size[i]]
            key = members.tobytes()
            if key not in seen:
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(key)
                fresh.append(members)
                sized.append(n[begin[i] : begin[i] + size[i]])
        if fresh:
            yield out(2, np.zeros(len(fresh), np.int64), np.zeros(len(fresh), np.int64), fresh, sized)

    for batch in batches:
        v = np.concatenate([carry_v, batch.column(0).to_numpy(zero_copy_only=False)])
        d = np.concatenate([carry_d, batch.column(1).to_numpy(zero_copy_only=False)])
        n = np.concatenate([carry_n, batch.column(2).to_numpy(zero_copy_only=False)])
        if open_hot is not None:
            more = int(np.searchsorted(v != open_hot, True))
            if more:
                yield out(1, d[:more], v[:more])
            v, d, n = v[more:], d[more:], n[more:]
            if not len(v):
                carry_v = carry_d = carry_n = np.zeros(0, np.int64)
                continue
            open_hot = None
        if not len(v):
            continue
        last = len(v) - int(np.argmax(v[::-1] != v[-1])) if (v != v[-1]).any() else 0
        yield from flush(v[:last], d[:last], n[:last])
        carry_v, carry_d, carry_n = v[last:], d[last:], n[last:]
        if len(carry_v) > hot:
            yield out(1, carry_d, carry_v)
            open_hot, carry_v, carry_d, carry_n = int(v[-1]), *[np.zeros(0, np.int64)] * 3
    yield from flush(carry_v, carry_d, carry_n)


def _least_shared(percent: int) -> list[int]:
    """How many of the m smallest values of a union a pair at the threshold shares, but for a chance below 1e-10."""
    share, out = percent / 100, []
    for m in range(ESTIMATE + 1):
        tail, t = 0.0, 0
        while t <= m and (tail := tail + comb(m, t) * share**t * (1 - share) ** (m - t)) < 1e-10:
            t += 1
        out.append(t)
    return out


def _likely(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Keep pairs whose union sketch may come from sets above the threshold."""
    least = _least_shared(percent)
    for batch in batches:
        a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        keep = []
        for x, y in zip(a, b, strict=True):
            m = min(len(x), len(y))
            union = sorted(set(x).union(y), key=_unsigned)[:m]
            keep.append(len(set(x).intersection(y).intersection(union)) >= least[m])
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _full(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Full shingle sets of (doc_id, text)."""
    for batch in batches:
        data, offsets = tx.buffers(batch.column(1))
        for low, high in tx.slices(offsets):
            sets = list(shingle_sets(data, offsets[low : high + 1], width))
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array([len(x) for x in sets], pa.int64()), values], names=["a", "n", "kept"])


def _exact(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Links among (a, b, text_a, text_b), by the exact Jaccard of full shingle sets."""
    last_id, last_set = None, np.zeros(0, np.uint64)
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        a_data, a_off = tx.buffers(batch.column(2))
        b_data, b_off = tx.buffers(batch.column(3))
        b_ids = batch.column(1).to_pylist()
        for low, high in tx.slices(a_off):
            for i, mine in enumerate(shingle_sets(a_data, a_off[low : high + 1], width), low):
                if b_ids[i] != last_id:
                    last_id, last_set = b_ids[i], next(shingle_sets(b_data, b_off[i : i + 2], width))
                small, large = sorted((mine, last_set), key=len)
                at = np.searchsorted(large, small)
                both = int((large[np.minimum(at, len(large) - 1)] == small).sum()) if len(small) else 0
                union = len(mine) + len(last_set) - both
                keep[i] = both > 0 and 100 * both >= percent * union
        yield batch.select([0, 1]).filter(pa.array(keep))


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5, hot: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every document.

    Words are runs of non-space bytes after lower-casing A-Z; documents are linked
    when 100 * |intersection| >= percent * |union| of their sets of `width`-word
    shingles, and components are the classes of reachable documents.

    Null or blank texts have an empty set and stay alone. A text of fewer than
    `width` words is one shingle. Equal sets link whatever their number: they are
    one class from the start. Very long texts are hashed whole. A null id cannot
    be linked and comes back with null component_id and kept true. Rows with
    an equal id come back one by one, each placed by its own text; where the id is
    the smallest of both their classes, they share a component. Other columns are
    ignored, whatever their names. An empty table gives an empty result.
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent must be from 80 to 100")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketches = materialize(docs.mapInArrow(lambda it: _sketch(it, width, percent), "doc_id long, n long, d1 long, d2 long, kept array<long>"))
    full = sketches.where("n > 0 and doc_id is not null")
    same = ["d1", "d2", "n"]
    classes = materialize(full.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")))
    reps = materialize(full.join(classes.select(F.col("rep").alias("doc_id"), *same), ["doc_id", *same], "left_semi").select("doc_id", "n", "kept"))
    values = reps.select(F.explode("kept").alias("value"), "doc_id", "n")
    found = materialize(
        values.repartition("value").sortWithinPartitions("value", "doc_id").mapInArrow(lambda it: _lists(it, hot, percent), "kind int, a long, b long, members array<long>, sizes array<long>")
    )
    texts = docs.where("doc_id is not null")
    fits = f"100 * least(n, nb) >= {percent} * greatest(n, nb)"

    def verified(pairs: DataFrame) -> DataFrame:
        short = reps.select("doc_id", F.slice("kept", 1, ESTIMATE).alias("s"))
        drawn = pairs.join(short.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a").join(short.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")
        likely = materialize(drawn.select("a", "b", "sa", "sb").mapInArrow(lambda it: _likely(it, percent), "a long, b long"))
        if likely.isEmpty():
            return likely
        whole = likely.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
        return materialize(whole.select("a", "b", "ta", "tb").mapInArrow(lambda it: _exact(it, width, percent), "a long, b long").distinct())

    # the smallest partner has m = ceil(percent * n / 100) shingles, and its margin bounds what the two share
    spare = "(m + floor(-%d * m / 100))" % percent
    margins = reps.select(F.col("doc_id").alias("a"), (-F.floor(F.lit(-percent) * F.col("n") / 100)).alias("m")).select("a", F.expr(f"2 + floor({spare} / 4) + least({spare}, 12)").alias("margin"))
    common = found.where("kind = 1").groupBy("a").agg(F.count("*").alias("u"))
    laden = materialize(common.join(margins, "a").where("u >= margin").select("a").distinct())
    crowded = not laden.isEmpty()
    stars = found.where("kind = 0").select("a", "b")
    if crowded:
        # among themselves, these documents are joined on the rarest values of their full sets
        sets = materialize(laden.join(texts.withColumnRenamed("doc_id", "a"), "a").select("a", "text").mapInArrow(lambda it: _full(it, width), "a long, n long, kept array<long>").select("a", "n", F.explode("kept").alias("value")))
        often = sets.groupBy("value").agg(F.count("*").alias("df"))
        rare_first = Window.partitionBy("a", "n").orderBy("df", "value")
        ranked = sets.join(often, "value").withColumn("at", F.row_number().over(rare_first)).where(f"at <= n + floor(-{percent} * n / 100) + 1")
        alone = ranked.withColumn("alone", F.count_if(F.col("df") == 1).over(Window.partitionBy("a", "n")))
        prefix = materialize(alone.where("df > 1").select("value", "a", "n", "at", "alone").distinct())
        # the member with the fewest values of its own is the nearest to all others
        pivots = prefix.groupBy("value").agg(F.min(F.struct("alone", F.col("a").alias("b"), F.col("n").alias("nb"))).alias("x")).select("value", "x.b", "x.nb")
        central = prefix.join(pivots, "value").where(f"a <> b and {fits}").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        stars = stars.unionByName(central)
    tested = materialize(stars.distinct())
    parts = connected_components(verified(tested))

    def placed(df: DataFrame) -> DataFrame:
        named = parts.select(F.col("node").alias("a"), F.col("component").alias("of_a"))
        return df.join(named, "a", "left").withColumn("of_a", F.coalesce("of_a", "a"))

    lists = found.where("kind = 2").select("members", "sizes").distinct().select(F.xxhash64("members").alias("key"), F.inline(F.arrays_zip(F.col("members").alias("a"), F.col("sizes").alias("n"))))
    groups = placed(lists).groupBy("key").agg(F.collect_set(F.struct("of_a", "a", "n")).alias("m")).where(F.size(F.array_distinct(F.col("m.of_a"))) > 1)
    pairs = groups.select(F.explode("m").alias("x"), "m").select("x", F.explode(F.filter("m", lambda y: (y["a"] < F.col("x.a")) & (y["of_a"] != F.col("x.of_a")))).alias("y"))
    rest = pairs.select("x.a", "x.n", F.col("y.a").alias("b"), F.col("y.n").alias("nb")).where(fits).select("a", "b")
    if crowded:
        split = placed(prefix).select("value", "a", "n", "at", "of_a")
        mixed = split.groupBy("value").agg(F.min("of_a").alias("lo"), F.max("of_a").alias("hi")).where("lo <> hi").select("value")
        mine = prefix.groupBy("a", "n").agg(F.array_sort(F.collect_list(F.struct("at", "value")))["value"].alias("p"))
        split = materialize(split.join(mixed, "value", "left_semi").join(mine, ["a", "n"]))
        other = split.select("value", F.col("a").alias("b"), F.col("of_a").alias("of_b"), F.col("n").alias("nb"), F.col("at").alias("at_b"), F.col("p").alias("pb"))
        # a pair comes from the rarest value that its ends share; what they share besides lies behind it in both
        enough = f"{100 + percent} * (least(n - at, nb - at_b) + 1) >= {percent} * (n + nb)"
        rest = rest.unionByName(split.join(other, "value").where(f"a > b and of_a <> of_b and {fits} and {enough} and value = array_intersect(p, pb)[0]").select("a", "b"))
    rest = materialize(rest.distinct().join(tested, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        more = verified(rest)
        if not more.isEmpty():
            parts = connected_components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    own = sketches.select("doc_id", "n", *same[:2])
    moved = parts.where("node <> component").select(F.col("node").alias("rep"), "component")
    final = materialize(classes.join(moved, "rep", "left").select(*same, "c", (F.col("component").isNotNull() | (F.col("c") > 1)).alias("linked"), F.coalesce("component", "rep").alias("component_id")))
    # a class with over a thousandth of the rows is one of at most 1000: these are broadcast, so that no task gets all copies
    large = F.broadcast(final.where(F.col("c") * HOT_KEYS > own.count()).select(*same, "component_id"))
    rows = own.where("n > 0 and doc_id is not null")
    small = rows.join(large, same, "left_anti").join(final.where("linked").select(*same, "component_id"), same, "left")
    named = rows.join(large, same).unionByName(small).unionByName(own.where("n = 0 or doc_id is null").withColumn("component_id", F.lit(None).cast("long")))
    result = named.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return result.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
