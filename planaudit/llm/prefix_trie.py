"""A trie of the turns that conversations begin with, built as a z-fast trie in batches.

A conversation is the row of its prefixes' keys: the key of its first d turns is the
exclusive or of 128-bit hashes of (turn, position), so equal prefixes have equal keys and
two different ones collide with a chance of about n^2 / 2^129. The trie is compacted:
a node stands where conversations end or part, and holds the keys of the edge that
leads to it from depth p to its own depth e. It is found by the key at its handle, the
depth in (p, e] that is divisible by the largest power of two.

Conversations come in batches, each larger than the one before. The exit of each
is located in the trie so far by fat binary search: the interval of depths that may
hold it begins as all of the conversation's, and each round asks a join for the handle
at the two-fattest depth of what is left, so there are about log2(length) rounds, and
conversations that are done leave. Then edges are split at exits inside them and what
lies behind the exits is added; prefixes that earlier batches brought are not grouped
again. At the end, counts are summed over the paths of distinct conversations and edges
are expanded to one row for each depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planaudit.llm import textops as tx
from planaudit.llm.common import join_hot, materialize
from planaudit.llm.mixing import n_words

#: A batch holds the conversations whose hashed id, modulo the last of these, is below its own and not below the one before.
BATCHES = (1, 4, 16)
NO_TEXT = hashlib.sha256(b"").hexdigest()
KEYS = "array<struct<k1: long, k2: long, words: long>>"
NODE = f"e int, k1 long, k2 long, p int, pk1 long, pk2 long, before long, edge {KEYS}"


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id and turns, an array of (k1, k2, words) in order, from (conv_id, turn, role, text).

    Turns stand in order of turn (null first), then of role and of a hash of the text;
    a null role or text is empty. Rows without a conv_id are left out.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    hashed = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").alias("turn"), role.alias("role"), F.xxhash64(role, text).alias("k1"), F.xxhash64(F.lit("turn"), text, role).alias("k2"), n_words(text).alias("words")).alias("t"),
    )
    inside = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["k1"].alias("k1"), t["k2"].alias("k2"), t["words"].alias("words")))
    return hashed.groupBy("conv_id").agg(inside.alias("turns"))


def reopened(rows: DataFrame, block: int = 20, most: int = 3) -> DataFrame:
    """sequences(conv_id, turns) rebuilt: the first h turns of conversation c - c % block, then c's own after its first h; h = crc32(c) % (most + 1)."""
    heads = rows.select(F.col("conv_id").alias("first"), F.slice("turns", 1, most).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    rows = rows.withColumn("h", h).withColumn("first", F.col("conv_id") - F.col("conv_id") % block).join(heads, "first", "left")
    return rows.select("conv_id", F.expr(f"concat(coalesce(slice(head, 1, h), cast(array() as {KEYS})), slice(turns, h + 1, greatest(size(turns) - h, 0)))").alias("turns"))


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys and summed words of all prefixes of each sequence."""
    for batch in batches:
        lists = batch.column(1)
        flat = lists.flatten()
        size = np.diff(lists.offsets.to_numpy())
        end = np.cumsum(size)
        at = (np.arange(len(flat)) - np.repeat(end - size, size) + 1).astype(np.uint64)
        fields = []
        for name, salt in (("k1", 1), ("k2", 2)):
            turn = flat.field(name).to_numpy(zero_copy_only=False).view(np.uint64)
            placed = tx.mix(turn ^ tx.mix(at * tx.U(2) + tx.U(salt << 40)))
            running = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(placed)])
            fields.append((running[1:] ^ np.repeat(running[end - size], size)).view(np.int64))
        words = np.concatenate([np.zeros(1, np.int64), np.cumsum(flat.field("words").to_numpy(zero_copy_only=False))])
        fields.append(words[1:] - np.repeat(words[end - size], size))
        keys = pa.StructArray.from_arrays([pa.array(x) for x in fields], names=["k1", "k2", "words"])
        offsets = pa.array(np.concatenate([[0], end]).astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size.astype(np.int32)), pa.ListArray.from_arrays(offsets, keys)], names=["conv_id", "n", "keys"])


def _fattest(low: str, high: str) -> str:
    """The number in (low, high] that the largest power of two divides, as SQL."""
    m = f"cast(floor(log2({low} ^ {high})) as int)"
    return f"shiftleft(shiftright({high}, {m}), {m})"


def _handled(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("f", F.expr(_fattest("p", "e"))).withColumns({"f1": F.expr("edge[f - p - 1].k1"), "f2": F.expr("edge[f - p - 1].k2")})


def _shared(depth: str) -> Column:
    """How deep a conversation goes along with an edge that leaves its path at `depth`."""
    return F.expr(f"{depth} + size(filter(sequence(1, least(size(edge), n - {depth})), i -> edge[i - 1].k1 = keys[{depth} + i - 1].k1 and edge[i - 1].k2 = keys[{depth} + i - 1].k2))")


def _located(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """rows(conv_id, n, keys) with lcp, the depth at which each leaves the trie, and the node (n1, n2) of the edge that it leaves in the middle, or null."""
    handles = nodes.select("f", F.col("f1").alias("h1"), F.col("f2").alias("h2"), "e", F.col("k1").alias("e1"), F.col("k2").alias("e2"))
    known = ["conv_id", "n", "keys"]
    none = F.lit(None).cast("long")
    active, done = rows.select(*known, F.lit(0).alias("a"), F.col("n").alias("b"), none.alias("n1"), none.alias("n2")), []
    while True:
        done.append(active.where("a >= b"))
        active = active.where("a < b").withColumn("f", F.expr(_fattest("a", "b"))).withColumns({"h1": F.expr("keys[f - 1].k1"), "h2": F.expr("keys[f - 1].k2")})
        asked = active.join(handles, ["f", "h1", "h2"], "left")
        active = materialize(asked.select(*known, F.coalesce("e", "a").alias("a"), F.when(F.col("e").isNull(), F.col("f") - 1).otherwise(F.col("b")).alias("b"), F.coalesce("e1", "n1").alias("n1"), F.coalesce("e2", "n2").alias("n2")))
        if active.isEmpty():
            break
    found = reduce(DataFrame.unionByName, done).drop("b")
    # the deepest node whose handle is on the path: its edge may still lead elsewhere behind the handle
    edges = nodes.select(F.col("k1").alias("n1"), F.col("k2").alias("n2"), "p", "edge")
    at_node = found.where("a > 0").join(edges, ["n1", "n2"]).withColumn("lcp", _shared("p")).select(*known, "a", "n1", "n2", "lcp")
    at_node = materialize(at_node.unionByName(found.where("a = 0").withColumn("lcp", F.lit(0))))
    inside = at_node.where("lcp < a").select(*known, "lcp", "n1", "n2")
    through = at_node.where("lcp >= a")
    ended = through.where("n = a").select(*known, "lcp", none.alias("n1"), none.alias("n2"))
    children = nodes.select(F.expr("edge[0].k1").alias("c1"), F.expr("edge[0].k2").alias("c2"), F.col("k1").alias("n1"), F.col("k2").alias("n2"), "e", "edge")
    onward = through.where("n > a").drop("n1", "n2", "lcp").withColumns({"c1": F.expr("keys[a].k1"), "c2": F.expr("keys[a].k2")}).join(children, ["c1", "c2"], "left")
    onward = onward.withColumn("lcp", F.when(F.col("edge").isNull(), F.col("a")).otherwise(_shared("a"))).withColumn("mid", F.col("lcp") < F.col("e"))
    onward = onward.select(*known, "lcp", F.when(F.col("mid"), F.col("n1")).alias("n1"), F.when(F.col("mid"), F.col("n2")).alias("n2"))
    return materialize(inside.unionByName(ended).unionByName(onward))


def _split(nodes: DataFrame, exits: DataFrame) -> DataFrame:
    """nodes with the edges cut where a conversation leaves one in the middle."""
    cuts = exits.where("n1 is not null").select(F.col("n1").alias("k1"), F.col("n2").alias("k2"), "lcp").distinct().groupBy("k1", "k2").agg(F.array_sort(F.collect_list("lcp")).alias("cuts"))
    rows = nodes.join(cuts, ["k1", "k2"], "left")
    whole = rows.where("cuts is null").select(*nodes.columns)
    ends = F.expr("inline(transform(concat(array(p), cuts), (x, i) -> struct(x as low, concat(cuts, array(e))[i] as high)))")
    pieces = rows.where("cuts is not null").select("p", "pk1", "pk2", "before", "edge", ends)
    pieces = pieces.select(
        F.col("high").alias("e"),
        F.expr("edge[high - p - 1].k1").alias("k1"),
        F.expr("edge[high - p - 1].k2").alias("k2"),
        F.col("low").alias("p"),
        F.expr("if(low = p, pk1, edge[greatest(low - p, 1) - 1].k1)").alias("pk1"),
        F.expr("if(low = p, pk2, edge[greatest(low - p, 1) - 1].k2)").alias("pk2"),
        F.expr("if(low = p, before, edge[greatest(low - p, 1) - 1].words)").alias("before"),
        F.expr("slice(edge, low - p + 1, high - low)").alias("edge"),
    )
    return whole.unionByName(pieces)


def _grown(exits: DataFrame) -> DataFrame:
    """The nodes that lie behind the exits of a batch."""
    behind = exits.where("lcp < n").select("conv_id", "n", F.expr("inline(transform(sequence(lcp + 1, n), d -> struct(d as d, keys[d - 1].k1 as k1, keys[d - 1].k2 as k2, if(d = 1, 0L, keys[greatest(d, 2) - 2].k1) as q1, if(d = 1, 0L, keys[greatest(d, 2) - 2].k2) as q2)))"))
    found = materialize(behind.groupBy("k1", "k2").agg(F.min("conv_id").alias("first"), F.min("q1").alias("q1"), F.min("q2").alias("q2"), F.max(F.col("d") == F.col("n")).alias("ends")))
    parting = found.groupBy("q1", "q2").agg(F.count("*").alias("c")).where("c > 1").select(F.col("q1").alias("k1"), F.col("q2").alias("k2"), F.lit(True).alias("parts"))
    marked = materialize(found.join(parting, ["k1", "k2"], "left").where("ends or parts").select("k1", "k2", "first"))
    # a conversation that comes first anywhere does so at its own end: copies add nothing
    own_end = exits.where("lcp < n").withColumns({"k1": F.expr("keys[n - 1].k1"), "k2": F.expr("keys[n - 1].k2")}).join(marked, ["k1", "k2"]).where("conv_id = first").select("conv_id", "n", "keys", "lcp")
    firsts = materialize(own_end)
    steps = firsts.select("conv_id", F.expr("inline(transform(sequence(lcp + 1, n), d -> struct(d as d, keys[d - 1].k1 as k1, keys[d - 1].k2 as k2)))")).join(marked, ["k1", "k2"])
    depths = steps.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("d", (F.col("first") == F.col("conv_id")).alias("own")))).alias("stops"))
    rows = firsts.join(depths, "conv_id").select("keys", F.expr("inline(transform(stops, (s, i) -> struct(if(i = 0, lcp, stops[greatest(i, 1) - 1].d) as p, s.d as e, s.own as own)))")).where("own")
    last = "keys[greatest(p, 1) - 1]"
    return rows.select(
        "e", F.expr("keys[e - 1].k1").alias("k1"), F.expr("keys[e - 1].k2").alias("k2"), "p", F.expr(f"if(p = 0, 0L, {last}.k1)").alias("pk1"), F.expr(f"if(p = 0, 0L, {last}.k2)").alias("pk2"), F.expr(f"if(p = 0, 0L, {last}.words)").alias("before"), F.expr("slice(keys, p + 1, e - p)").alias("edge")
    )


def compacted(keyed: DataFrame, batches: tuple[int, ...] = BATCHES) -> DataFrame:
    """The nodes of the compacted trie of keyed(conv_id, n, keys), the root left out."""
    nodes, low = None, 0
    for high in batches:
        at = F.pmod(F.xxhash64("conv_id"), F.lit(batches[-1]))
        rows = keyed.where((at >= low) & (at < high))
        if nodes is None:
            none = F.lit(None).cast("long")
            nodes = materialize(_handled(_grown(materialize(rows.select("conv_id", "n", "keys", F.lit(0).alias("lcp"), none.alias("n1"), none.alias("n2"))))))
        else:
            exits = _located(rows, nodes)
            nodes = materialize(_handled(_split(nodes.drop("f", "f1", "f2"), exits).unionByName(_grown(exits))))
        low = high
    return nodes


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one node's conversations (k1, k2, conv_id in order), each run as one text."""
    for batch in batches:
        if batch.num_rows:
            k1, k2, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cut = np.flatnonzero(np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]))
            texts = [",".join(map(str, part.tolist())) for part in np.split(ids, cut[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(k1[cut]), pa.array(k2[cut]), pa.array(ids[cut]), pa.array(texts)], names=["k1", "k2", "at", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined texts of each node, streamed in order."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])
    node, digest = None, None
    for batch in batches:
        rows = []
        for k1, k2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if node != (k1, k2):
                if node is not None:
                    rows.append((*node, digest.hexdigest()))
                node, digest = (k1, k2), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(text.encode())
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t.type) for x, t in zip(zip(*rows, strict=True) if rows else ([], [], []), schema, strict=True)], schema=schema)
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((*node, digest.hexdigest()), schema, strict=True)], schema=schema)


def prefix_nodes(rows: DataFrame, batches: tuple[int, ...] = BATCHES) -> DataFrame:
    """One row for each distinct prefix of the sequences rows(conv_id, turns): conv_id (its smallest member), depth,
    parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Members begin with the prefix; n_leaves counts childless nodes of the subtree, which
    includes its top; saved_tokens sums (n_convs - 1) * words of the last turn over it;
    ends_sha256 is of the comma-joined ids of the members that end there. A sequence
    without turns is a member of the root alone. A conv_id has one row (as `sequences`
    gives it). The prefixes of one conversation are one row of 24 bytes a turn, without
    its texts. Other columns are ignored. No conversations give no rows, and no root.
    """
    keyed = materialize(rows.select("conv_id", "turns").mapInArrow(_prefixes, f"conv_id long, n int, keys {KEYS}"))
    nodes = compacted(keyed, batches)
    at_end = [F.expr(f"if(n = 0, 0L, keys[greatest(n, 1) - 1].{k})").alias(k) for k in ("k1", "k2")]
    ends = keyed.select("conv_id", *at_end)
    ended = materialize(ends.groupBy("k1", "k2").agg(F.count("*").alias("c"), F.min("conv_id").alias("conv_id")))
    children = nodes.groupBy(F.col("pk1").alias("k1"), F.col("pk2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = materialize(nodes.drop("f", "f1", "f2").join(children, ["k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    leaves = nodes.where("n_children = 0").select("k1", "k2", F.lit(1).alias("leaf"))
    # members, the smallest of them and leaves: from each distinct conversation to all its prefixes
    told = ended.where("k1 <> 0 or k2 <> 0").join(leaves, ["k1", "k2"], "left").select("conv_id", "c", F.coalesce("leaf", F.lit(0)).alias("leaf"))
    along = told.join(keyed.select("conv_id", "keys"), "conv_id").select("conv_id", "c", "leaf", F.explode("keys").alias("x"))
    sums = along.groupBy("x.k1", "x.k2").agg(F.sum("c").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("leaf").alias("n_leaves"))
    nodes = materialize(nodes.join(sums, ["k1", "k2"]).withColumn("own", (F.col("n_convs") - 1) * (F.expr("edge[size(edge) - 1].words") - F.col("before"))))
    # saved words: from each node to the prefixes of a member
    up = nodes.where("own > 0").select("conv_id", "e", "own").join(keyed.select("conv_id", "keys"), "conv_id").select("own", F.explode(F.slice("keys", 1, F.col("e"))).alias("x"))
    saved = up.groupBy("x.k1", "x.k2").agg(F.sum("own").alias("saved"))
    nodes = materialize(nodes.join(saved, ["k1", "k2"], "left").withColumn("saved", F.coalesce("saved", F.lit(0))))
    several = ends.join(ended.where("c > 1").select("k1", "k2"), ["k1", "k2"], "left_semi")
    chunks = several.select("k1", "k2", "conv_id").repartitionByRange("k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id").mapInArrow(_chunks, "k1 long, k2 long, at long, ids string")
    digests = chunks.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "at").mapInArrow(_digests, "k1 long, k2 long, ends_sha256 string")
    single = ended.where("c = 1").select("k1", "k2", F.sha2(F.col("conv_id").cast("string").cast("binary"), 256).alias("ends_sha256"))
    digests = materialize(digests.unionByName(single))
    # one row each
    root = ended.agg(F.sum("c").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    below = nodes.agg(F.coalesce(F.sum((F.col("p") == 0).cast("int")), F.lit(0)).alias("n_children"), F.greatest(F.coalesce(F.sum((F.col("n_children") == 0).cast("int")), F.lit(0)), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("own"), F.lit(0)).alias("saved"))
    nothing = digests.where("k1 = 0 and k2 = 0").agg(F.max("ends_sha256").alias("ends_sha256"))
    top = root.join(F.broadcast(below), F.lit(True)).join(F.broadcast(nothing), F.lit(True))
    counts = ["n_convs", "n_children", "n_leaves"]

    def shaped(df: DataFrame, depth: Column, parent: Column, saved: Column) -> DataFrame:
        return df.select(F.col("conv_id"), depth.cast("long").alias("depth"), parent.alias("parent_conv_id"), *[F.col(c).cast("long").alias(c) for c in counts], saved.cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_TEXT)).alias("ends_sha256"))

    parents = nodes.select(F.col("k1").alias("pk1"), F.col("k2").alias("pk2"), F.col("conv_id").alias("parent")).unionByName(root.select(F.lit(0).cast("long").alias("pk1"), F.lit(0).cast("long").alias("pk2"), F.col("conv_id").alias("parent")))
    known = join_hot(nodes.join(digests, ["k1", "k2"], "left"), parents, ["pk1", "pk2"])
    steps = known.select(*[c for c in known.columns if c not in ("n_children", "ends_sha256")], F.col("n_children").alias("kids"), F.col("ends_sha256").alias("sha"), F.posexplode("edge").alias("i", "x"))
    last = F.col("i") == F.size("edge") - 1
    steps = steps.withColumn("n_children", F.when(last, F.col("kids")).otherwise(1)).withColumn("ends_sha256", F.when(last, F.col("sha")))
    earlier = F.expr("if(i = 0, before, edge[greatest(i, 1) - 1].words)") - F.col("before")
    expanded = shaped(steps, F.col("p") + F.col("i") + 1, F.when(F.col("i") == 0, F.col("parent")).otherwise(F.col("conv_id")), F.col("saved") - (F.col("n_convs") - 1) * earlier)
    return expanded.unionByName(shaped(top, F.lit(0), F.lit(None).cast("long"), F.col("saved")))
