"""Mix sources to target weights by systematic sampling.

Within a source every document expects the same number of copies. The documents
stand in a fixed order (by size, so that the sample keeps the spread of sizes);
the prefix sum of expected copies plus one offset crosses integer boundaries, and
a document is emitted once for each boundary that it crosses. The offset is drawn
at random and moved by one of 32 equal steps, the one that brings the source
nearest its target.

The prefix sum needs a document's rank in its source. No source is sorted in one
task: rows are counted in buckets of size and id range, the bucket counts are
summed up, and only a bucket is ordered. The ranges of ids are cut at quantiles, so a
source has at most 64 buckets for each size of text, and no bucket has much more than
a 64th of all rows. The table of sources is ordered in one task, as weights go by place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planaudit.llm.common import free_name, materialize

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
WORD = r"[^\x20\x09-\x0D]+"
CHUNKS = 64
DRAWS = 32


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: float = MAX_REPEATS) -> DataFrame:
    """source, source_size -> also weight and target.

    Sources in code-point order, null last, take the weights in turn. Targets share
    the sum of all sizes by weight; a target stops at `repeats` times its source's
    size and the excess is shared among the others by weight, until none is above.
    That is one level L with target = min(repeats * size, L * weight): with sources
    in order of the level at which they are full, the k smallest are full and L
    fits the rest. An all-empty input has targets 0.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    # one row per source from here on
    weighted = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    weighted = weighted.withColumn("cap", repeats * F.col("source_size").cast("double")).withColumn("full_at", F.col("cap") / F.col("weight"))
    fill = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before, after, every = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    levels = weighted.withColumn("level", (F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    levels = levels.withColumn("at", F.row_number().over(fill))
    levels = levels.withColumn("level", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("at", "level"))).over(every)["level"])
    return levels.withColumn("target", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap"))).select("source", "source_size", "weight", "target")


def offset(source: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the source and the seed only."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\x01null"))).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: float = MAX_REPEATS, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, copies and taken for every row.

    Size is the number of words (null and blank texts: 0, they take nothing). A
    null source is a source of its own. Every source is given, whatever its size;
    one source may hold any share of the rows. Rows with equal ids, or null ids
    (first), are planned one by one. The offset is drawn from the seed and the
    source, so reruns agree. Other columns are ignored, whatever their names. An
    empty table gives an empty result.
    """
    # texts are read once
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size")))
    # ranges of ids with about as many rows each; they bound the buckets and do not change the ranks
    cuts = sorted(set(rows.agg(F.percentile_approx("doc_id", [k / CHUNKS for k in range(1, CHUNKS)])).first()[0] or []))
    chunk = sum(((F.col("doc_id") > c).cast("int") for c in cuts), F.lit(0))
    rows = rows.withColumn("chunk", F.coalesce(chunk, F.lit(-1)))
    buckets = rows.groupBy("source", "size", "chunk").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    wanted = targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), weights, repeats)
    ahead = Window.partitionBy("source").orderBy("size", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).select(F.col("source").alias("s"), F.col("size").alias("c"), F.col("chunk").alias("k"), "ahead")
    inside = Window.partitionBy("source", "size", "chunk").orderBy("doc_id")
    ranked = rows.withColumn("rank", F.row_number().over(inside)).join(buckets, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("c")) & (F.col("chunk") == F.col("k")))
    ranked = ranked.select("doc_id", "source", "size", (F.col("rank") + F.col("ahead")).cast("double").alias("rank"))
    both = ranked.join(wanted.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    both = materialize(both.select("doc_id", "source", "size", "source_size", "target", "rank", rate.alias("rate"), offset(F.col("source"), seed).alias("drawn")))

    def crossed(start: Column) -> Column:
        return (F.floor(F.col("rate") * F.col("rank") + start) - F.floor(F.col("rate") * (F.col("rank") - 1) + start)).cast("long")

    def start(k: int) -> Column:
        return F.col("drawn") + k / DRAWS

    # of the offsets, the one that takes the words nearest the target
    sums = both.groupBy("source").agg(F.first("target").alias("t"), *[F.sum(crossed(start(k)) * F.col("size")).alias(f"w{k}") for k in range(DRAWS)])
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"w{k}") - F.col("t")).alias("miss"), F.lit(k).alias("k")) for k in range(DRAWS)]))["k"]
    chosen = sums.select(F.col("source").alias("s"), best.alias("k"))
    planned = both.join(chosen, F.col("source").eqNullSafe(F.col("s"))).withColumn("copies", crossed(F.col("drawn") + F.col("k") / float(DRAWS)))
    return planned.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", **options: object) -> DataFrame:
    """The rows of docs, each as often as the plan has copies of it, with its copy number from 1 in `copy`.

    A column of that name is replaced. Rows that share an id are each taken as often
    as the one of them that the plan takes most.
    """
    place, times = free_name(docs, "_id"), free_name(docs, "_copies")
    plan = plan_mix(docs, id_col=id_col, **options).groupBy(F.col("doc_id").alias(place)).agg(F.max("copies").alias(times)).where(F.col(times) > 0)
    taken = docs.join(plan, docs[id_col].eqNullSafe(F.col(place)))
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).drop(place, times)
