"""Shared-folder tables and distributed connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


HOT_KEYS = 1000
_own_dirs: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir or the context's checkpoint folder, or, on a local master only, a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path is not None:
        return path
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_dirs.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-"))


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back, which ends its lineage."""
    spark = df.sparkSession
    path = f"{work_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Write df, dealt by key into as many partitions, as a table of that many buckets in the shared folder and read it back.

    Joins and groups by the key need no shuffle of the table.
    """
    spark, name = df.sparkSession, f"t{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("compression", "zstd").option("path", f"{work_dir(spark).rstrip('/')}/tables/{name}").saveAsTable(name, format="parquet")
    return spark.table(name)


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores after it, so that df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without the rows whose id is in gone(doc_id); rows with a null id stay."""
    out = free_name(docs, "_gone")
    return docs.join(gone.where("doc_id is not null").select(F.col("doc_id").alias(out)).distinct(), docs[id_col] == F.col(out), "left_anti")


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """rows left join table, which has each combination of keys once, with no key shuffled that holds over a thousandth of the rows.

    There are at most 1000 such keys; their rows of the table are broadcast. The
    other rows are joined by a shuffle; those with a null key match nothing and are
    not shuffled at all. Both inputs are read twice, so they should be written tables.
    """
    full = " and ".join(f"`{k}` is not null" for k in keys)
    known = rows.where(full)
    often = known.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = often.agg(F.sum("_n").alias("_t"))
    hot = F.broadcast(often.join(F.broadcast(total), F.col("_n") * HOT_KEYS > F.col("_t")).select(*keys).limit(HOT_KEYS))
    own = F.broadcast(table.join(hot, keys, "left_semi"))
    rest = known.join(hot, keys, "left_anti").join(table, keys, "left")
    missing = rows.where(f"not coalesce({full}, false)")
    empty = [F.lit(None).cast(table.schema[c].dataType).alias(c) for c in table.columns if c not in keys]
    return known.join(hot, keys, "left_semi").join(own, keys, "left").unionByName(rest).unionByName(missing.select("*", *empty))


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Smallest reachable id of every node of an undirected graph.

    edges(a long, b long) -> (node long, component long). Alternating large-star
    and small-star rounds; each is a grouped minimum (combined before the
    shuffle) and an equi-join, so a node with very many neighbours is not
    gathered anywhere. The rounds end when all links are stars: every node has one
    link upwards, and no link leads to a node that has one. Nulls and self loops
    are ignored; nodes without an edge are not returned.
    """
    links = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = materialize(links)
    for _ in range(max_rounds):
        ends = links.select(F.col("u").alias("node"), F.col("v").alias("up"), F.lit(False).alias("root")).unionByName(links.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("up"), F.lit(True).alias("root")))
        nodes = ends.groupBy("node").agg(F.min("up").alias("low"), F.max("up").alias("high"), F.max("root").alias("root"))
        if nodes.where("low <> high or (root and low is not null)").isEmpty():
            break
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))  # a link given twice goes with the others, below
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = materialize(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    named = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return named.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def merged_components(parts: DataFrame, links: DataFrame) -> DataFrame:
    """parts(node, component), as connected_components() gives them, with more links(a long, b long) between nodes old or new.

    Only the components that a link joins go through further rounds, each as one
    node; the result is that of all links at once.
    """
    ends = [parts.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")) for c in ("a", "b")]
    between = links.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    moved = connected_components(between).select(F.col("node").alias("from"), F.col("component").alias("to"))
    old = parts.join(moved, parts["component"] == moved["from"], "left").select("node", F.coalesce("to", "component").alias("component"))
    new = moved.join(parts, moved["from"] == parts["node"], "left_anti").select(F.col("from").alias("node"), F.col("to").alias("component"))
    return materialize(old.unionByName(new))
