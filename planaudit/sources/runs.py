"""Facts and reports of runs on disk, replaced run by run.

Rows lie below `<path>/rows`, one folder for each run; `<path>/loads` is the manifest: one row for each run that a load
brought, with the number of its rows and a digest of them. A load overwrites the folders of the runs that changed and of
no others, by Spark's dynamic partition overwrite, whose files are staged beside the table and moved when the whole job
is done. The manifest is written last. So a load that fails leaves the old rows in place, and the same load again finishes
it; a load of what is there already writes nothing. Loads into one path must not overlap in time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planaudit.sources.shared import written


def _found(spark: SparkSession, path: str, schema: str, fmt: str) -> DataFrame:
    try:
        return spark.read.schema(schema).format(fmt).load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def content(df: DataFrame, key: str) -> DataFrame:
    """key, n_rows and a digest of each run's rows, whatever their order; rows without a run are left out."""
    row = F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns) if c != key])))
    digest = F.concat_ws(":", F.sum(row.cast("decimal(20,0)")), F.bit_xor(row))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n_rows"), digest.alias("digest"))


def manifest(spark: SparkSession, path: str, key: str = "run_id", key_type: str = "string") -> DataFrame:
    """key, load, n_rows and digest of every run, as its latest load left it."""
    loads = _found(spark, f"{path}/loads", f"`{key}` {key_type}, load long, n_rows long, digest string, action string", "parquet")
    return loads.groupBy(key).agg(F.max_by(F.struct("load", "n_rows", "digest"), "load").alias("x")).select(key, "x.*")


def replace_runs(df: DataFrame, path: str, key: str = "run_id", runs: DataFrame | None = None, fmt: str = "parquet") -> DataFrame:
    """Put the rows of df in place of what `path` has of the same runs; key, load, n_rows, digest and action of each run.

    The action is added, replaced or unchanged. `runs`, if given, lists the runs that df is meant to cover: those of
    which it has no rows are emptied. Runs that are in neither stay as they are.
    """
    spark, kind = df.sparkSession, df.schema[key].dataType.simpleString()
    new = content(df, key)
    if runs is not None:
        new = runs.select(key).where(F.col(key).isNotNull()).distinct().join(new, key, "left")
    new = new.select(key, F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("digest", F.lit("")).alias("digest"))
    old = manifest(spark, path, key, kind).select(key, F.col("digest").alias("_was"))
    load = (_found(spark, f"{path}/loads", "load long", "parquet").agg(F.max("load")).first()[0] or 0) + 1
    action = F.when(F.col("_was").isNull(), "added").when(F.col("_was") == F.col("digest"), "unchanged").otherwise("replaced")
    state = written(new.join(old, key, "left").select(key, F.lit(load).cast("long").alias("load"), "n_rows", "digest", action.alias("action")))
    changed = state.where("action <> 'unchanged'")
    if not changed.isEmpty():
        write_report(df.join(changed.where("n_rows > 0").select(key), key, "left_semi").select(df.columns), f"{path}/rows", key, fmt)
        changed.coalesce(1).write.mode("append").parquet(f"{path}/loads")
    return state


def read_runs(spark: SparkSession, path: str, schema: str, key: str = "run_id", fmt: str = "parquet") -> DataFrame:
    """The rows of all runs that the manifest knows and that have any, with the columns of the schema in their order."""
    names = spark.createDataFrame([], schema).columns
    rows = _found(spark, f"{path}/rows", schema, fmt)
    known = manifest(spark, path, key, rows.schema[key].dataType.simpleString()).where("n_rows > 0").select(key)
    return rows.join(known, key, "left_semi").select(names)


def write_report(df: DataFrame, path: str, partition: str | None = "run_id", fmt: str = "parquet") -> None:
    """A report as a table, one folder for each run; a report of some runs leaves the folders of all others alone."""
    writer = df.write.mode("overwrite").format(fmt)
    if partition and partition in df.columns:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(partition)
    writer.save(path)
