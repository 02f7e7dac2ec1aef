"""Loading run artifacts as they arrive (S1, S3 and U1 on a stream).

A stream of artifact files ends in a table of runs. Its checkpoint remembers which files were read, so a second start
reads those of new runs only; each batch merges its rows with what the table has of the same runs, so files of one run
may come in any number of batches, and a batch that is run again after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from planaudit.operators.maintain import upsert
from planaudit.sources.artifacts import located
from planaudit.sources.runs import read_runs, replace_runs
from planaudit.sources.shared import written


def artifact_stream(spark: SparkSession, root: str, kind: str, schema: str, pattern: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """One kind of artifact of all runs below root, present and to come, with run_id and parent from the path."""
    reader = spark.readStream.schema(schema).option("multiLine", pattern is None)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return located(reader, root, kind, pattern)


def merge_runs(batch: DataFrame, path: str, keys: list[str], order: str, run: str = "run_id") -> DataFrame:
    """U1 on disk: of the rows of each key, in the batch and in the table at `path`, the one with the largest `order` stays."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema)
    batch = written(batch.where(f"`{run}` is not null"))
    old = read_runs(batch.sparkSession, path, schema, run).join(batch.select(run).distinct(), run, "left_semi").select(batch.columns)
    # a batch may hold a key more than once
    return replace_runs(written(upsert(old, batch, [run, *keys], order)), path, run)


def load_new(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: str, run: str = "run_id") -> int:
    """Read what has arrived since the last start with this checkpoint, merge it into the table at `path`, and stop; the number of rows read."""
    query = stream.writeStream.foreachBatch(lambda batch, _: merge_runs(batch, path, keys, order, run)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p.numInputRows for p in query.recentProgress)
