"""Rule posteriors kept current as feedback arrives (F2 on a stream)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def posterior_stream(events: DataFrame, delay: str = "31 days", a: float = 1.0, b: float = 1.0) -> DataFrame:
    """rule_id, confirms, rejects and mean, for update mode; state grows with the rules and the events of one delay.

    events(event_id, rule_id, event_type, ts timestamp). An event given twice within the delay counts once; one later
    than the delay is dropped.
    """
    once = events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"]).where("event_type in ('confirm', 'reject')")
    sums = once.groupBy("rule_id").agg(F.count_if(F.col("event_type") == "confirm").alias("confirms"), F.count_if(F.col("event_type") == "reject").alias("rejects"))
    return sums.withColumn("mean", (a + F.col("confirms")) / (a + b + F.col("confirms") + F.col("rejects")))
