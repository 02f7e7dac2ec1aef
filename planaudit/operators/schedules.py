"""Schedules joined to entities.

`keys` name what a schedule belongs to (a project, or a project and a run): ids, labels and pages count within them only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def apply_room_schedule(rooms: DataFrame, schedule: DataFrame, keys: list[str], properties: list[str]) -> DataFrame:
    """An entry matches by room id, else by label every such room; later non-null values win, property by property; a room without one keeps its own.

    Of the entries of one id or one label, the last value of each property meets the rooms, however many there are.
    """

    def last(rows: DataFrame, by: str, entry: Callable[[str], tuple[Column, Column]]) -> DataFrame:
        found = [F.max_by(F.struct(idx.alias("idx"), v.alias("v")), F.when(v.isNotNull(), idx)).alias(f"_{p}") for p in properties for idx, v in [entry(p)]]
        return rows.groupBy(*keys, by).agg(*found)

    def given(p: str) -> tuple[Column, Column]:
        return F.col("entry_idx"), F.col(p)

    def found(p: str) -> tuple[Column, Column]:
        return F.col(f"_{p}.idx"), F.col(f"_{p}.v")

    by_id = last(schedule.where("room_id is not null"), "room_id", given)
    by_label = last(schedule.where("room_id is null"), "label", given)
    new = by_id.unionByName(rooms.select(*keys, "room_id", "label").join(by_label, [*keys, "label"]).drop("label"))
    both = rooms.join(last(new, "room_id", found), [*keys, "room_id"], "left")
    return both.withColumns({p: F.coalesce(f"_{p}.v", p) for p in properties}).drop(*[f"_{p}" for p in properties])


def room_schedule_audit(rooms: DataFrame, schedule: DataFrame, keys: list[str], properties: list[str]) -> DataFrame:
    """Per entry of a schedule matched, unmatched or empty (matched, but no property), and the number of rooms.

    Rooms are counted by id and by label, and entries meet these counts.
    """
    entry = [*keys, "entry_idx"]
    matched = [schedule.where(named).join(rooms.groupBy(*keys, by).agg(F.count("*").alias("n")), [*keys, by]).select(*entry, "n") for by, named in (("room_id", "room_id is not null"), ("label", "room_id is null"))]
    hits = matched[0].unionByName(matched[1]).groupBy(*entry).agg(F.sum("n").alias("n"))
    bare = F.coalesce(*[F.col(p).cast("string") for p in properties]).isNull()
    rows = schedule.withColumn("_bare", bare).select(*entry, "_bare").join(hits, entry, "left")
    status = F.when(F.col("n").isNull(), "unmatched").when(F.col("_bare"), "empty").otherwise("matched")
    return rows.select(*entry, F.coalesce("n", F.lit(0)).alias("n_rooms"), status.alias("status"))


def apply_stair_schedule(stairs: DataFrame, schedule: DataFrame, keys: list[str], properties: list[str]) -> DataFrame:
    """D3: new ids become stairs; known ones are filled only where null; the first non-null entry counts.

    A new stair has confidence 0, is uncertain, has an all-zero box and the page of its
    first entry. Columns that `stairs` lacks are not added.
    """
    stair = [*keys, "stair_id"]
    values = [F.min_by(p, F.when(F.col(p).isNotNull(), F.col("entry_idx"))).alias(f"_{p}") for p in properties]
    first = schedule.groupBy(*stair).agg(*values, F.min_by("page_index", "entry_idx").alias("_page"))
    both = stairs.withColumn("_known", F.lit(True)).join(first, stair, "full")
    fresh = F.col("_known").isNull()
    box = F.struct(*[F.lit(0.0).alias(c) for c in ("x0", "y0", "x1", "y1")])
    new = {"confidence": F.lit(0.0), "uncertain": F.lit(True), "page_index": F.col("_page"), "bbox": box}
    filled = {p: F.coalesce(p, f"_{p}") for p in properties}
    rows = both.withColumns(filled | {c: F.when(fresh, v).otherwise(F.col(c)) for c, v in new.items() if c in stairs.columns})
    return rows.withColumn("materialised", fresh).drop("_known", "_page", *[f"_{p}" for p in properties])


def stair_schedule_audit(stairs: DataFrame, schedule: DataFrame, pages: DataFrame, keys: list[str], properties: list[str]) -> tuple[DataFrame, DataFrame]:
    """Per entry materialised or conflicted, and whether it has no metric; entries for unknown pages are rejects.

    The first entry of an id that is no stair yet makes one; every other entry merges
    into a stair that is there and is conflicted. Only a made stair can be empty.
    """
    stair, page = [*keys, "stair_id"], [*keys, "page_index"]
    bare = F.coalesce(*[F.col(p).cast("string") for p in properties]).isNull()
    known = stairs.select(*stair, F.lit(True).alias("_k")).distinct()
    listed = pages.select(*page).distinct()
    order = Window.partitionBy(*stair).orderBy("entry_idx")
    good = schedule.join(listed, page, "left_semi").withColumn("_bare", bare).withColumn("_at", F.row_number().over(order)).join(known, stair, "left")
    made = F.col("_k").isNull() & (F.col("_at") == 1)
    status = F.when(made, "materialised").otherwise("conflicted")
    rows = good.select(*keys, "entry_idx", "stair_id", status.alias("status"), (made & F.col("_bare")).alias("empty"))
    return rows, schedule.join(listed, page, "left_anti")
