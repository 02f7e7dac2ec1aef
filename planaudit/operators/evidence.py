"""Evidence of a drawing beyond its entity table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that hint at a stair, categories in their order, signals by count, limits and confidences.
DIRECTIONS = ["UP", "DN", "DOWN"]
STAIR_WORDS = r"(?<![A-Z])(STAIR|STAIRS|STAIRWAY)(?![A-Z])"
STAIR_CJK = "楼梯"
CATEGORIES = ["Room", "Door", "Corridor", "Stair", "Dimension"]
SIGNALS = {"rooms": "spatial_layout", "doors": "openings", "corridors": "horizontal_circulation", "stairs": "vertical_circulation", "dimensions": "dimension_evidence"}
PER_CATEGORY, IN_ALL = 12, 36
HINT_CONFIDENCE = {"stair_keyword": 0.70, "stair_direction": 0.62}


def confidence_band(value: Column, uncertain: Column) -> Column:
    """high, medium, low, unknown or external_or_unknown."""
    doubtful = F.coalesce(uncertain, F.lit(False))
    none = F.coalesce(value, F.lit(0.0)) <= 0
    return F.when(none, F.when(doubtful, "external_or_unknown").otherwise("unknown")).when((value >= 0.8) & ~doubtful, "high").when(value >= 0.6, "medium").otherwise("low")


def stair_hints(texts: DataFrame, stairs: DataFrame) -> DataFrame:
    """texts(run_id, text_idx, text) that name a stair or its direction, for runs without a stair entity."""
    plain = F.upper(F.trim("text"))
    bare = F.regexp_replace(plain, r"^[ .:_\-]+|[ .:_\-]+$", "")
    kind = F.when(bare.isin(DIRECTIONS), "stair_direction").when(F.col("text").contains(STAIR_CJK) | plain.rlike(STAIR_WORDS), "stair_keyword")
    rows = texts.withColumn("kind", kind).where("kind is not null").join(stairs.select("run_id"), "run_id", "left_anti")
    rows = rows.withColumn("confidence", F.when(F.col("kind") == "stair_keyword", HINT_CONFIDENCE["stair_keyword"]).otherwise(HINT_CONFIDENCE["stair_direction"]))
    at = F.row_number().over(Window.partitionBy("run_id").orderBy("text_idx"))
    return rows.withColumn("hint_id", F.concat(F.lit("vertical-text-"), at)).withColumn("band", confidence_band(F.col("confidence"), F.lit(True)))


def component_inventory(entities: DataFrame, run: str = "run_id") -> DataFrame:
    """The first entities (by id) of each category, categories in their order, and a limit over all of them.

    entities: run, entity_type, entity_id, confidence, uncertain.
    """
    place = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("entity_type"))
    rows = entities.withColumn("_place", place).where("_place > 0")
    rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy(run, "_place").orderBy("entity_id"))).where(F.col("_at") <= PER_CATEGORY)
    rows = rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(run).orderBy("_place", "_at"))).where(F.col("ordinal") <= IN_ALL)
    return rows.withColumn("band", confidence_band(F.col("confidence"), F.col("uncertain"))).drop("_place", "_at")


def merge_sheet_evidence(profile: DataFrame, sheets: DataFrame) -> DataFrame:
    """Per run the larger of the primary and the summed sheet counts, joined signals, and the raised level.

    profile: run_id, the five counts, signals (array) and level; sheets: run_id and the five counts of each sheet.
    """
    summed = sheets.groupBy("run_id").agg(*[F.sum(c).alias(f"_{c}") for c in SIGNALS])
    rows = profile.join(summed, "run_id", "left").withColumns({f"_{c}": F.coalesce(f"_{c}", F.lit(0)) for c in SIGNALS})
    found = F.array_compact(F.array(*[F.when(F.col(f"_{c}") > 0, s) for c, s in SIGNALS.items()]))
    all_found = F.when(F.size(found) > 0, F.concat(found, F.array(F.lit("per_sheet_graphs")))).otherwise(found)
    level = F.when((F.col("_rooms") > 0) & (F.col("_doors") > 0), "multi_sheet_layout_with_openings").when(F.col("_rooms") > 0, "multi_sheet_component_inventory").otherwise(F.col("level"))
    rows = rows.withColumn("signals", F.array_union(F.coalesce("signals", F.array().cast("array<string>")), all_found)).withColumn("level", level)
    return rows.withColumns({c: F.greatest(F.coalesce(c, F.lit(0)), f"_{c}") for c in SIGNALS}).drop(*[f"_{c}" for c in SIGNALS])


def author_expected(actual: DataFrame) -> DataFrame:
    """Actual (as in run_benchmark) as checks that it passes: counts above 0, texts, and one check for each distinct member."""
    none = {c: F.lit(None).cast("long").alias(c) for c in ("exact", "least", "most")}

    def check(op: str, **given: Column) -> list[Column]:
        columns = none | {"wanted": F.lit(None).cast("string").alias("wanted"), "wanted_all": F.lit(None).cast("array<string>").alias("wanted_all")} | {k: v.alias(k) for k, v in given.items()}
        return ["case_id", "name", F.lit(op).alias("op"), *columns.values()]

    counts = actual.where("value > 0").select(*check("count", exact=F.col("value")))
    texts = actual.where("text is not null").select(*check("text", wanted=F.col("text")))
    members = actual.select("case_id", "name", F.explode(F.array_distinct("members")).alias("m")).select(*check("member", wanted=F.col("m")))
    return counts.unionByName(texts).unionByName(members)
