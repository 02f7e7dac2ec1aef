"""Loading and keeping tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Legal review statuses.
STATUSES = ["candidate", "confirmed", "rejected", "needs_info", "resolved", "superseded"]
# Classes of reviewers, and how synthetic names begin.
SYNTHETIC, INTERNAL, INDEPENDENT = "synthetic", "project_internal", "independent_third_party"
REVIEWER_CLASSES = [SYNTHETIC, INTERNAL, INDEPENDENT]
SYNTHETIC_PREFIXES = ["demo-reviewer", "smoke-runner", "synthetic-"]


def validate_knowledge(rules: DataFrame, clauses: DataFrame) -> DataFrame:
    """(problem, id): duplicate rule or clause ids, and clause references that do not resolve."""
    twice = [df.groupBy(F.col(c).alias("id")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(f"duplicate {c}").alias("problem"), "id") for df, c in ((rules, "rule_id"), (clauses, "clause_id"))]
    refs = rules.select(F.explode("source_clause_ids").alias("clause_id")).distinct().join(clauses.select("clause_id"), "clause_id", "left_anti")
    return reduce(DataFrame.unionByName, [*twice, refs.select(F.lit("unknown clause").alias("problem"), F.col("clause_id").alias("id"))])


def import_labels(rows: DataFrame, default_class: str = INTERNAL) -> tuple[DataFrame, DataFrame]:
    """Label rows with their required keys and a known class, and the rejects.

    An empty class is the default one. A synthetic name that claims to be
    independent is taken as synthetic.
    """
    rows = rows.withColumn("reviewer_class", F.coalesce(F.nullif(F.col("reviewer_class"), F.lit("")), F.lit(default_class)))
    good = F.col("issue_id").isNotNull() & F.col("reviewer_id").isNotNull() & F.col("event_type").isNotNull() & F.col("reviewer_class").isin(REVIEWER_CLASSES)
    fake = reduce(lambda a, b: a | b, [F.col("reviewer_id").startswith(p) for p in SYNTHETIC_PREFIXES])
    taken = rows.where(good).withColumn("reviewer_class", F.when(fake & (F.col("reviewer_class") == INDEPENDENT), SYNTHETIC).otherwise(F.col("reviewer_class")))
    return taken, rows.where(~good)


def table_census(tables: dict[str, DataFrame], required: list[str]) -> DataFrame:
    """Name, present and number of rows (0 if missing) of the required tables."""
    counts = [t.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("name"), F.lit(True).alias("present"), "n_rows") for n, t in tables.items() if n in required]
    spark = next(iter(tables.values())).sparkSession
    missing = [(n, False, 0) for n in required if n not in tables]
    return reduce(DataFrame.unionByName, counts + ([spark.createDataFrame(missing, "name string, present boolean, n_rows long")] if missing else []))


def upsert(base: DataFrame, updates: DataFrame, keys: list[str], order: str, created: str | None = None) -> DataFrame:
    """The row with the largest `order` of each key; updates win ties. `created`, if given, keeps its earliest value."""
    both = base.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    last = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("_new"))
    both = both.withColumn("_r", F.row_number().over(last))
    if created:
        both = both.withColumn(created, F.min(created).over(Window.partitionBy(*keys)))
    return both.where("_r = 1").drop("_r", "_new")


def ensure_dim(base: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """Base and the values it lacks, with a hashed surrogate key and whether a row is new."""
    fresh = values.select(key).where(F.col(key).isNotNull()).distinct().join(base.select(key), key, "left_anti")
    rows = base.select(key).withColumn("created", F.lit(False)).unionByName(fresh.withColumn("created", F.lit(True)))
    return rows.withColumn(f"{key}_key", F.xxhash64(key)).withColumn("prefix", F.substring_index(key, "-", 1))


def replace_partition(base: DataFrame, new: DataFrame, key: str = "run_id") -> DataFrame:
    """Rows of the keys in `new` are replaced, all others stay; loading twice changes nothing."""
    return base.join(new.select(key).distinct(), key, "left_anti").select(base.columns).unionByName(new)


def resolve_refs(issues: DataFrame, entities: DataFrame, sheets: DataFrame, rules: DataFrame) -> DataFrame:
    """U4: rule, sheet (by page) and the first entity of each issue; what is unknown is null."""
    rows = issues.withColumn("entity_id", F.try_element_at("entity_ids", F.lit(1)))
    rows = rows.join(entities.select("run_id", "entity_id", "entity_key"), ["run_id", "entity_id"], "left")
    return rows.join(sheets.select("run_id", "page_index", "sheet_id"), ["run_id", "page_index"], "left").join(rules.select("rule_id", "rule_key"), "rule_id", "left")


def propagate_confidence(issues: DataFrame, entities: DataFrame) -> DataFrame:
    """An issue's own confidence, else the largest of its entities, else null."""
    linked = issues.select("run_id", "issue_id", F.explode("entity_ids").alias("entity_id")).join(entities.select("run_id", "entity_id", F.col("confidence").alias("c")), ["run_id", "entity_id"])
    most = linked.groupBy("run_id", "issue_id").agg(F.max("c").alias("c"))
    return issues.join(most, ["run_id", "issue_id"], "left").withColumn("confidence", F.coalesce("confidence", "c")).drop("c")


def overlay_status(issues: DataFrame, states: DataFrame, keys: tuple[str, ...] = ("issue_id",)) -> DataFrame:
    """The state's status if it is legal, else candidate; keys name an issue (with a run's own ids, the run as well)."""
    both = issues.join(states.select(*keys, F.col("status").alias("_s")), list(keys), "left")
    return both.withColumn("status", F.when(F.col("_s").isin(STATUSES), F.col("_s")).otherwise("candidate")).drop("_s")


def resolve_source(profile: Column, graph: Column, label: Column) -> tuple[Column, Column]:
    """The drawing's source (profile, else graph, else run label) and a warning for the last."""
    known = F.coalesce(F.nullif(profile, F.lit("")), F.nullif(graph, F.lit("")))
    return F.coalesce(known, F.concat(F.lit("<unknown-source-for:"), label, F.lit(">"))), F.when(known.isNull(), F.lit("the artifacts name no source, so the label of the run stands in"))
