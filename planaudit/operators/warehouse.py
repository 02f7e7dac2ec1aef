"""Cross-project questions over the issue warehouse.

Every operator takes a dict of tables: project, drawing, run, rule, clause, issue, feedback_event.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planaudit.operators.maintain import INTERNAL, SYNTHETIC, SYNTHETIC_PREFIXES

Tables = dict[str, DataFrame]


def _with_rule(t: Tables, how: str = "inner") -> DataFrame:
    return t["issue"].join(t["rule"].select("rule_key", "rule_id"), "rule_key", how)


def _with_project(t: Tables, issues: DataFrame) -> DataFrame:
    runs = t["run"].select("run_id", "project_id", "drawing_id")
    return issues.join(runs, "run_id").join(t["project"].select("project_id", "slug"), "project_id")


def issues_per_rule(t: Tables) -> DataFrame:
    """K1."""
    return _with_rule(t).groupBy("rule_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule_id")


def issues_per_project(t: Tables) -> DataFrame:
    """K2."""
    return _with_project(t, t["issue"]).groupBy("slug").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "slug")


def issues_per_status(t: Tables) -> DataFrame:
    """K3."""
    return t["issue"].groupBy("status").agg(F.count("*").alias("n")).orderBy("status")


def most_rejected_by_events(t: Tables, k: int = 3) -> DataFrame:
    """K4: rules by reject events; ties to the smaller id."""
    rejects = t["feedback_event"].where("event_type = 'reject'").groupBy("issue_id").agg(F.count("*").alias("n"))
    return _with_rule(t).join(rejects, "issue_id").groupBy("rule_id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "rule_id").limit(k)


def confirmed_issues(t: Tables) -> DataFrame:
    """K5."""
    rows = _with_project(t, _with_rule({**t, "issue": t["issue"].where("status = 'confirmed'")}))
    return rows.select("slug", "rule_id", "source_issue_id").orderBy("slug", "rule_id", "source_issue_id")


def busiest_project(t: Tables) -> DataFrame:
    """K6."""
    return issues_per_project(t).limit(1)


def most_rejected_rule(t: Tables) -> DataFrame:
    """K7: by final status."""
    return _with_rule({**t, "issue": t["issue"].where("status = 'rejected'")}).groupBy("rule_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule_id").limit(1)


def orphaned_issues(t: Tables) -> DataFrame:
    """K8: issues without an entity."""
    return t["issue"].where("entity_key is null").select(F.coalesce("source_issue_id", F.lit("")).alias("source_issue_id"), "status").orderBy("source_issue_id")


def clauses_per_rule(t: Tables) -> DataFrame:
    """K9: distinct clauses whose standard is the prefix of the rule id."""
    rules = t["rule"].select("rule_id", F.substring_index("rule_id", "-", 1).alias("standard_id"))
    return rules.join(t["clause"], "standard_id").groupBy("rule_id").agg(F.countDistinct("clause_id").alias("n_clauses")).orderBy("rule_id")


def issue_density(t: Tables) -> DataFrame:
    """Issues per page of a drawing; unknown or zero pages count as one."""
    counts = t["issue"].join(t["run"].select("run_id", "drawing_id"), "run_id").groupBy("drawing_id").agg(F.count("*").alias("c"))
    pages = F.when(F.coalesce("page_count", F.lit(0)) == 0, 1).otherwise(F.col("page_count"))
    return t["drawing"].join(counts, "drawing_id", "left").select("source_path", F.round(F.coalesce("c", F.lit(0)) / pages, 3).alias("density")).orderBy(F.desc("density"), "source_path")


def issues_by_filter(t: Tables, rule: str | None = None, status: str | None = None, project: str | None = None) -> DataFrame:
    """Issues without a rule are kept unless a rule is asked for."""
    rows = _with_project(t, _with_rule(t, "left"))
    for col, value in (("rule_id", rule), ("status", status), ("slug", project)):
        rows = rows.where(F.col(col) == value) if value is not None else rows
    return rows.select("source_issue_id", "rule_id", "status", "slug")


def heatmap(t: Tables) -> DataFrame:
    """Total and status counts of rules that have issues."""
    return _with_rule(t).groupBy("rule_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("confirmed", "rejected", "candidate")])


def project_overview(t: Tables) -> DataFrame:
    """Drawings and issues per project; projects with none are kept."""
    drawings = t["drawing"].groupBy("project_id").agg(F.count("*").alias("d"))
    issues = t["issue"].join(t["run"].select("run_id", "project_id"), "run_id").groupBy("project_id").agg(F.count("*").alias("i"))
    both = t["project"].join(drawings, "project_id", "left").join(issues, "project_id", "left")
    return both.select("slug", F.coalesce("d", F.lit(0)).alias("n_drawings"), F.coalesce("i", F.lit(0)).alias("n_issues"))


def project_drawings(t: Tables, slug: str) -> DataFrame:
    """K14, drawings."""
    return t["project"].where(F.col("slug") == slug).join(t["drawing"], "project_id").select("slug", "source_path", "page_count")


def project_issues(t: Tables, slug: str) -> DataFrame:
    """K14, issues; those without a rule are kept."""
    rows = _with_project(t, _with_rule(t, "left")).where(F.col("slug") == slug)
    return rows.select("issue_id", "source_issue_id", "rule_id", "status", "severity")


def issue_timeline(t: Tables) -> DataFrame:
    """An issue with its events in order of id (an array; empty if there are none)."""
    events = t["feedback_event"].groupBy("issue_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("e"))
    rows = _with_project(t, _with_rule(t, "left")).join(t["drawing"].select("drawing_id", "source_path"), "drawing_id", "left").join(events, "issue_id", "left")
    return rows.select("issue_id", "rule_id", "slug", "source_path", F.coalesce(F.size("e"), F.lit(0)).alias("n_events"), F.coalesce(F.array_join(F.transform("e", lambda x: x["event_type"]), ","), F.lit("")).alias("events"))


def disagreement(t: Tables) -> DataFrame:
    """Issues whose events are of more than one type, with their events in order and the class of each reviewer.

    The class is the one that the event names, else by the reviewer's name; without a
    reviewer it is unclassified.
    """
    own = F.nullif(F.col("reviewer_class"), F.lit("")) if "reviewer_class" in t["feedback_event"].columns else F.lit(None).cast("string")
    named = F.when(F.col("reviewer_id").isNull(), "unclassified").when(reduce(lambda a, b: a | b, [F.col("reviewer_id").startswith(p) for p in SYNTHETIC_PREFIXES]), SYNTHETIC).otherwise(INTERNAL)
    events = t["feedback_event"].withColumn("class", F.coalesce(own, named))
    listed = F.array_sort(F.collect_list(F.struct("event_id", "event_type", "reviewer_id", "class")))
    return events.groupBy("issue_id").agg(F.countDistinct("event_type").alias("n_types"), F.count("*").alias("n_events"), listed.alias("events")).where("n_types > 1")


def cross_check(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, duplicates counted; empty if both are equal."""
    b = b.select(a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))
