"""Registered queries of the library's own operators, each with its oracle in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planaudit.operators import feedback as fb
from planaudit.operators import geometry as geo
from planaudit.operators import lifecycle as life
from planaudit.operators import maintain, rules, schedules, text
from planaudit.operators import warehouse as wh
from planaudit.plans.harness import oracle, table, view

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}

RULES = [
    {"rule_id": "R-ROOM-W", "applies_to": "Room", "inputs": ["width_m"], "logic_expression": "width_m >= 1.2", "output_template": "room width {width_m:.2f}", "threshold_value": 1.2, "source_clause_ids": ["C1"]},
    {"rule_id": "R-ROOM-A", "applies_to": "Room", "inputs": ["area_m2", "width_m"], "logic_expression": "width_m is not None and area_m2 / width_m >= 10", "source_clause_ids": ["C2"]},
    {"rule_id": "R-DOOR", "applies_to": "Door", "inputs": ["width_m", "slope"], "logic_expression": "0.5 <= width_m <= 2 or slope == 0", "source_clause_ids": ["C3"]},
    {"rule_id": "R-HALL", "applies_to": "Corridor", "inputs": ["mark", "slope"], "logic_expression": "mark == 'F' and not slope > 0.08", "severity": "warning", "source_clause_ids": ["C4"]},
    {"rule_id": "R-PROJ", "applies_to": "Project", "inputs": ["height_m", "height_class"], "logic_expression": "height_m > 0 and height_class != 'high'", "output_template": "height {height_m}"},
]
_FAILS = """SELECT run_id, page_index, entity_id, 'R-ROOM-W' AS rule_id, width_m AS measured_value, 'error' AS severity FROM v_entity WHERE entity_type = 'Room' AND NOT coalesce(width_m >= 1.2, false)
UNION ALL SELECT run_id, page_index, entity_id, 'R-ROOM-A', coalesce(area_m2, width_m), 'error' FROM v_entity WHERE entity_type = 'Room' AND NOT coalesce(width_m IS NOT NULL AND area_m2 / width_m >= 10, false)
UNION ALL SELECT run_id, page_index, entity_id, 'R-DOOR', coalesce(width_m, slope), 'error' FROM v_entity WHERE entity_type = 'Door' AND NOT (CASE WHEN width_m IS NULL THEN false ELSE width_m BETWEEN 0.5 AND 2 OR slope = 0 END)
UNION ALL SELECT run_id, page_index, entity_id, 'R-HALL', slope, 'warning' FROM v_entity WHERE entity_type = 'Corridor' AND NOT coalesce(mark = 'F' AND NOT slope > 0.08, false)"""


def query(name: str, sql: str | None = None, *views: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[name] = f
        if sql is not None:
            _oracles[name] = oracle(sql, *views) if views else sql
        return f

    return add


def _tables(spark: SparkSession, sf_dir: str) -> wh.Tables:
    names = {"project": "v_project", "drawing": "v_drawing", "run": "v_run", "rule": "v_rule", "clause": "v_clause", "issue": "v_issue", "feedback_event": "v_event"}
    return {k: view(spark, sf_dir, v) for k, v in names.items()}


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.evaluate(view(spark, sf_dir, "v_entity"), RULES[:4])


@query("flagship_rule_counts", f"SELECT rule_id, count(*) AS n FROM ({_FAILS}) GROUP BY rule_id", "v_entity")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(spark, sf_dir).groupBy("rule_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule_id")


query("r3_evaluate", f"SELECT * FROM ({_FAILS})", "v_entity")(lambda s, d: _issues(s, d).select("run_id", "page_index", "entity_id", "rule_id", "measured_value", "severity"))
_MESSAGE = "CASE rule_id WHEN 'R-ROOM-W' THEN CASE WHEN measured_value IS NULL THEN 'room width {width_m:.2f}' ELSE printf('room width %.2f', measured_value) END ELSE rule_id END"
_OWN_CLAUSE = "CASE rule_id WHEN 'R-ROOM-W' THEN 'C1' WHEN 'R-ROOM-A' THEN 'C2' WHEN 'R-DOOR' THEN 'C3' ELSE 'C4' END"
query(
    "r8_evidence",
    f"""SELECT f.run_id, f.page_index, entity_id, rule_id, {_OWN_CLAUSE} AS clause_id, CASE rule_id WHEN 'R-ROOM-W' THEN 1.2::DOUBLE WHEN 'R-HALL' THEN NULL ELSE r_regionkey / 10.0::DOUBLE END AS threshold_value, CASE WHEN rule_id <> 'R-HALL' THEN r_name END AS unit
    FROM ({_FAILS}) f LEFT JOIN region ON concat('C', r_regionkey) = {_OWN_CLAUSE}""",
    "v_entity",
)(
    lambda s, d: rules.resolve_evidence(_issues(s, d), table(s, d, "region").where("r_regionkey < 4").select(F.concat(F.lit("C"), "r_regionkey").alias("clause_id"), (F.col("r_regionkey") / 10).alias("threshold_value"), F.col("r_name").alias("unit"))).select("run_id", "page_index", "entity_id", "rule_id", "clause_id", "threshold_value", "unit")
)
query("r9_messages", f"SELECT run_id, entity_id, rule_id, page_index, {_MESSAGE} AS message FROM ({_FAILS})", "v_entity")(lambda s, d: _issues(s, d).select("run_id", "page_index", "entity_id", "rule_id", "message"))
query("r9_project_messages", "SELECT project_id, concat('height ', coalesce(CAST(height_m AS VARCHAR), '?')) AS message FROM v_project WHERE NOT coalesce(height_m > 0 AND height_class IS DISTINCT FROM 'high', false)", "v_project")(
    lambda s, d: rules.evaluate_projects(view(s, d, "v_project"), RULES).select("project_id", "message")
)


@query("r6_open_properties", f"SELECT run_id, page_index, entity_id, rule_id, measured_value FROM ({_FAILS}) WHERE rule_id <> 'R-HALL'", "v_entity")
def properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_entity").withColumn("properties", F.parse_json(F.to_json(F.struct("width_m", "area_m2", "slope"))))
    return rules.evaluate(rows.drop("width_m", "area_m2", "slope"), RULES[:3]).select("run_id", "page_index", "entity_id", "rule_id", "measured_value")


query("r4_evaluate_projects", "SELECT project_id, concat('project:', project_id) AS entity_id, 'R-PROJ' AS rule_id, height_m AS measured_value, 'info' AS severity FROM v_project WHERE NOT coalesce(height_m > 0 AND height_class IS DISTINCT FROM 'high', false)", "v_project")(
    lambda s, d: rules.evaluate_projects(view(s, d, "v_project"), RULES).select("project_id", "entity_id", "rule_id", "measured_value", "severity")
)


@query(
    "r1_applicable_rules",
    """SELECT DISTINCT project_id, concat('RC-', c.standard_id) AS rule_id FROM v_project p JOIN (SELECT DISTINCT standard_id, CASE standard_id WHEN 'STD0' THEN 'BUILDING' WHEN 'STD1' THEN 'MACHINERY' ELSE 'HOUSEHOLD' END AS b, CASE standard_id WHEN 'STD2' THEN 'low' END AS h FROM v_clause) c
       ON c.b = p.building_type AND (c.h IS NULL OR c.h = p.height_class)""",
    "v_project",
    "v_clause",
)
def applicable(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, cards = _knowledge(spark, sf_dir)
    return rules.applicable_rules(cards, known, view(spark, sf_dir, "v_project"))


def _knowledge(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    std = view(spark, sf_dir, "v_clause").select("standard_id").distinct()
    build = F.when(F.col("standard_id") == "STD0", "BUILDING").when(F.col("standard_id") == "STD1", "MACHINERY").otherwise("HOUSEHOLD")
    clauses = std.select(F.col("standard_id").alias("clause_id"), F.array(build).alias("applies_to_building_type"), F.when(F.col("standard_id") == "STD2", F.array(F.lit("low"))).alias("applies_to_height_class"))
    return clauses, std.select(F.concat(F.lit("RC-"), "standard_id").alias("rule_id"), F.array("standard_id").alias("source_clause_ids"))


@query(
    "r2_skip_reasons",
    """SELECT project_id, concat('RC-', c.standard_id) AS rule_id, CASE WHEN c.b <> p.building_type THEN concat(c.standard_id, ': building type ', building_type, ' not covered') ELSE concat(c.standard_id, ': height class ', coalesce(height_class, '?'), ' not covered') END AS reason
       FROM v_project p CROSS JOIN (SELECT DISTINCT standard_id, CASE standard_id WHEN 'STD0' THEN 'BUILDING' WHEN 'STD1' THEN 'MACHINERY' ELSE 'HOUSEHOLD' END AS b, CASE standard_id WHEN 'STD2' THEN 'low' END AS h FROM v_clause) c
       WHERE NOT (c.b = p.building_type AND (c.h IS NULL OR coalesce(c.h = p.height_class, false)))""",
    "v_project",
    "v_clause",
)
def skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, cards = _knowledge(spark, sf_dir)
    return rules.skip_reasons(cards, known, view(spark, sf_dir, "v_project"))


_ISSUE_ID = "substr(sha256(concat_ws(chr(31), run_id, page_index, entity_id, rule_id)), 1, 16)"
_SKIPS = "SELECT DISTINCT run_id, page_index, 'R-ROOM-W' AS rule_id, concat('a', page_index) AS reason FROM v_entity WHERE run_id % 3 = 0 UNION ALL SELECT DISTINCT run_id, page_index, 'R-DOOR', concat('b', page_index) FROM v_entity WHERE page_index % 2 = 0"


def _skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = view(spark, sf_dir, "v_entity").select("run_id", "page_index").distinct()
    one = pages.where("run_id % 3 = 0").select("*", F.lit("R-ROOM-W").alias("rule_id"), F.concat(F.lit("a"), "page_index").alias("reason"))
    return one.unionByName(pages.where("page_index % 2 = 0").select("*", F.lit("R-DOOR").alias("rule_id"), F.concat(F.lit("b"), "page_index").alias("reason")))


query(
    "r12_sheet_groups",
    f"""SELECT run_id, page_index, coalesce(n_issues, 0) AS n_issues, coalesce(issues, '') AS issues, coalesce(n_skipped, 0) AS n_skipped, coalesce(skipped, '') AS skipped FROM (SELECT DISTINCT run_id, page_index FROM v_entity) p
    LEFT JOIN (SELECT run_id, page_index, count(*) AS n_issues, string_agg({_ISSUE_ID}, ',' ORDER BY {_ISSUE_ID}) AS issues FROM ({_FAILS}) GROUP BY 1, 2) i USING (run_id, page_index)
    LEFT JOIN (SELECT run_id, page_index, count(*) AS n_skipped, string_agg(rule_id, ',' ORDER BY rule_id) AS skipped FROM ({_SKIPS}) GROUP BY 1, 2) k USING (run_id, page_index)""",
    "v_entity",
)(lambda s, d: rules.sheet_issue_groups(view(s, d, "v_entity"), _issues(s, d), _skips(s, d)).withColumns({c: F.array_join(c, ",") for c in ("issues", "skipped")}))
query("r11_skips", f"SELECT run_id, rule_id, arg_min(reason, page_index + CASE WHEN page_index = 1 THEN 1000 ELSE 0 END) AS reason FROM ({_SKIPS}) GROUP BY 1, 2", "v_entity")(
    lambda s, d: rules.merge_skips(_skips(s, d).withColumn("is_primary", F.col("page_index") == 1))
)
_INFO = {"rule_id": "R-INFO", "applies_to": "Door", "inputs": ["width_m", "mark"], "logic_expression": "width_m > 0", "severity": "info"}
_NONE = {"rule_id": "R-STAIR", "applies_to": "Stair", "inputs": ["slope"], "logic_expression": "slope > 0"}


def _readiness_sql(rule: dict) -> str:
    """One rule's rows of R14 in SQL."""
    kind = f"entity_type = '{rule['applies_to']}'"
    complete = " AND ".join([kind, *(f"{n} IS NOT NULL" for n in rule["inputs"])])
    count = lambda cond: f"count(CASE WHEN {cond} THEN 1 END)"
    absent = "concat_ws(',', " + ", ".join(f"CASE WHEN {count(f'{kind} AND {n} IS NOT NULL')} = 0 THEN '{n}' END" for n in rule["inputs"]) + ")"
    names = ",".join(rule["inputs"])
    info = "manual_only" if rule.get("severity") == "info" else "ready"
    weak = count(f"{complete} AND (slope = 0.1 OR confidence < 0.05)")
    return f"""SELECT run_id, '{rule['rule_id']}' AS rule_id, {count(kind)} AS candidates, {count(complete)} AS complete, {weak} AS weak,
    CASE WHEN {count(kind)} = 0 THEN '{names}' WHEN {absent} <> '' THEN {absent} WHEN {count(complete)} = 0 THEN '{names}' ELSE '' END AS missing,
    CASE WHEN {count(kind)} = 0 THEN 'unsupported_entity' WHEN {count(complete)} = 0 THEN 'missing_input' WHEN {weak} > 0 THEN 'low_confidence' ELSE '{info}' END AS status FROM v_entity GROUP BY run_id"""


query("r14_entity_readiness", " UNION ALL ".join(map(_readiness_sql, [*RULES[:4], _INFO, _NONE])), "v_entity")(
    lambda s, d: rules.entity_readiness(view(s, d, "v_entity").withColumn("uncertain", F.col("slope") == 0.1), [*RULES, _INFO, _NONE], least=0.05).withColumn("missing", F.array_join("missing", ","))
)
_CLIMB = {"rule_id": "R-CLIMB", "applies_to": "Project", "inputs": ["height_m", "height_class"], "logic_expression": "height_m > 0", "severity": "error", "source_clause_ids": ["C1"]}


def _project_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    has, k = F.col("project_id") % 9 != 0, F.col("project_id")
    projects = view(spark, sf_dir, "v_project").withColumn("has_meta", has).withColumns({c: F.when(has, F.col(c)) for c in ("height_m", "height_class")})
    clauses = table(spark, sf_dir, "region").where("r_regionkey < 4").select(F.concat(F.lit("C"), "r_regionkey").alias("clause_id"))
    skips = projects.where(k % 5 == 0).select("project_id", F.lit("R-CLIMB").alias("rule_id"), F.lit("x").alias("reason")).unionByName(projects.where(k % 4 == 0).select("project_id", F.lit("R-DOOR").alias("rule_id"), F.lit("x").alias("reason")))
    return rules.project_readiness(projects, [*RULES, _CLIMB], clauses, skips).withColumn("missing", F.array_join("missing", ","))


query(
    "r15_project_readiness",
    """, p AS (SELECT *, project_id % 9 <> 0 AS has FROM v_project), m AS (SELECT *, CASE WHEN NOT has THEN 'height_m,height_class' ELSE concat_ws(',', CASE WHEN height_m IS NULL THEN 'height_m' END, CASE WHEN height_class IS NULL THEN 'height_class' END) END AS missing FROM p)
    SELECT project_id, 'R-HALL' AS rule_id, 'missing_input' AS status, 'knowledge_base' AS source, 'mark,slope' AS missing FROM m
    UNION ALL SELECT project_id, 'R-DOOR', CASE WHEN has THEN 'not_applicable' ELSE 'missing_input' END, CASE WHEN has THEN 'applicability' ELSE 'project_meta' END, CASE WHEN has THEN '' ELSE 'width_m,slope' END FROM m WHERE project_id % 4 = 0
    UNION ALL SELECT project_id, 'R-PROJ', CASE WHEN missing <> '' THEN 'missing_input' ELSE 'manual_only' END, 'project_meta', missing FROM m
    UNION ALL SELECT project_id, 'R-CLIMB', CASE WHEN project_id % 5 = 0 AND has THEN 'not_applicable' WHEN missing <> '' THEN 'missing_input' ELSE 'ready' END, CASE WHEN project_id % 5 = 0 AND has THEN 'applicability' ELSE 'project_meta' END, CASE WHEN project_id % 5 = 0 AND has THEN '' ELSE missing END FROM m""",
    "v_project",
)(_project_readiness)
query("r18_domain_counts", "SELECT ordinal, value, count(issue_id) AS n FROM (VALUES (0, 'confirmed'), (1, 'rejected'), (2, 'void')) t(ordinal, value) LEFT JOIN v_issue ON status = value GROUP BY 1, 2", "v_issue")(lambda s, d: rules.domain_counts(view(s, d, "v_issue"), "status", ["confirmed", "rejected", "void"]))

_J = "v_issue i JOIN v_rule r ON i.rule_key = r.rule_key"
_P = "JOIN v_run n ON n.run_id = i.run_id JOIN v_project p ON p.project_id = n.project_id"
query("k1_issues_per_rule", f"SELECT rule_id, count(*) AS n FROM {_J} GROUP BY rule_id", "v_issue", "v_rule")(lambda s, d: wh.issues_per_rule(_tables(s, d)))
query("k2_issues_per_project", f"SELECT slug, count(*) AS n FROM v_issue i {_P} GROUP BY slug", "v_issue", "v_run", "v_project")(lambda s, d: wh.issues_per_project(_tables(s, d)))
query("k3_issues_per_status", "SELECT status, count(*) AS n FROM v_issue GROUP BY status", "v_issue")(lambda s, d: wh.issues_per_status(_tables(s, d)))
query("k4_most_rejected_events", f"SELECT r.rule_id, count(*) AS n FROM {_J} JOIN v_event e ON e.issue_id = i.issue_id WHERE event_type = 'reject' GROUP BY r.rule_id ORDER BY n DESC, r.rule_id LIMIT 3", "v_issue", "v_rule", "v_event")(lambda s, d: wh.most_rejected_by_events(_tables(s, d)))
query("k5_confirmed", f"SELECT slug, rule_id, source_issue_id FROM {_J} {_P} WHERE status = 'confirmed'", "v_issue", "v_rule", "v_run", "v_project")(lambda s, d: wh.confirmed_issues(_tables(s, d)))
query("k6_busiest_project", f"SELECT slug, count(*) AS n FROM v_issue i {_P} GROUP BY slug ORDER BY n DESC, slug LIMIT 1", "v_issue", "v_run", "v_project")(lambda s, d: wh.busiest_project(_tables(s, d)))
query("k7_most_rejected_rule", f"SELECT rule_id, count(*) AS n FROM {_J} WHERE status = 'rejected' GROUP BY rule_id ORDER BY n DESC, rule_id LIMIT 1", "v_issue", "v_rule")(lambda s, d: wh.most_rejected_rule(_tables(s, d)))
query("k8_orphans", "SELECT source_issue_id, status FROM v_issue WHERE entity_key IS NULL", "v_issue")(lambda s, d: wh.orphaned_issues(_tables(s, d)))
query("k9_clauses_per_rule", "SELECT rule_id, count(DISTINCT clause_id) AS n_clauses FROM v_rule JOIN v_clause ON standard_id = split_part(rule_id, '-', 1) GROUP BY rule_id", "v_rule", "v_clause")(lambda s, d: wh.clauses_per_rule(_tables(s, d)))
query("k10_density", "SELECT source_path, round((SELECT count(*) FROM v_issue i JOIN v_run n ON n.run_id = i.run_id WHERE n.drawing_id = d.drawing_id) / CAST(CASE WHEN coalesce(page_count, 0) = 0 THEN 1 ELSE page_count END AS DOUBLE), 3) AS density FROM v_drawing d", "v_issue", "v_run", "v_drawing")(lambda s, d: wh.issue_density(_tables(s, d)))
query("k11_filter", f"SELECT source_issue_id, rule_id, status, slug FROM v_issue i LEFT JOIN v_rule r ON r.rule_key = i.rule_key {_P} WHERE status = 'rejected'", "v_issue", "v_rule", "v_run", "v_project")(lambda s, d: wh.issues_by_filter(_tables(s, d), status="rejected"))
query("k12_heatmap", f"SELECT rule_id, count(*) AS total, count(CASE WHEN status = 'confirmed' THEN 1 END) AS confirmed, count(CASE WHEN status = 'rejected' THEN 1 END) AS rejected, count(CASE WHEN status = 'candidate' THEN 1 END) AS candidate FROM {_J} GROUP BY rule_id", "v_issue", "v_rule")(lambda s, d: wh.heatmap(_tables(s, d)))
query("k13_overview", "SELECT slug, (SELECT count(*) FROM v_drawing d WHERE d.project_id = p.project_id) AS n_drawings, (SELECT count(*) FROM v_issue i JOIN v_run n ON n.run_id = i.run_id WHERE n.project_id = p.project_id) AS n_issues FROM v_project p", "v_project", "v_drawing", "v_issue", "v_run")(lambda s, d: wh.project_overview(_tables(s, d)))
query("k14_drawings", "SELECT slug, source_path, page_count FROM v_project p JOIN v_drawing d ON d.project_id = p.project_id WHERE slug = 'Customer#000000007'", "v_project", "v_drawing")(lambda s, d: wh.project_drawings(_tables(s, d), "Customer#000000007"))
query("k14_issues", "SELECT i.issue_id, source_issue_id, rule_id, status, severity FROM v_issue i LEFT JOIN v_rule r ON r.rule_key = i.rule_key JOIN v_run n ON n.run_id = i.run_id JOIN v_project p ON p.project_id = n.project_id WHERE slug = 'Customer#000000007'", "v_issue", "v_rule", "v_run", "v_project")(
    lambda s, d: wh.project_issues(_tables(s, d), "Customer#000000007")
)
query(
    "k15_timeline",
    f"""SELECT i.issue_id, r.rule_id, slug, source_path, count(e.event_id) AS n_events, coalesce(string_agg(e.event_type, ',' ORDER BY e.event_id), '') AS events
    FROM v_issue i LEFT JOIN v_rule r ON r.rule_key = i.rule_key {_P} LEFT JOIN v_drawing d ON d.drawing_id = n.drawing_id LEFT JOIN v_event e ON e.issue_id = i.issue_id GROUP BY 1, 2, 3, 4""",
    "v_issue",
    "v_rule",
    "v_run",
    "v_project",
    "v_drawing",
    "v_event",
)(lambda s, d: wh.issue_timeline(_tables(s, d)))
query(
    "k16_disagreement",
    """SELECT issue_id, count(DISTINCT event_type) AS n_types, count(*) AS n_events, string_agg(concat_ws(':', event_id, event_type, class), ',' ORDER BY event_id) AS events FROM (
    SELECT *, CASE WHEN reviewer_class <> '' THEN reviewer_class WHEN user_id % 11 = 0 THEN 'unclassified' WHEN user_id % 5 <= 1 THEN 'synthetic' ELSE 'project_internal' END AS class FROM v_label WHERE issue_id IS NOT NULL) GROUP BY issue_id HAVING count(DISTINCT event_type) > 1""",
    "v_label",
)(
    lambda s, d: wh.disagreement({"feedback_event": view(s, d, "v_label").where("issue_id is not null").withColumn("reviewer_id", F.when(F.col("user_id") % 11 != 0, F.col("reviewer_id")))}).withColumn("events", F.array_join(F.transform("events", lambda x: F.concat_ws(":", x["event_id"].cast("string"), x["event_type"], x["class"])), ","))
)
query("k17_cross_check", "SELECT 'a' AS side, status, count(*) + 1 AS n FROM v_issue WHERE status = 'rejected' GROUP BY status UNION ALL SELECT 'b', status, count(*) FROM v_issue WHERE status = 'rejected' GROUP BY status", "v_issue")(
    lambda s, d: wh.cross_check(wh.issues_per_status(_tables(s, d)).withColumn("n", F.col("n") + (F.col("status") == "rejected").cast("long")), wh.issues_per_status(_tables(s, d)))
)

_ST = "CASE event_type WHEN 'confirm' THEN 'confirmed' WHEN 'reject' THEN 'rejected' WHEN 'needs_info' THEN 'needs_info' WHEN 'resolve' THEN 'resolved' END"
query("f1_status", f"SELECT issue_id, arg_max({_ST}, event_id) AS status FROM v_event WHERE event_type <> 'comment' GROUP BY issue_id", "v_event")(lambda s, d: fb.status_from_events(view(s, d, "v_event")))
_POST = "SELECT r.rule_id, CAST(sum(CASE WHEN event_type = 'confirm' THEN 1 ELSE 0 END) AS BIGINT) AS confirms, CAST(sum(CASE WHEN event_type = 'reject' THEN 1 ELSE 0 END) AS BIGINT) AS rejects FROM v_issue i JOIN v_rule r ON r.rule_key = i.rule_key JOIN v_event e ON e.issue_id = i.issue_id WHERE event_type IN ('confirm', 'reject') GROUP BY r.rule_id"
query("f2_posteriors", f"SELECT rule_id, confirms, rejects, 1.0::DOUBLE + confirms AS alpha, 1.0::DOUBLE + rejects AS beta, (1.0::DOUBLE + confirms) / (2.0::DOUBLE + confirms + rejects) AS mean FROM ({_POST})", "v_issue", "v_rule", "v_event")(
    lambda s, d: fb.rule_posteriors(view(s, d, "v_event"), view(s, d, "v_issue"), view(s, d, "v_rule"))
)


@query("f3_calibrate", f"SELECT issue_id, rule_id, coalesce((1.0::DOUBLE + confirms) / (2.0::DOUBLE + confirms + rejects), confidence) AS confidence FROM v_issue i LEFT JOIN v_rule r ON r.rule_key = i.rule_key LEFT JOIN ({_POST}) USING (rule_id)", "v_issue", "v_rule", "v_event")
def calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues, known = view(spark, sf_dir, "v_issue"), view(spark, sf_dir, "v_rule")
    named = issues.join(known, "rule_key", "left")
    return fb.calibrate(named, fb.rule_posteriors(view(spark, sf_dir, "v_event"), issues, known))[0].select("issue_id", "rule_id", "confidence")


_BINS = """SELECT *, confirmed + rejected AS n, (low + least(high, 1.0::DOUBLE)) / 2 AS middle FROM (SELECT bin, low, high, CAST(coalesce(sum(c), 0) AS BIGINT) AS confirmed, CAST(coalesce(sum(r), 0) AS BIGINT) AS rejected
    FROM (VALUES (0, 0.0::DOUBLE, 0.2::DOUBLE), (1, 0.2::DOUBLE, 0.4::DOUBLE), (2, 0.4::DOUBLE, 0.6::DOUBLE), (3, 0.6::DOUBLE, 0.8::DOUBLE), (4, 0.8::DOUBLE, 1.001::DOUBLE)) b(bin, low, high)
    LEFT JOIN (SELECT confidence, CASE WHEN event_type = 'confirm' THEN 1 ELSE 0 END AS c, CASE WHEN event_type = 'reject' THEN 1 ELSE 0 END AS r FROM v_issue JOIN v_event USING (issue_id)) i
    ON confidence >= low AND confidence < high GROUP BY 1, 2, 3)"""
_RELIABILITY = f"SELECT bin, low, high, n, confirmed, rejected, precision, abs(middle - precision) AS deviation, n >= {{least}} AS used FROM (SELECT *, CASE WHEN n > 0 THEN confirmed / CAST(n AS DOUBLE) ELSE 0.0::DOUBLE END AS precision FROM ({_BINS}))"
_MEAN_DEVIATION = f"SELECT CASE WHEN count(CASE WHEN used THEN 1 END) > 0 THEN 'ok' ELSE 'no_bin_with_enough_samples' END AS status, count(CASE WHEN used THEN 1 END) AS bins_used, round(avg(CASE WHEN used THEN deviation END), 4) AS mean_abs_deviation FROM ({_RELIABILITY})"
query("f4_reliability", _RELIABILITY.format(least=5), "v_issue", "v_event")(lambda s, d: fb.reliability(view(s, d, "v_issue"), view(s, d, "v_event")))
query("f4_mean_deviation", _MEAN_DEVIATION.format(least=5), "v_issue", "v_event")(lambda s, d: fb.mean_deviation(fb.reliability(view(s, d, "v_issue"), view(s, d, "v_event"))))
query("f4_no_bin", _MEAN_DEVIATION.format(least=1000000), "v_issue", "v_event")(lambda s, d: fb.mean_deviation(fb.reliability(view(s, d, "v_issue"), view(s, d, "v_event"), min_n=1000000)))
_QUALITY = """SELECT rule_id, detected, expected, tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) END AS precision, CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) END AS recall FROM (
    SELECT *, CASE WHEN expected IS NOT NULL THEN greatest(0, expected - detected) END AS fn FROM (
    SELECT r.rule_id, count(DISTINCT i.issue_id) AS detected, CASE WHEN r.rule_id <> 'STD2-1' THEN 5000::BIGINT END AS expected, count(CASE WHEN event_type = 'confirm' THEN 1 END) AS tp, count(CASE WHEN event_type = 'reject' THEN 1 END) AS fp
    FROM v_issue i JOIN v_rule r ON r.rule_key = i.rule_key LEFT JOIN v_event e ON e.issue_id = i.issue_id GROUP BY r.rule_id))"""
_TOTALS = f"SELECT round(sum(precision * (tp + fp)) / sum(CASE WHEN tp + fp > 0 THEN tp + fp END), 4) AS weighted_precision, round(sum(recall * tp) / sum(CASE WHEN tp > 0 AND recall IS NOT NULL THEN tp END), 4) AS weighted_recall, count(CASE WHEN tp + fp > 0 THEN 1 END) AS rules_with_precision, count(CASE WHEN tp > 0 THEN recall END) AS rules_with_recall FROM ({_QUALITY})"


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = view(spark, sf_dir, "v_rule")
    return fb.rule_quality(view(spark, sf_dir, "v_issue"), view(spark, sf_dir, "v_event"), known, known.where("rule_id <> 'STD2-1'").select("rule_id", F.lit(5000).cast("long").alias("n")))


query("f5_rule_quality", _QUALITY, "v_issue", "v_rule", "v_event")(_quality)
query("f5_totals", _TOTALS, "v_issue", "v_rule", "v_event")(lambda s, d: fb.quality_totals(_quality(s, d)))
query(
    "f7_running_posterior",
    """SELECT rule_id, event_id, mean, mean < lag(mean) OVER (PARTITION BY rule_id ORDER BY event_id) AS fell FROM (SELECT rule_id, event_id, (1.0::DOUBLE + sum(CASE WHEN event_type = 'confirm' THEN 1 ELSE 0 END) OVER w) / (2.0::DOUBLE + count(*) OVER w) AS mean
    FROM v_event WHERE event_type IN ('confirm', 'reject') WINDOW w AS (PARTITION BY rule_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))""",
    "v_event",
)(lambda s, d: fb.running_posterior(view(s, d, "v_event")))
_FAKE = "user_id % 5 <= 2"
query("f8_reviewer_class", f"SELECT user_id, CASE WHEN {_FAKE} AND user_id % 3 <> 1 THEN 'synthetic' WHEN user_id % 3 = 0 THEN 'independent_third_party' ELSE 'project_internal' END AS class FROM (SELECT DISTINCT user_id FROM events)")(
    lambda s, d: fb.classify_reviewers(view(s, d, "v_reviewer")).select("user_id", "class")
)
_LABELS = f"""SELECT event_id, CASE WHEN user_id % 11 = 0 THEN '<unknown>' ELSE reviewer_id END AS reviewer_id, CASE WHEN event_id % 6 = 0 THEN 'independent_third_party' WHEN event_id % 6 = 1 THEN 'project_internal' WHEN event_id % 6 IN (2, 3) THEN 'synthetic'
    WHEN {_FAKE} AND user_id % 11 <> 0 THEN 'synthetic' ELSE 'project_internal' END AS class, CASE WHEN event_id % 2 = 0 THEN 'seen' ELSE '' END AS note FROM v_label WHERE is_label"""


def _labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = view(spark, sf_dir, "v_label")
    payload = F.struct(F.col("is_label").alias("instance_label"), "reviewer_class", F.when(F.col("event_id") % 2 == 0, "seen").alias("note"))
    return rows.withColumn("payload", F.parse_json(F.to_json(payload))), view(spark, sf_dir, "v_reviewer").where("user_id % 11 <> 0").select("reviewer_id")


query("f9_instance_labels", _LABELS, "v_label")(lambda s, d: fb.instance_labels(*_labelled(s, d)).select("event_id", "reviewer_id", "class", "note"))
query(
    "f10_provenance",
    f"""SELECT p.*, l.*, project_internal_reviewer_count + independent_third_party_reviewer_count AS instance_label_reviewer_count, synthetic_reviewer_count / CAST(people AS DOUBLE) AS synthetic_label_share,
    instance_label_event_count / CAST(events AS DOUBLE) AS human_validated_share, independent_third_party_reviewer_count > 0 AS any_independent_review FROM (SELECT count(*) AS people, count(CASE WHEN {_FAKE} THEN 1 END) AS synthetic_reviewer_count FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 11 <> 0)) p,
    (SELECT count(DISTINCT CASE WHEN class = 'project_internal' THEN reviewer_id END) AS project_internal_reviewer_count, count(DISTINCT CASE WHEN class = 'independent_third_party' THEN reviewer_id END) AS independent_third_party_reviewer_count, count(*) AS instance_label_event_count FROM ({_LABELS})) l,
    (SELECT count(*) AS events FROM v_label) e""".replace("SELECT p.*, l.*,", "SELECT synthetic_reviewer_count, project_internal_reviewer_count, independent_third_party_reviewer_count, instance_label_event_count,"),
    "v_label",
)(lambda s, d: fb.label_provenance(*_labelled(s, d)))

_CASES = "SELECT DISTINCT run_id AS case_id, entity_type AS rule_id FROM v_entity WHERE width_m > 1.5"
_FOUND = "SELECT DISTINCT run_id AS case_id, entity_type AS rule_id FROM v_entity WHERE slope > 0.04"
_SCORED = f"SELECT coalesce(e.case_id, a.case_id) AS case_id, coalesce(e.rule_id, a.rule_id) AS rule_id, CASE WHEN e.case_id IS NULL THEN 'fp' WHEN a.case_id IS NULL THEN 'fn' ELSE 'tp' END AS outcome FROM ({_CASES}) e FULL JOIN ({_FOUND}) a ON a.case_id = e.case_id AND a.rule_id = e.rule_id"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = view(spark, sf_dir, "v_entity").withColumnRenamed("run_id", "case_id").withColumnRenamed("entity_type", "rule_id")
    return fb.score_cases(e.where("width_m > 1.5"), e.where("slope > 0.04"))


query("f11_score_cases", _SCORED, "v_entity")(_scored)
query("f12_scoreboard", f"SELECT rule_id, tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) END AS precision, CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) END AS recall, 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) AS f1 FROM (SELECT rule_id, count(CASE WHEN outcome = 'tp' THEN 1 END) AS tp, count(CASE WHEN outcome = 'fp' THEN 1 END) AS fp, count(CASE WHEN outcome = 'fn' THEN 1 END) AS fn FROM ({_SCORED}) GROUP BY ROLLUP (rule_id))", "v_entity")(
    lambda s, d: fb.scoreboard(_scored(s, d))
)
query("f13_fire_rates", f"SELECT t.rule_id, count(DISTINCT run_id) AS cases, count(run_id) AS findings, count(DISTINCT run_id) / 1000.0::DOUBLE AS rate, count(run_id) / 1000.0::DOUBLE AS mean_per_case FROM (VALUES ('R-ROOM-W'), ('R-DOOR'), ('R-NONE')) t(rule_id) LEFT JOIN ({_FAILS}) f ON f.rule_id = t.rule_id GROUP BY t.rule_id", "v_entity")(
    lambda s, d: fb.fire_rates(_issues(s, d).withColumnRenamed("run_id", "case_id"), s.createDataFrame([("R-ROOM-W",), ("R-DOOR",), ("R-NONE",)], "rule_id string"), 1000)
)
_TIERS = {"R-ROOM-W": "AUTODETECTABLE", "R-ROOM-A": "AUTODETECTABLE", "R-HALL": "PARTIAL_AUTODETECT"}
_CLAUSE = "CASE rule_id WHEN 'R-ROOM-W' THEN 'C1' WHEN 'R-ROOM-A' THEN 'C2' WHEN 'R-DOOR' THEN 'C3' ELSE 'C4' END"
query(
    "f14_issue_metrics",
    f""", f AS (SELECT *, {_CLAUSE} AS clause_id FROM ({_FAILS})), t AS (SELECT CAST(count(*) AS DOUBLE) AS total FROM f),
    r AS (SELECT rule_id, count(*) AS n, CASE rule_id WHEN 'R-HALL' THEN 'PARTIAL_AUTODETECT' WHEN 'R-DOOR' THEN 'UNKNOWN' ELSE 'AUTODETECTABLE' END AS tier FROM f GROUP BY 1 ORDER BY n DESC, rule_id LIMIT 3)
    SELECT 'severity' AS section, v AS key, count(f.severity) AS n, 100.0::DOUBLE * count(f.severity) / max(total) AS percent, NULL AS tier FROM (VALUES ('error'), ('warning'), ('info'), ('other')) s(v) LEFT JOIN f ON f.severity = v CROSS JOIN t GROUP BY v
    UNION ALL SELECT 'rule', rule_id, n, 100.0::DOUBLE * n / total, tier FROM r CROSS JOIN t UNION ALL SELECT 'tier', tier, count(*), 100.0::DOUBLE * count(*) / max(total), tier FROM r CROSS JOIN t GROUP BY tier
    UNION ALL SELECT * FROM (SELECT 'clause', clause_id, count(*) AS n, NULL, NULL FROM f GROUP BY 2 ORDER BY n DESC, clause_id LIMIT 3)""",
    "v_entity",
)(lambda s, d: fb.issue_metrics(_issues(s, d), s.createDataFrame(list(_TIERS.items()), "rule_id string, tier string"), 3))
query("f15_clause_refs", f"SELECT CASE rule_id WHEN 'R-ROOM-W' THEN 'C1' WHEN 'R-ROOM-A' THEN 'C2' WHEN 'R-DOOR' THEN 'C3' ELSE 'C4' END AS clause_id, count(*) AS n, NULL AS text FROM ({_FAILS}) GROUP BY 1 ORDER BY n DESC, clause_id LIMIT 2", "v_entity")(
    lambda s, d: fb.clause_refs(_issues(s, d), s.createDataFrame([], "clause_id string, clause_text string"), 2)
)
_SUITES = """SELECT severity AS suite, CASE WHEN severity LIKE '4%' OR severity LIKE '5%' AND issue_id % 2 = 0 THEN 'generated_x' WHEN severity LIKE '1%' THEN 'toy' ELSE 'real_x' END AS fixture_kind,
    CASE WHEN severity LIKE '1%' AND issue_id % 31 = 0 THEN 'fail' WHEN severity LIKE '2%' AND issue_id % 29 = 0 THEN 'known_gap' WHEN severity LIKE '3%' AND issue_id % 23 = 0 THEN 'pending' ELSE 'pass' END AS status FROM v_issue"""
_HELD = """SELECT DISTINCT severity AS suite, concat('a', CAST(r_regionkey AS VARCHAR(20))) AS artifact, CASE WHEN r_regionkey % 2 = 0 THEN 'core' ELSE 'evidence' END AS tier,
    NOT (severity LIKE '1%' AND r_regionkey < 3 OR severity LIKE '2%' AND r_regionkey = 1) AS available FROM v_issue CROSS JOIN region WHERE severity NOT LIKE '3%'"""
_GATE = f""", c AS ({_SUITES}), h AS ({_HELD}), g AS (SELECT suite, count(CASE WHEN status = 'fail' THEN 1 END) AS failed, count(CASE WHEN status IN ('pass', 'fail') THEN 1 END) AS active, count(CASE WHEN status = 'pending' THEN 1 END) AS pending, count(CASE WHEN status = 'known_gap' THEN 1 END) AS gaps,
    count(CASE WHEN status = 'pass' AND fixture_kind LIKE 'real%' THEN 1 END) AS real, count(CASE WHEN status = 'pass' AND fixture_kind LIKE 'generated%' THEN 1 END) AS generated FROM c GROUP BY 1),
    m AS (SELECT suite, coalesce(string_agg(CASE WHEN tier = 'core' AND NOT available THEN artifact END, ',' ORDER BY artifact), '') AS core, coalesce(string_agg(CASE WHEN tier = 'evidence' AND NOT available THEN artifact END, ',' ORDER BY artifact), '') AS evidence FROM h GROUP BY 1),
    k AS (SELECT suite, 'suite:active-pass' AS check_id, failed = 0 AS passed, 'blocker' AS severity, '' AS missing FROM g UNION ALL SELECT suite, 'suite:active-count', active >= 1, 'blocker', '' FROM g UNION ALL SELECT suite, 'suite:real-active', real >= 1, 'blocker', '' FROM g
    UNION ALL SELECT suite, 'suite:known-gaps', gaps = 0, 'warning', '' FROM g UNION ALL SELECT suite, 'suite:pending', pending = 0, 'warning', '' FROM g UNION ALL SELECT suite, 'suite:generated-not-proxy', generated <= real, 'warning', '' FROM g
    UNION ALL SELECT suite, 'run:core-artifacts', core = '', 'blocker', core FROM m UNION ALL SELECT suite, 'run:evidence-artifacts', evidence = '', 'warning', evidence FROM m
    UNION ALL SELECT suite, 'run:representative-run', false, 'warning', '' FROM g WHERE suite NOT IN (SELECT suite FROM m))"""


def _gate(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    view(spark, sf_dir, "v_issue").createOrReplaceTempView("v_issue")
    table(spark, sf_dir, "region").createOrReplaceTempView("region")
    return fb.release_gate(spark.sql(_SUITES), spark.sql(_HELD))


query("f16_checks", _GATE + " SELECT * FROM k", "v_issue")(lambda s, d: _gate(s, d)[0].withColumn("missing", F.array_join("missing", ",")))
query(
    "f16_release_gate",
    _GATE + " SELECT *, CASE WHEN blockers > 0 THEN 'not_ready' WHEN warnings > 0 THEN 'demo_ready_with_known_gaps' ELSE 'evidence_ready' END AS status FROM (SELECT suite, count(CASE WHEN NOT passed AND severity = 'blocker' THEN 1 END) AS blockers, count(CASE WHEN NOT passed AND severity = 'warning' THEN 1 END) AS warnings FROM k GROUP BY 1)",
    "v_issue",
)(lambda s, d: _gate(s, d)[1])
_WEAKEST = "SELECT least(sum(score), min(score) * count(*)) / (10 * count(*)) * 100 AS overall, arg_min(name, score) AS weakest, min(score) >= 9 AND count(CASE WHEN score = 10 THEN 1 END) >= greatest(1, round_even(0.75 * count(*), 0)) AS at_99 FROM (SELECT severity AS name, {score} AS score FROM v_issue GROUP BY severity)"
query("f17_weakest_link", _WEAKEST.format(score="avg(confidence) * 10"), "v_issue")(
    lambda s, d: fb.weakest_link(view(s, d, "v_issue").groupBy(F.col("severity").alias("name")).agg((F.avg("confidence") * 10).alias("score")))
)
query("f17_at_99", _WEAKEST.format(score="max(CASE WHEN severity LIKE '1%' THEN 9.5 ELSE 10.0 END::DOUBLE)"), "v_issue")(
    lambda s, d: fb.weakest_link(view(s, d, "v_issue").groupBy(F.col("severity").alias("name")).agg(F.max(F.when(F.col("severity").startswith("1"), 9.5).otherwise(10.0)).alias("score")))
)


def _figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row with the figures of all dimensions."""
    issues, events = view(spark, sf_dir, "v_issue"), view(spark, sf_dir, "v_event")
    provenance = fb.label_provenance(*_labelled(spark, sf_dir))
    bonus = fb.label_bonus(F.col("independent_third_party_reviewer_count"), F.col("project_internal_reviewer_count"), F.col("instance_label_event_count"))
    counts = table(spark, sf_dir, "part").agg(F.count_if(F.col("p_size") > 48).alias("n_real_cases"), F.count_if(F.col("p_size") > 10).alias("n_runs"), F.count("*").alias("n_expected_runs"))
    rows = fb.mean_deviation(fb.reliability(issues, events))
    for one in (fb.quality_totals(_quality(spark, sf_dir)), provenance.select(bonus.alias("bonus")), counts, _quality(spark, sf_dir).agg(F.count("*").alias("n_rules"))):
        # tables of one row each
        rows = rows.join(F.broadcast(one), F.lit(True))
    return rows


query(
    "f18_dimensions",
    f""", m AS ({_MEAN_DEVIATION.format(least=5)}), q AS ({_TOTALS}), l AS ({_LABELS}),
    b AS (SELECT CASE WHEN count(CASE WHEN class = 'independent_third_party' THEN 1 END) > 0 AND count(*) >= 50 THEN 1.0::DOUBLE WHEN count(CASE WHEN class = 'project_internal' THEN 1 END) > 0 AND count(*) >= 10 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS bonus FROM l),
    c AS (SELECT CAST(count(CASE WHEN p_size > 48 THEN 1 END) AS DOUBLE) AS real_cases, CAST(count(CASE WHEN p_size > 10 THEN 1 END) AS DOUBLE) AS runs, CAST(count(*) AS DOUBLE) AS every FROM part)
    SELECT 'calibration' AS name, CASE WHEN bins_used >= 3 THEN greatest(0.0::DOUBLE, least(10.0::DOUBLE, 10.0::DOUBLE * (0.2::DOUBLE - mean_abs_deviation) / (0.2::DOUBLE - 0.04::DOUBLE))) ELSE 0.0::DOUBLE END AS score, bins_used >= 3 AS measurable FROM m
    UNION ALL SELECT 'recognition_quality', least(10.0::DOUBLE, 4.5::DOUBLE * least(1.0::DOUBLE, weighted_precision / 0.85::DOUBLE) + 4.5::DOUBLE * least(1.0::DOUBLE, weighted_recall / 0.75::DOUBLE) + bonus), true FROM q, b
    UNION ALL SELECT 'real_pdf_breadth', 10.0::DOUBLE * least(1.0::DOUBLE, real_cases / 15.0::DOUBLE), true FROM c UNION ALL SELECT 'kg_coverage', 10.0::DOUBLE * least(1.0::DOUBLE, runs / every), true FROM c""",
    "v_issue",
    "v_event",
    "v_rule",
    "v_label",
)(lambda s, d: fb.score_dimensions(_figures(s, d)))
query("f18_score_curve", "SELECT issue_id, CASE WHEN confidence IS NULL THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(10.0::DOUBLE, 10.0::DOUBLE * (0.2::DOUBLE - confidence) / (0.2::DOUBLE - 0.04::DOUBLE))) END AS score FROM v_issue", "v_issue")(lambda s, d: view(s, d, "v_issue").select("issue_id", fb.score_curve(F.col("confidence"), 0.04, 0.2).alias("score")))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")


query("u1_upsert", "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 1 END AS ver FROM orders")(
    lambda s, d: maintain.upsert(_orders(s, d).withColumn("ver", F.lit(1)), _orders(s, d).where("o_orderkey % 7 = 0").select("o_orderkey", "o_custkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit(2).alias("ver")), ["o_orderkey"], "ver")
)
query("u2_ensure_dim", "SELECT DISTINCT p_brand, p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 50) AS created FROM part")(lambda s, d: maintain.ensure_dim(table(s, d, "part").where("p_size = 50").select("p_brand").distinct(), table(s, d, "part"), "p_brand").select("p_brand", "created"))
query("u3_replace", "SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 5 = 0 THEN 0.0::DOUBLE ELSE o_totalprice END AS o_totalprice FROM orders")(lambda s, d: maintain.replace_partition(_orders(s, d), _orders(s, d).where("o_custkey % 5 = 0").withColumn("o_totalprice", F.lit(0.0)), "o_custkey"))
query("u6_overlay", "SELECT issue_id, CASE WHEN issue_id % 2 = 0 THEN status ELSE 'candidate' END AS status FROM v_issue", "v_issue")(
    lambda s, d: maintain.overlay_status(view(s, d, "v_issue").select("issue_id"), view(s, d, "v_issue").select("issue_id", F.when(F.col("issue_id") % 2 == 0, F.col("status")).otherwise("odd").alias("status"))).select("issue_id", "status")
)
query("s8_census", "SELECT 'orders' AS name, true AS present, count(*) AS n_rows FROM orders UNION ALL SELECT 'part', true, count(*) FROM part UNION ALL SELECT 'edge', false, 0")(lambda s, d: maintain.table_census({"orders": table(s, d, "orders"), "part": table(s, d, "part")}, ["orders", "part", "edge"]))
query("s4_validate", "SELECT 'duplicate rule_id' AS problem, p_name AS id FROM part GROUP BY p_name HAVING count(*) > 1 UNION ALL SELECT DISTINCT 'unknown clause', p_brand FROM part WHERE p_brand >= 'Brand#3'")(
    lambda s, d: maintain.validate_knowledge(table(s, d, "part").select(F.col("p_name").alias("rule_id"), F.array("p_brand").alias("source_clause_ids")), table(s, d, "part").where("p_brand < 'Brand#3'").select(F.col("p_brand").alias("clause_id")).distinct())
)

def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, k = _orders(spark, sf_dir), F.col("o_orderkey")
    # noise below the fourth place is no change
    price = F.when(k % 10 == 1, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice") + 0.00001)
    after = before.withColumn("o_totalprice", F.when(k % 10 == 0, F.col("o_totalprice")).otherwise(price)).withColumn("o_orderkey", F.when(k % 10 == 0, -1 - k).otherwise(k))
    rows = life.diff_runs(before, after, ["o_orderkey"], ["o_custkey", "o_totalprice"])
    return rows.select("group_key", "occurrence", F.col("before.o_totalprice").alias("before_price"), F.col("after.o_totalprice").alias("after_price"), "status", F.array_join("changed", ",").alias("changed"))


query(
    "l1_diff_runs",
    """SELECT substr(sha256('{"o_orderkey":' || o_orderkey || '}'), 1, 16) AS group_key, 1 AS occurrence, o_totalprice AS before_price, CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 10 = 1 THEN o_totalprice + 1 ELSE o_totalprice END AS after_price,
    CASE WHEN o_orderkey % 10 = 0 THEN 'resolved' WHEN o_orderkey % 10 = 1 THEN 'changed' ELSE 'unchanged' END AS status, CASE WHEN o_orderkey % 10 = 1 THEN 'o_totalprice' ELSE '' END AS changed FROM orders
    UNION ALL SELECT substr(sha256('{"o_orderkey":' || (-1 - o_orderkey) || '}'), 1, 16), 1, NULL, o_totalprice, 'new', '' FROM orders WHERE o_orderkey % 10 = 0""",
)(_diff)
_AT, _LATER = "2024-01-01 00:00:00", "2025-01-01 00:00:00"


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {"reviewer": F.lit("x"), "note": F.concat(F.lit("n"), "issue_id"), "target_run": F.when(F.col("status") == "superseded", "r2"), "created_at": F.lit(_AT).cast("timestamp")}
    return view(spark, sf_dir, "v_issue").select("issue_id", "status").withColumns(columns)


query(
    "l4_build_state",
    f"""SELECT issue_id, CASE WHEN issue_id % 3 = 0 THEN status ELSE 'candidate' END AS status, CASE WHEN issue_id % 3 = 0 THEN 'x' END AS reviewer, CASE WHEN issue_id % 3 = 0 THEN concat('n', issue_id) END AS note,
    CASE WHEN issue_id % 3 = 0 AND status = 'superseded' THEN 'r2' END AS target_run, CASE WHEN issue_id % 3 <> 0 THEN 'r7' END AS source_run, CASE WHEN issue_id % 3 = 0 THEN '{_AT}' ELSE '{_LATER}' END AS created_at, '{_LATER}' AS updated_at FROM v_issue""",
    "v_issue",
)(
    lambda s, d: life.build_state(view(s, d, "v_issue"), _state(s, d).where("issue_id % 3 = 0").unionByName(_state(s, d).withColumn("issue_id", -1 - F.col("issue_id"))), F.lit(_LATER).cast("timestamp"), "r7").withColumns({c: F.col(c).cast("string") for c in ("created_at", "updated_at")})
)


def _transitions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("issue_id") % 7
    rows = view(spark, sf_dir, "v_issue").select(F.when(k == 6, -F.col("issue_id")).otherwise(F.col("issue_id")).alias("issue_id"), k.alias("k"))
    k = F.col("k")
    status = F.when(k == 1, " Open ").when(k.isin(2, 3), "superseded").when(k == 5, "odd").otherwise("resolved")
    updates = rows.select("issue_id", status.alias("status"), F.when(k == 2, "r9").when(k == 4, "r8").alias("target_run"), F.when(k == 0, "new").alias("reviewer"), F.when(k == 1, "").alias("note"), F.lit(_LATER).cast("timestamp").alias("at"))
    older = rows.where("k = 0").select("issue_id", F.lit("confirmed").alias("status"), F.lit(None).cast("string").alias("target_run"), F.lit("older").alias("reviewer"), F.lit("older").alias("note"), F.lit(_AT).cast("timestamp").alias("at"))
    return life.apply_transitions(_state(spark, sf_dir), updates.unionByName(older))


query(
    "l5_transitions",
    f"""SELECT issue_id, CASE WHEN k = 0 THEN 'resolved' WHEN k = 1 THEN 'candidate' WHEN k = 2 THEN 'superseded' ELSE status END AS status, CASE WHEN k = 2 THEN 'r9' WHEN k > 2 AND status = 'superseded' THEN 'r2' END AS target_run,
    CASE WHEN k = 0 THEN 'new' ELSE 'x' END AS reviewer, CASE WHEN k = 0 THEN 'older' WHEN k <> 1 THEN concat('n', issue_id) END AS note, CASE WHEN k <= 2 THEN '{_LATER}' END AS updated_at FROM (SELECT *, issue_id % 7 AS k FROM v_issue)""",
    "v_issue",
)(lambda s, d: _transitions(s, d)[0].select("issue_id", "status", "target_run", "reviewer", "note", F.col("updated_at").cast("string").alias("updated_at")))
query("l5_rejects", "SELECT CASE WHEN k = 6 THEN -issue_id ELSE issue_id END AS issue_id, CASE k WHEN 3 THEN 'no target run' WHEN 4 THEN 'unexpected target run' WHEN 5 THEN 'unknown status' ELSE 'unknown issue' END AS reason FROM (SELECT *, issue_id % 7 AS k FROM v_issue) WHERE k > 2", "v_issue")(
    lambda s, d: _transitions(s, d)[1].select("issue_id", "reason")
)
# review states of runs that use the same ids
_OWN = "SELECT run_id, issue_id // 200 AS issue_id, status FROM v_issue"
_RUN_ISSUE = ("run_id", "issue_id")


def _own_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_issue").select("run_id", F.floor(F.col("issue_id") / 200).alias("issue_id"), "status")


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of the even runs."""
    return _own_ids(spark, sf_dir).where("run_id % 2 = 0").withColumn("reviewer", F.concat(F.lit("r"), "run_id"))


query("u6_overlay_of_runs", f"SELECT run_id, issue_id, CASE WHEN run_id % 2 = 0 THEN status ELSE 'candidate' END AS status FROM ({_OWN})", "v_issue")(
    lambda s, d: maintain.overlay_status(_own_ids(s, d).drop("status"), _decided(s, d), _RUN_ISSUE).select("run_id", "issue_id", "status")
)
query(
    "l4_state_of_runs",
    f"SELECT run_id, issue_id, CASE WHEN run_id % 2 = 0 THEN status ELSE 'candidate' END AS status, CASE WHEN run_id % 2 = 0 THEN concat('r', run_id) END AS reviewer FROM ({_OWN})",
    "v_issue",
)(lambda s, d: life.build_state(_own_ids(s, d), _decided(s, d), F.lit(_LATER).cast("timestamp"), keys=_RUN_ISSUE).select("run_id", "issue_id", "status", "reviewer"))
query(
    "l5_transitions_of_runs",
    f"SELECT run_id, issue_id, CASE WHEN run_id % 4 = 0 AND issue_id % 2 = 0 THEN 'resolved' ELSE status END AS status FROM ({_OWN}) WHERE run_id % 2 = 0",
    "v_issue",
)(
    lambda s, d: life.apply_transitions(
        _decided(s, d), _own_ids(s, d).where("run_id % 4 = 0 and issue_id % 2 = 0").select("run_id", "issue_id", F.lit("resolved").alias("status"), F.lit(_LATER).cast("timestamp").alias("at")), _RUN_ISSUE
    )[0].select("run_id", "issue_id", "status")
)
query("l6_summary_of_runs", "SELECT run_id, status, count(*) AS n FROM v_issue GROUP BY 1, 2", "v_issue")(lambda s, d: life.state_summary(view(s, d, "v_issue"), ("run_id",)).drop("ordinal"))
query("l6_state_summary", "SELECT status, count(*) AS n FROM v_issue GROUP BY status", "v_issue")(lambda s, d: life.state_summary(view(s, d, "v_issue")).drop("ordinal"))
query(
    "l7_page_queue",
    """SELECT run_id, page_index, issue_id, preview_id, omitted FROM (
    SELECT run_id, page_index, issue_id, printf('sheet-%d-preview-%03d', page_index, row_number() OVER w) AS preview_id,
    greatest(count(*) OVER (PARTITION BY run_id, page_index) - 3, 0) AS omitted, row_number() OVER w AS k
    FROM (SELECT *, issue_id // 200 % 3 AS page_index FROM v_issue) WINDOW w AS (PARTITION BY run_id, page_index ORDER BY issue_id)) WHERE k <= 3""",
    "v_issue",
)(lambda s, d: life.page_queue(view(s, d, "v_issue").withColumn("page_index", F.floor(F.col("issue_id") / 200) % 3)))
_TASKS = """SELECT l_orderkey AS package, l_linenumber AS ordinal, concat('c', CAST(l_partkey AS VARCHAR(20))) AS check_id, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE concat('t', CAST(l_suppkey AS VARCHAR(20))) END AS title,
    CASE l_linenumber % 5 WHEN 0 THEN 'readiness' WHEN 1 THEN 'primary_issue_review' WHEN 2 THEN 'per_sheet_preview' WHEN 3 THEN 'handoff' ELSE 'other' END AS stage,
    CASE WHEN l_returnflag = 'A' THEN 'done' WHEN l_returnflag = 'N' AND l_linenumber % 2 = 0 THEN 'skipped_preview' WHEN l_returnflag = 'N' THEN 'open' WHEN l_linenumber % 7 = 1 THEN 'blocked' WHEN l_linenumber % 7 = 2 THEN 'needs_info' END AS status FROM lineitem"""


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("package"))
    return life.checklist_summary(spark.sql(_TASKS), keys.unionByName(keys.select((-F.col("package")).alias("package")))).withColumn("first_open", F.array_join("first_open", ","))


query(
    "l9_checklist",
    f"""WITH t AS ({_TASKS}), c AS (SELECT *, coalesce(status, '') NOT IN ('done', 'skipped_preview') AS is_open, CASE WHEN title = '' THEN check_id ELSE title END AS shown FROM t),
    o AS (SELECT package, string_agg(shown, ',' ORDER BY ordinal, shown) AS first_open FROM (SELECT *, row_number() OVER (PARTITION BY package ORDER BY ordinal, shown) AS k FROM c WHERE is_open) WHERE k <= 3 GROUP BY 1),
    s AS (SELECT p.package, count(ordinal) AS items, count(CASE WHEN NOT is_open THEN 1 END) AS done, count(CASE WHEN is_open THEN 1 END) AS open, count(CASE WHEN status = 'blocked' THEN 1 END) AS blocked, count(CASE WHEN status = 'needs_info' THEN 1 END) AS needs_info,
      count(CASE WHEN stage = 'readiness' THEN 1 END) AS readiness_items, count(CASE WHEN stage = 'primary_issue_review' THEN 1 END) AS primary_issue_items, count(CASE WHEN stage = 'per_sheet_preview' THEN 1 END) AS preview_items, count(CASE WHEN stage = 'handoff' THEN 1 END) AS handoff_items
      FROM (SELECT o_orderkey AS package FROM orders UNION SELECT -o_orderkey FROM orders) p LEFT JOIN c ON c.package = p.package GROUP BY 1)
    SELECT s.*, coalesce(first_open, '') AS first_open, CASE WHEN items = 0 THEN 'checklist_empty' WHEN blocked > 0 THEN 'checklist_blocked' WHEN needs_info > 0 THEN 'checklist_needs_info' WHEN open > 0 THEN 'checklist_open' ELSE 'checklist_complete' END AS state FROM s LEFT JOIN o ON o.package = s.package""",
)(_checked)
_PACKAGES = """SELECT c_custkey AS package, c_custkey % 7 = 0 AS lacks, c_custkey % 11 = 0 AS unbound, CASE c_custkey % 5 WHEN 0 THEN 'not_ready' WHEN 1 THEN 'handoff_ready_with_warnings' WHEN 2 THEN '' ELSE 'handoff_ready' END AS quality_status,
    CASE c_custkey % 4 WHEN 0 THEN 'blocked' WHEN 1 THEN NULL ELSE 'ready' END AS signoff_status, CASE c_custkey % 6 WHEN 0 THEN 'checklist_blocked' WHEN 1 THEN NULL WHEN 2 THEN 'checklist_open' ELSE 'checklist_complete' END AS checklist_status,
    c_nationkey AS items, c_custkey % 3 AS open, c_custkey % 2 AS blocked, CASE WHEN c_custkey % 6 = 1 THEN NULL ELSE 1 END AS needs_info FROM customer"""
_MANAGED = f""", p AS ({_PACKAGES}), k AS (SELECT package, 'required_artifacts_present' AS check_id, CASE WHEN lacks THEN 'fail' ELSE 'pass' END AS result, CASE WHEN lacks THEN 'missing required artifacts: x, y' ELSE 'all required artifacts present' END AS detail FROM p
    UNION ALL SELECT package, 'handoff_quality_ready', CASE quality_status WHEN 'handoff_ready' THEN 'pass' WHEN 'not_ready' THEN 'fail' ELSE 'needs_info' END, concat('handoff quality ', CASE WHEN quality_status = '' THEN 'missing' ELSE quality_status END) FROM p
    UNION ALL SELECT package, 'reviewer_signoff_ready', CASE WHEN signoff_status = 'ready' THEN 'pass' WHEN signoff_status = 'blocked' THEN 'fail' ELSE 'needs_info' END, concat('reviewer signoff ', coalesce(signoff_status, 'missing')) FROM p
    UNION ALL SELECT package, 'reviewer_task_checklist_complete', CASE WHEN checklist_status = 'checklist_complete' THEN 'pass' WHEN coalesce(checklist_status, 'checklist_blocked') = 'checklist_blocked' THEN 'fail' ELSE 'needs_info' END,
      concat('reviewer checklist ', coalesce(checklist_status, 'not_recorded'), ': open=', open, '/', items, ', blocked=', blocked, ', needs_info=', coalesce(needs_info, 0)) FROM p
    UNION ALL SELECT package, 'boundary_warnings_present', CASE WHEN unbound THEN 'fail' ELSE 'pass' END, CASE WHEN unbound THEN 'b1; b2' ELSE 'boundary warnings present' END FROM p)"""


def _managed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    rows = spark.sql(_PACKAGES).withColumn("missing_required", F.when(F.col("lacks"), F.array(F.lit("x"), F.lit("y"))))
    return life.manager_gate(rows.withColumn("boundary_missing", F.when(F.col("unbound"), F.array(F.lit("b1"), F.lit("b2")))))


query("l13_checks", "WITH " + _MANAGED[2:] + " SELECT * FROM k")(lambda s, d: _managed(s, d)[0])
query(
    "l13_manager_gate",
    "WITH " + _MANAGED[2:] + " SELECT package, CASE max(CASE result WHEN 'fail' THEN 2 WHEN 'needs_info' THEN 1 ELSE 0 END) WHEN 2 THEN 'manager_blocked' WHEN 1 THEN 'manager_needs_info' ELSE 'manager_ready' END AS status, count(CASE WHEN result <> 'pass' THEN 1 END) AS n_unmet FROM k GROUP BY 1",
)(lambda s, d: _managed(s, d)[1])
_FILE = "SELECT doc_id % 50 AS package, CAST(doc_id AS VARCHAR) AS path, doc_id % 9 AS k FROM documents"


def _files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs, k = table(spark, sf_dir, "documents"), F.col("doc_id") % 9
    files = docs.select("doc_id", (F.col("doc_id") % 50).alias("package"), F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256"), F.col("n_chars").cast("long").alias("size_bytes"))
    there = files.where(k != 0).withColumns({"sha256": F.when(k == 1, F.sha2("path", 256)).otherwise(F.col("sha256")), "size_bytes": F.when(k == 2, F.coalesce("size_bytes", F.lit(0)) + 1).otherwise(F.col("size_bytes"))})
    more = files.where(k == 3).withColumn("path", F.concat(F.lit("new-"), "path"))
    return files.where("doc_id % 50 <> 7 or doc_id % 9 > 3"), there.unionByName(more).where("doc_id % 50 <> 7 or doc_id % 9 > 3")


query(
    "l17_verify_manifest",
    f"SELECT package, path, CASE k WHEN 0 THEN 'missing' WHEN 1 THEN 'changed' WHEN 2 THEN 'changed' ELSE 'ok' END AS status FROM ({_FILE}) WHERE package <> 7 OR k > 3 UNION ALL SELECT package, concat('new-', path), 'unexpected' FROM ({_FILE}) WHERE k = 3 AND package <> 7",
)(lambda s, d: life.verify_manifest(*_files(s, d)))


def _archive(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    expected, actual = _files(spark, sf_dir)
    return life.archive_checks(expected, actual, life.package_digest(expected))


_ARCHIVE = f"""WITH f AS (SELECT package, count(CASE WHEN k = 0 THEN 1 END) AS missing, count(CASE WHEN k IN (1, 2) THEN 1 END) AS changed, count(CASE WHEN k = 3 THEN 1 END) AS unexpected FROM ({_FILE}) WHERE package <> 7 OR k > 3 GROUP BY 1),
    c AS (SELECT package, 'manifest_schema' AS check_id, 'blocker' AS severity, 0 AS n FROM f UNION ALL SELECT package, 'files_present', 'blocker', missing FROM f UNION ALL SELECT package, 'file_checksums_match', 'blocker', changed FROM f
    UNION ALL SELECT package, 'no_unexpected_files', 'warning', unexpected FROM f UNION ALL SELECT package, 'package_digest_match', 'blocker', CASE WHEN missing + changed + unexpected > 0 THEN 1 ELSE 0 END FROM f)"""
query("l17_checks", _ARCHIVE + " SELECT package, check_id, severity, CAST(n AS BIGINT) AS n FROM c")(lambda s, d: _archive(s, d)[0])
query("l17_status", _ARCHIVE + " SELECT package, CASE WHEN sum(n) > 0 THEN 'archive_drift' ELSE 'archive_verified' END AS status FROM c GROUP BY 1")(lambda s, d: _archive(s, d)[1])
_PATHS = "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN concat('artifacts/', CAST(doc_id AS VARCHAR(20))) WHEN 1 THEN 'handoff_summary.md' WHEN 2 THEN 'handoff_quality.json' WHEN 3 THEN 'reviewer_signoff.md' WHEN 4 THEN 'handoff_manager_checklist.json' ELSE 'other/artifacts/x' END AS path FROM documents"


@query("l16_roles", "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'copied_artifact' WHEN 1 THEN 'package_manifest' WHEN 2 THEN 'quality' WHEN 3 THEN 'signoff' WHEN 4 THEN 'manager_checklist' ELSE 'package_file' END AS role FROM documents")
def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    return spark.sql(_PATHS).select("doc_id", life.file_role(F.col("path")).alias("role"))


_SEG = "(SELECT page_index, round_even(x0 / 0.5, 0) * 0.5 AS x0, round_even(y0 / 0.5, 0) * 0.5 AS y0, round_even(x1 / 0.5, 0) * 0.5 AS x1 FROM v_segment)"


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.normalize_segments(view(spark, sf_dir, "v_segment"))


query("g1_normalize", f"SELECT page_index, x0, y0, x1, 'h' AS axis FROM {_SEG}", "v_segment")(lambda s, d: _segments(s, d).select("page_index", "x0", "y0", "x1", "axis"))
query("g2_gaps", f"SELECT page_index, y0 AS coord, x1 AS start, nxt AS stop, nxt - x1 AS gap FROM (SELECT *, lead(x0) OVER (PARTITION BY page_index, y0 ORDER BY x0, x1) AS nxt FROM {_SEG}) WHERE nxt - x1 > 2 AND nxt - x1 < 30", "v_segment")(lambda s, d: geo.detect_gaps(_segments(s, d), ["page_index"], 2.0, 30.0).select("page_index", "coord", "start", "stop", "gap"))
query(
    "g4_merge",
    f"SELECT page_index, y0 AS coord, min(x0) AS lo, max(x1) AS hi, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY page_index, y0 ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN x0 <= max(x1) OVER (PARTITION BY page_index, y0 ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 3 THEN 0 ELSE 1 END AS fresh FROM {_SEG})) GROUP BY page_index, y0, island",
    "v_segment",
)(lambda s, d: geo.merge_intervals(_segments(s, d).select("page_index", F.col("y0").alias("coord"), F.col("x0").alias("lo"), F.col("x1").alias("hi")), ["page_index", "coord"], tol=3.0))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    corner = [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")]
    return view(spark, sf_dir, "v_box").select("space_id", "page_index", F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in corner]).alias("polygon"), F.struct("x0", "y0", "x1", "y1").alias("bbox"))


query("g8_classify", "SELECT space_id, CASE WHEN least(x1 - x0, y1 - y0) > 0 AND greatest(x1 - x0, y1 - y0) >= 3 * least(x1 - x0, y1 - y0) AND least(x1 - x0, y1 - y0) / 10 BETWEEN 0.5 AND 2 THEN 'corridor' ELSE 'room' END AS kind, least(x1 - x0, y1 - y0) / 10 AS short_m FROM v_box WHERE NOT ((x1 - x0) >= 0.85 * 100 AND (y0 <= 0.05 * 300 OR 300 - y1 <= 0.05 * 300)) AND NOT ((y1 - y0) >= 0.85 * 300 AND (x0 <= 0.05 * 100 OR 100 - x1 <= 0.05 * 100))", "v_box")(
    lambda s, d: geo.classify_spaces(_boxes(s, d), _boxes(s, d).select("page_index", F.lit(100.0).alias("width_pt"), F.lit(300.0).alias("height_pt")).distinct(), ["page_index"], ppm=10.0).select("space_id", "kind", "short_m")
)
query("g10_label_spaces", "SELECT b.page_index, space_id, arg_min(label, text_idx) AS label FROM v_box b JOIN v_point p ON p.page_index = b.page_index AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY 1, 2", "v_box", "v_point")(lambda s, d: geo.label_spaces(_boxes(s, d), view(s, d, "v_point"), ["page_index"]))
query(
    "g20_edges",
    """SELECT space_id, e.edge, e.x0, e.y0, e.x1, e.y1, abs(e.x1 - e.x0) + abs(e.y1 - e.y0) AS length FROM (SELECT space_id, unnest([{'edge': 0, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y0}, {'edge': 1, 'x0': x1, 'y0': y0, 'x1': x1, 'y1': y1},
    {'edge': 2, 'x0': x1, 'y0': y1, 'x1': x0, 'y1': y1}, {'edge': 3, 'x0': x0, 'y0': y1, 'x1': x0, 'y1': y0}]) AS e FROM v_box) WHERE abs(e.x1 - e.x0) + abs(e.y1 - e.y0) > 0""",
    "v_box",
)(lambda s, d: geo.polygon_edges(_boxes(s, d), ["space_id"]))
query("g21_extent", "SELECT page_index, min(x0) / 50 AS x0_m, min(y0) / 50 AS y0_m, max(x1) / 50 AS x1_m, max(y1) / 50 AS y1_m FROM v_box GROUP BY 1", "v_box")(lambda s, d: geo.sheet_extent(_boxes(s, d), ["page_index"]))
query("g16_crop", "SELECT space_id FROM v_box WHERE (x0 + x1) / 2 BETWEEN 50 AND 200 AND (y0 + y1) / 2 BETWEEN 20 AND 120", "v_box")(lambda s, d: geo.crop(_boxes(s, d), (F.col("bbox.x0") + F.col("bbox.x1")) / 2, (F.col("bbox.y0") + F.col("bbox.y1")) / 2, (50.0, 20.0, 200.0, 120.0)).select("space_id"))

_Q = "SELECT item_id AS query_id, text FROM benchmark"
_TOK = "SELECT {k}, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9]+'))) AS token FROM {t}"


def _bm25(spark: SparkSession, sf_dir: str, only: str | None = None) -> DataFrame:
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = text.bm25_search(docs, asked, 10, docs.where(only) if only else None)
    return found.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


_BM25 = f"""WITH tokens AS ({_TOK.format(k='doc_id', t='documents')}), lens AS (SELECT d.doc_id, count(token) AS len FROM documents d LEFT JOIN tokens t ON t.doc_id = d.doc_id GROUP BY 1),
    stats AS (SELECT count(*) AS n, avg(len) AS mean FROM lens), asked AS (SELECT query_id, token, count(*) AS qf FROM ({_TOK.format(k='query_id', t=f'({_Q})')}) GROUP BY 1, 2),
    tf AS (SELECT doc_id, token, count(*) AS f FROM tokens WHERE token IN (SELECT token FROM asked) GROUP BY 1, 2), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
    scores AS (SELECT query_id, tf.doc_id, sum(qf * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1.0) * f * 2.5::DOUBLE / (f + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))) AS score FROM tf JOIN df USING (token) JOIN lens USING (doc_id) JOIN asked USING (token) CROSS JOIN stats GROUP BY 1, 2),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scores WHERE score > 0 AND {{only}})
    SELECT query_id, CAST(rank AS INT) AS rank, doc_id, round(score, 6) AS score FROM ranked WHERE rank <= 10"""
query("t5_bm25", _BM25.format(only="true"))(_bm25)
query("t6_bm25_candidates", _BM25.format(only="doc_id % 3 = 0"))(lambda s, d: _bm25(s, d, "doc_id % 3 = 0"))


def _page_types_sql() -> str:
    """T1 over documents, their lines as the texts of a page."""
    score = {k: " + ".join(f"CAST(contains(low, '{w.lower()}') AS INT)" for w in words) for k, words in text.PAGE_KEYWORDS.items()}
    best = f"greatest({', '.join(score)})"
    kind = "CASE " + " ".join(f"WHEN {k} = best THEN '{k}'" for k in score) + " END"
    held = "CASE kind " + " ".join(f"WHEN '{k}' THEN list_filter(t, lambda x: {' OR '.join(f'contains(lower(x), {chr(39)}{w.lower()}{chr(39)})' for w in words)})" for k, words in text.PAGE_KEYWORDS.items()) + " END"
    return f"""WITH a AS (SELECT doc_id, n_chars, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS t FROM documents),
    b AS (SELECT *, lower(array_to_string(t, ' ')) AS low FROM a), c AS (SELECT doc_id, n_chars, t, {', '.join(f'{v} AS {k}' for k, v in score.items())} FROM b), d AS (SELECT *, {best} AS best FROM c),
    e AS (SELECT *, {kind} AS kind, n_chars % 20 >= 10 AND len(t) <= 8 AS dense FROM d), f AS (SELECT *, {held} AS held FROM e)
    SELECT doc_id, CASE WHEN best > 0 THEN kind WHEN dense THEN 'plan' ELSE 'unknown' END AS page_type, CASE WHEN best > 0 THEN least(0.92::DOUBLE, 0.55::DOUBLE + 0.12::DOUBLE * best) WHEN dense THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END AS confidence, best AS n_keywords,
    array_to_string(CASE WHEN best = 0 THEN t[1:4] WHEN len(held) > 0 THEN held[1:6] ELSE t[1:3] END, '|') AS evidence FROM f"""


@query("t1_classify_pages", _page_types_sql())
def page_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("texts"), (F.coalesce("n_chars", F.lit(0)) % 20).alias("n_lines"))
    counted = rows.withColumn("n_texts", F.size(F.filter("texts", lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")) != "")))
    return text.classify_pages(counted).select("doc_id", "page_type", "confidence", "n_keywords", F.array_join("evidence", "|").alias("evidence"))


query(
    "t4_tokens",
    "SELECT item_id, array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)), ' ') AS tokens FROM benchmark",
)(lambda s, d: table(s, d, "benchmark").select("item_id", F.array_join(text.tokenize(F.col("text")), " ").alias("tokens")))
# what stands in a text, and the tokens that it gives
_FORMS = [("ⅷ Ⅻ", "viii xii"), ("㎡ ㎜", "m2 mm"), ("ﾄﾞｱ ﾊﾟﾈﾙ", ""), ("㈱ ㍿", "株 株 式 会 社 株式 式会 会社"), ("ﬁre ｅｘｉｔ", "fire exit"), ("２４ ½", "24 1 2"), ("①② ⑩", "12 10"), ("GB５００９６－5．5．2", "gb50096-5.5.2 gb50096 5 5 2")]
query(
    "t4_compatible_tokens",
    f"SELECT p_partkey, trim(concat({[t for _, t in _FORMS]}[p_partkey % {len(_FORMS)} + 1], ' ', lower(split_part(p_brand, '#', 1)), ' ', split_part(p_brand, '#', 2))) AS tokens FROM part",
)(
    lambda s, d: table(s, d, "part").select(
        "p_partkey",
        F.array_join(text.tokenize(F.concat(F.element_at(F.lit([t for t, _ in _FORMS]), (F.col("p_partkey") % len(_FORMS) + 1).cast("int")), F.lit(" "), F.col("p_brand"))), " ").alias("tokens"),
    )
)
query("t4_mixed_tokens", "SELECT p_partkey, concat_ws(' ', concat('gb50096-5.5.', p_size), '净 宽 度 净宽 宽度 门 gb50096 5 5', p_size, lower(split_part(p_brand, '#', 1)), split_part(p_brand, '#', 2), 'door') AS tokens FROM part")(
    lambda s, d: table(s, d, "part").select("p_partkey", F.array_join(text.tokenize(F.concat(F.lit("GB50096-5.5."), "p_size", F.lit(" 净宽度："), "p_brand", F.lit("　门 ＤＯＯＲ"))), " ").alias("tokens"))
)
_WANTED = [
    ("n", "count", None, 8, 12, None, None),
    ("zz", "count", 0, None, None, None, None),
    ("kinds", "member", None, None, None, "1-URGENT", None),
    ("kinds", "members", None, None, None, None, ["1-URGENT", "5-LOW"]),
    ("type", "text", None, None, None, "5-LOW", None),
    ("type", "contains", None, None, None, "LOW", None),
    ("pages", "each_count", None, None, 3, None, None),
    ("none", "each_count", None, 0, None, None, None),
]


def _actual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run of each customer gave: a count, a set, a text and a count for every order."""
    by = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("case_id")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("o_orderpriority")).alias("kinds"), F.max("o_orderpriority").alias("type"), F.collect_list((F.col("o_orderkey") % 5).cast("long")).alias("pages"))
    none = {"value": F.lit(None).cast("long"), "text": F.lit(None).cast("string"), "members": F.lit(None).cast("array<string>"), "page_values": F.lit(None).cast("array<bigint>")}

    def row(name: str, column: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), *[v.alias(k) for k, v in (none | {column: value}).items()])

    return by.select("case_id", F.inline(F.array(row("n", "value", F.col("n")), row("kinds", "members", F.col("kinds")), row("type", "text", F.col("type")), row("pages", "page_values", F.col("pages")))))


def _benchmark(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    actual = _actual(spark, sf_dir)
    fields = F.array(*[F.struct(*[F.lit(v).cast(kind).alias(n) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(n) for v, (n, kind) in zip(row, _FIELDS, strict=True)]) for row in _WANTED])
    cases = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"), F.when(F.col("c_custkey") % 2 == 0, 0.5).alias("min_score"))
    return text.run_benchmark(actual, actual.select("case_id").distinct().select("case_id", F.inline(fields)), cases)


_FIELDS = [("name", "string"), ("op", "string"), ("exact", "long"), ("least", "long"), ("most", "long"), ("wanted", "string"), ("wanted_all", "array<string>")]
_RAN = """WITH a AS (SELECT o_custkey AS case_id, count(*) AS n, count(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END) AS urgent, count(CASE WHEN o_orderpriority = '5-LOW' THEN 1 END) AS low, max(o_orderpriority) AS type, max(o_orderkey % 5) AS most FROM orders GROUP BY 1),
    c AS (SELECT case_id, 'n' AS name, 'count' AS op, n BETWEEN 8 AND 12 AS ok FROM a UNION ALL SELECT case_id, 'zz', 'count', true FROM a UNION ALL SELECT case_id, 'kinds', 'member', urgent > 0 FROM a UNION ALL SELECT case_id, 'kinds', 'members', urgent > 0 AND low > 0 FROM a
    UNION ALL SELECT case_id, 'type', 'text', type = '5-LOW' FROM a UNION ALL SELECT case_id, 'type', 'contains', contains(type, 'LOW') FROM a UNION ALL SELECT case_id, 'pages', 'each_count', most <= 3 FROM a UNION ALL SELECT case_id, 'none', 'each_count', false FROM a)"""
query("t20_checks", _RAN + " SELECT * FROM c")(lambda s, d: _benchmark(s, d)[0].select("case_id", "name", "op", "ok"))
query(
    "t20_benchmark",
    _RAN + " SELECT c_custkey AS case_id, count(ok) AS n_checks, round(coalesce(avg(CAST(ok AS INT)), 1.0), 4) AS score, count(CASE WHEN NOT ok THEN 1 END) = 0 AS passed FROM customer LEFT JOIN c ON case_id = c_custkey GROUP BY 1",
)(lambda s, d: _benchmark(s, d)[1])


def _room_schedule(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rooms and entries of four projects that use the same ids and labels."""
    part, project = table(spark, sf_dir, "part"), (F.col("p_partkey") % 4).alias("project_id")
    room = F.floor(F.col("p_partkey") / 4)
    rooms = part.select(project, room.alias("room_id"), F.col("p_type").alias("label"), F.lit(None).cast("double").alias("height_m"))
    height = F.when(F.col("p_size") % 7 != 0, F.col("p_size") / 10)
    entries = part.select(project, room.alias("entry_idx"), F.when(F.col("p_size") < 48, room).alias("room_id"), F.col("p_type").alias("label"), height.alias("height_m"))
    return rooms, entries, ["project_id"]


_ROOM_ENTRIES = """WITH r AS (SELECT p_partkey % 4 AS project_id, p_partkey // 4 AS room_id, p_type AS label, p_size, CASE WHEN p_size % 7 <> 0 THEN p_size / 10.0::DOUBLE END AS height_m FROM part),
    hits AS (SELECT project_id, room_id, room_id AS entry_idx, height_m FROM r WHERE p_size < 48
    UNION ALL SELECT q.project_id, q.room_id, p.room_id, p.height_m FROM r p JOIN r q ON q.project_id = p.project_id AND q.label = p.label WHERE p.p_size >= 48)"""
query(
    "d1_room_schedule",
    _ROOM_ENTRIES
    + """ SELECT project_id, room_id, r.label, arg_max(h.height_m, entry_idx) FILTER (WHERE h.height_m IS NOT NULL) AS height_m
    FROM r LEFT JOIN hits h USING (project_id, room_id) GROUP BY 1, 2, 3""",
)(lambda s, d: schedules.apply_room_schedule(*_room_schedule(s, d), ["height_m"]).select("project_id", "room_id", "label", "height_m"))
query(
    "d2_schedule_audit",
    _ROOM_ENTRIES
    + """ SELECT r.project_id, r.room_id AS entry_idx, count(h.room_id) AS n_rooms, CASE WHEN count(h.room_id) = 0 THEN 'unmatched' WHEN any_value(r.height_m) IS NULL THEN 'empty' ELSE 'matched' END AS status
    FROM r LEFT JOIN hits h ON h.project_id = r.project_id AND h.entry_idx = r.room_id GROUP BY 1, 2""",
)(lambda s, d: schedules.room_schedule_audit(*_room_schedule(s, d), ["height_m"]))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
