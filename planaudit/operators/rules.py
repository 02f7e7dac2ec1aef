"""Rule evaluation over entity and project tables.

A rule is a dict with rule_id, applies_to, inputs, logic_expression and, if
needed, output_template, threshold_value, severity, source_clause_ids,
suppress_measured. Rules are plan-time data: all rules of an entity type become
one projection, so entities are scanned once whatever the number of rules.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planaudit.functions.predicates import Template, bind_inputs, measured_sql, message_arguments, messages, predicate_sql, quoted, value_kinds

# Readiness tiers.
TIERS = ["AUTODETECTABLE", "PARTIAL_AUTODETECT", "PROJECT_META_DRIVEN", "REMINDER_BY_DESIGN", "STAIR_PENDING"]
#: Rules in one projection.
AT_ONCE = 256
#: What applicability depends on, and into how many parts rules are dealt where profiles meet all of them.
PROFILE, SLOTS = ["building_type", "height_class"], 64


def _outcomes(rows: DataFrame, rules: list[dict], default_severity: str) -> str:
    """SQL of one struct for each rule: does it hold, and what to report."""
    out = []
    for rule in rules:
        inputs = bind_inputs(rows, rule["inputs"])
        numbers, texts = message_arguments(inputs)
        threshold, clause = rule.get("threshold_value"), (rule.get("source_clause_ids") or [None])[0]
        fields = {
            "rule_id": quoted(rule["rule_id"]),
            "holds": predicate_sql(rule["logic_expression"], inputs),
            "measured_value": measured_sql(rule["inputs"], inputs, rule.get("suppress_measured", False)),
            "_numbers": numbers,
            "_texts": texts,
            "threshold_value": f"CAST({'NULL' if threshold is None else quoted(repr(float(threshold)))} AS DOUBLE)",
            "severity": quoted(rule.get("severity") or default_severity),
            "clause_id": f"CAST({'NULL' if clause is None else quoted(str(clause))} AS STRING)",
        }
        out.append(f"named_struct({', '.join(f'{quoted(k)}, {v}' for k, v in fields.items())})")
    return f"array({', '.join(out)})"


def _reported(rows: DataFrame, rules: list[dict], outcomes: DataFrame) -> DataFrame:
    """What does not hold, with its message in place of the message's arguments."""
    fill = messages({r["rule_id"]: Template(r.get("output_template", r["rule_id"]), value_kinds(rows, r["inputs"])) for r in rules})
    message = fill("rule_id", "_numbers", "_texts").alias("message")
    failed = outcomes.where("not holds")
    return failed.select(*[message if c == "_numbers" else F.col(c) for c in failed.columns if c not in ("holds", "_texts")])


def evaluate(entities: DataFrame, rules: list[dict], keep: tuple[str, ...] = ("run_id", "page_index", "entity_id"), type_col: str = "entity_type") -> DataFrame:
    """One issue for each entity and rule of its type that does not hold (default severity error).

    Entities are scanned once for every 256 rules; the type picks the rules of a row. A null or
    unreadable operand makes a rule fail. Ids of issues are hashes of run, rule and
    entity, so reruns agree.
    """
    if not rules:
        raise ValueError("no rules")
    if len(rules) > AT_ONCE:
        # the code of one projection grows with its rules, and beyond a few hundred no longer runs as fast
        return reduce(DataFrame.unionByName, [evaluate(entities, rules[i : i + AT_ONCE], keep, type_col) for i in range(0, len(rules), AT_ONCE)])
    by_type = {kind: _outcomes(entities, [r for r in rules if r["applies_to"] == kind], "error") for kind in sorted({r["applies_to"] for r in rules})}
    picked = "CASE " + " ".join(f"WHEN `{type_col}` = {quoted(kind)} THEN {found}" for kind, found in by_type.items()) + " END"
    issues = _reported(entities, rules, entities.where(F.col(type_col).isin(*by_type)).select(*keep, F.expr(f"inline({picked})")))
    return issues.withColumn("issue_id", F.substring(F.sha2(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in keep], "rule_id"), 256), 1, 16))


def evaluate_projects(projects: DataFrame, rules: list[dict]) -> DataFrame:
    """Project rules, once per project; the entity is project:<id>, there is no box, default severity info."""
    own = [r for r in rules if r["applies_to"] == "Project"]
    rows = projects.select(F.concat(F.lit("project:"), F.col("project_id").cast("string")).alias("entity_id"), "project_id", F.expr(f"inline({_outcomes(projects, own, 'info')})"))
    return _reported(projects, own, rows)


def resolve_evidence(issues: DataFrame, clauses: DataFrame) -> DataFrame:
    """Threshold and unit of an issue: the rule's own threshold, else its first clause's; an unknown clause leaves both as they are."""
    known = clauses.select("clause_id", F.col("threshold_value").alias("_t"), "unit")
    return issues.join(known, "clause_id", "left").withColumn("threshold_value", F.coalesce("threshold_value", "_t")).drop("_t")


def _links(rules: DataFrame, clauses: DataFrame) -> DataFrame:
    """Clause references of rules with the scope of their clauses; a rule without any has one with a null place."""
    scope = clauses.select("clause_id", F.lit(True).alias("known"), "applies_to_building_type", "applies_to_height_class")
    return rules.select("rule_id", F.posexplode_outer("source_clause_ids").alias("at", "clause_id")).join(scope, "clause_id", "left")


def _profiles(projects: DataFrame) -> DataFrame:
    """The distinct combinations of what applicability depends on."""
    return projects.select(*PROFILE).distinct()


def _applicable(links: DataFrame, profiles: DataFrame) -> DataFrame:
    """PROFILE and rule_id of the rules that apply to each profile, found by building type and, where a clause names any, height class."""
    index = links.select("rule_id", F.explode("applies_to_building_type").alias("building_type"), "applies_to_height_class")
    whole = index.where("applies_to_height_class is null").select("building_type", "rule_id").distinct()
    named = index.select("building_type", F.explode("applies_to_height_class").alias("height_class"), "rule_id").distinct()
    return profiles.join(whole, "building_type").unionByName(profiles.join(named, PROFILE)).select(*PROFILE, "rule_id").distinct()


def _of_projects(projects: DataFrame, rows: DataFrame) -> DataFrame:
    """rows of a profile for every project that has it."""
    mine = projects.select("project_id", *[F.col(c).alias(f"_{c}") for c in PROFILE])
    same = reduce(lambda a, b: a & b, [F.col(f"_{c}").eqNullSafe(F.col(c)) for c in PROFILE])
    return mine.join(rows, same).drop(*PROFILE, *[f"_{c}" for c in PROFILE])


def applicable_rules(rules: DataFrame, clauses: DataFrame, projects: DataFrame) -> DataFrame:
    """(project_id, rule_id) where any source clause allows the building type and, if it names any, the height class.

    Rules are resolved once for each distinct profile of projects. A project without a building type has none.
    """
    return _of_projects(projects, _applicable(_links(rules, clauses), _profiles(projects))).select("project_id", "rule_id").distinct()


def skip_reasons(rules: DataFrame, clauses: DataFrame, projects: DataFrame) -> DataFrame:
    """R2: project_id, rule_id and one reason text, in clause order, for every rule that does not apply.

    Reasons are put together once for each distinct profile. Every profile meets every rule, as a rule that does not
    apply is a row of the result: rules are dealt into SLOTS by hash, and profiles stand in all of them.
    """
    links, profiles = _links(rules, clauses), _profiles(projects)
    dealt = rules.select("rule_id", F.pmod(F.xxhash64("rule_id"), F.lit(SLOTS)).cast("int").alias("slot")).distinct()
    met = profiles.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1)))).join(dealt, "slot").select(*PROFILE, "rule_id")
    known = _applicable(links, profiles).select(*[F.col(c).alias(f"_{c}") for c in PROFILE], F.col("rule_id").alias("_rule"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in PROFILE])
    left = met.join(known, same & (F.col("rule_id") == F.col("_rule")), "left_anti").join(links, "rule_id")
    build, height = (F.coalesce(c, F.lit("?")) for c in PROFILE)
    covered = F.coalesce(F.array_contains("applies_to_building_type", F.col("building_type")), F.lit(False))
    reason = F.when(F.col("at").isNull(), F.lit("no source clause"))
    reason = reason.when(F.col("known").isNull(), F.concat("clause_id", F.lit(": unknown clause")))
    reason = reason.when(~covered, F.concat("clause_id", F.lit(": building type "), build, F.lit(" not covered")))
    reason = reason.otherwise(F.concat("clause_id", F.lit(": height class "), height, F.lit(" not covered")))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("at", reason.alias("text")))), lambda x: x["text"])
    reasons = left.groupBy(*PROFILE, "rule_id").agg(F.array_join(texts, "; ").alias("reason"))
    return _of_projects(projects, reasons).select("project_id", "rule_id", "reason")


def clean_bbox(issues: DataFrame) -> DataFrame:
    """The box of an uncertain entity with an all-zero box becomes null."""
    zero = (F.col("bbox.x0") == 0) & (F.col("bbox.y0") == 0) & (F.col("bbox.x1") == 0) & (F.col("bbox.y1") == 0)
    return issues.withColumn("bbox", F.when(F.col("uncertain") & zero, F.lit(None)).otherwise(F.col("bbox")))


def evaluate_multi_page(entities: DataFrame, projects: DataFrame, rules: list[dict], primary: str = "is_primary") -> DataFrame:
    """Entity rules on all pages; project rules once, on the primary page."""
    issues = evaluate(entities, [r for r in rules if r["applies_to"] != "Project"])
    runs = entities.where(primary).select("run_id", "page_index", "project_id").distinct()
    own = evaluate_projects(projects, rules).join(runs, "project_id").drop("project_id").withColumn("issue_id", F.substring(F.sha2(F.concat_ws("\x1f", F.col("run_id").cast("string"), "rule_id", "entity_id"), 256), 1, 16))
    return issues.unionByName(own)


def merge_skips(skips: DataFrame, primary: str = "is_primary") -> DataFrame:
    """skips(run_id, page_index, rule_id, reason) of all pages, one of each rule of a run: the first page's, the primary page last."""
    first = F.min_by("reason", F.struct(F.col(primary), "page_index"))
    return skips.groupBy("run_id", "rule_id").agg(first.alias("reason"))


def sheet_issue_groups(pages: DataFrame, issues: DataFrame, skips: DataFrame) -> DataFrame:
    """run_id, page_index, n_issues, issues (sorted by id), n_skipped and skipped rules of each page; pages without any are kept."""
    keys = ["run_id", "page_index"]
    by = issues.groupBy(*keys).agg(F.count("*").alias("n_issues"), F.array_sort(F.collect_list("issue_id")).alias("issues"))
    out = skips.groupBy(*keys).agg(F.count("*").alias("n_skipped"), F.array_sort(F.collect_list("rule_id")).alias("skipped"))
    rows = pages.select(*keys).distinct().join(by, keys, "left").join(out, keys, "left")
    empty = F.array().cast("array<string>")
    return rows.select(*keys, *[F.coalesce(c, F.lit(0) if c.startswith("n_") else empty).alias(c) for c in ("n_issues", "issues", "n_skipped", "skipped")])


def rule_selftest(spark_rows: DataFrame, rules: list[dict]) -> DataFrame:
    """Embedded cases (rule_id, case_name, inputs as columns, expect_pass) whose outcome differs."""
    cases = [f"WHEN rule_id = {quoted(r['rule_id'])} THEN {predicate_sql(r['logic_expression'], bind_inputs(spark_rows, r['inputs']))}" for r in rules]
    outcome = F.expr(f"CASE {' '.join(cases)} END")
    return spark_rows.withColumn("passes", outcome).where("passes <> expect_pass").select("rule_id", "case_name", "expect_pass", "passes")


def _severity(rule: dict) -> str:
    return rule.get("severity") or ("info" if rule["applies_to"] == "Project" else "error")


def entity_readiness(entities: DataFrame, rules: list[dict], least: float = 0.5) -> DataFrame:
    """Per run and entity rule: entities of its type, those with all inputs, weak ones among these, missing inputs, and a status.

    unsupported_entity (no entity of the type), missing_input (an input that no entity
    has, or no entity with all of them; then all are missing), low_confidence (an
    entity with all inputs is uncertain or below `least`), manual_only (severity
    info), ready. Entities are scanned once.
    """
    own = [r for r in rules if r["applies_to"] != "Project"]
    sums, parts = [], []
    unsure = F.coalesce(F.col("uncertain"), F.lit(False)) if "uncertain" in entities.columns else F.lit(False)
    for i, r in enumerate(own):
        inputs = bind_inputs(entities, r["inputs"])
        kind = F.col("entity_type") == r["applies_to"]
        complete = kind & reduce(lambda a, b: a & b, [b.column.isNotNull() for b in inputs.values()], F.lit(True))
        weak = complete & (unsure | (F.coalesce("confidence", F.lit(0.0)) < least))
        sums += [F.count_if(kind).alias(f"e{i}"), F.count_if(complete).alias(f"c{i}"), F.count_if(weak).alias(f"w{i}")]
        sums += [F.count_if(kind & b.column.isNotNull()).alias(f"i{i}_{k}") for k, b in enumerate(inputs.values())]
        names = F.array(*[F.lit(n) for n in r["inputs"]]) if r["inputs"] else F.array().cast("array<string>")
        absent = F.array_compact(F.array(*[F.when(F.col(f"i{i}_{k}") == 0, F.lit(n)) for k, n in enumerate(inputs)])) if inputs else F.array().cast("array<string>")
        lacking = (F.size(absent) > 0) | (F.col(f"c{i}") == 0)
        status = F.when(F.col(f"e{i}") == 0, "unsupported_entity").when(lacking, "missing_input").when(F.col(f"w{i}") > 0, "low_confidence").otherwise("manual_only" if _severity(r) == "info" else "ready")
        missing = F.when(F.col(f"e{i}") == 0, names).when(F.size(absent) > 0, absent).when(F.col(f"c{i}") == 0, names).otherwise(F.array().cast("array<string>"))
        parts.append(F.struct(F.lit(r["rule_id"]).alias("rule_id"), F.col(f"e{i}").alias("candidates"), F.col(f"c{i}").alias("complete"), F.col(f"w{i}").alias("weak"), missing.alias("missing"), status.alias("status")))
    return entities.groupBy("run_id").agg(*sums).select("run_id", F.inline(F.array(*parts)))


def project_readiness(projects: DataFrame, rules: list[dict], clauses: DataFrame, skips: DataFrame) -> DataFrame:
    """Per project and rule: missing inputs, status and what it rests on.

    projects: project_id and has_meta, with the project's fields; clauses(clause_id);
    skips(project_id, rule_id, reason). In this order: a source clause that was not
    loaded is missing_input (knowledge_base); a skipped rule is not_applicable
    (applicability), or missing_input (project_meta) without project data; then
    project rules only: no project data or a null field is missing_input, severity
    info is manual_only, else ready. Entity rules that pass the first two are left to
    R14.
    """
    known = {r["clause_id"] for r in clauses.select("clause_id").where(F.col("clause_id").isin(sorted({c for r in rules for c in r.get("source_clause_ids") or []}))).distinct().collect()}
    empty = F.array().cast("array<string>")
    parts = []
    for r in rules:
        names = F.array(*[F.lit(n) for n in r["inputs"]]) if r["inputs"] else empty
        project = r["applies_to"] == "Project"
        inputs = bind_inputs(projects, r["inputs"]) if project else {}
        absent = F.array_compact(F.array(*[F.when(b.column.isNull(), F.lit(n)) for n, b in inputs.items()])) if inputs else empty
        parts.append(F.struct(F.lit(r["rule_id"]).alias("rule_id"), F.lit(project).alias("project"), F.lit(_severity(r)).alias("severity"), F.lit(set(r.get("source_clause_ids") or []) <= known).alias("known"), names.alias("inputs"), absent.alias("absent")))
    rows = projects.select("project_id", "has_meta", F.inline(F.array(*parts))).join(skips.select("project_id", "rule_id", F.lit(True).alias("skipped")).distinct(), ["project_id", "rule_id"], "left")
    status = F.when(~F.col("known"), "missing_input").when(F.col("skipped"), F.when(F.col("has_meta"), "not_applicable").otherwise("missing_input")).when(~F.col("has_meta") | (F.size("absent") > 0), "missing_input").when(F.col("severity") == "info", "manual_only").otherwise("ready")
    source = F.when(~F.col("known"), "knowledge_base").when(F.col("skipped") & F.col("has_meta"), "applicability").otherwise("project_meta")
    missing = F.when(~F.col("known") | ~F.col("has_meta"), F.col("inputs")).when(F.col("skipped"), empty).otherwise(F.col("absent"))
    return rows.where("project or not known or skipped").select("project_id", "rule_id", status.alias("status"), source.alias("source"), missing.alias("missing"))


def evidence_source(flags: dict[str, Column]) -> Column:
    """The names of the sources that contributed, joined by +."""
    return F.concat_ws("+", *[F.when(c, F.lit(n)) for n, c in flags.items()])


def readiness_tiers(rules: DataFrame, capabilities: DataFrame) -> DataFrame:
    """rule_id, missing and tier from capabilities(applies_to, fields).

    A stair rule is pending only while stairs have no fields. A null severity is info
    for project rules and error for others.
    """
    fields = F.coalesce("fields", F.array().cast("array<string>"))
    both = rules.join(capabilities, "applies_to", "left").withColumn("_fields", fields).withColumn("missing", F.array_except("inputs", "_fields"))
    severity = F.coalesce("severity", F.when(F.col("applies_to") == "Project", "info").otherwise("error"))
    pending = (F.col("applies_to") == "Stair") & (F.size("_fields") == 0)
    tier = F.when(pending, TIERS[4]).when(severity == "info", TIERS[3]).when(F.col("applies_to") == "Project", TIERS[2]).when(F.size("missing") > 0, TIERS[1]).otherwise(TIERS[0])
    return both.select("rule_id", "missing", tier.alias("tier"))


def domain_counts(df: DataFrame, col: str, domain: list[str]) -> DataFrame:
    """Counts over a fixed domain, zero-filled; values outside it are left out."""
    known = df.sparkSession.createDataFrame([(i, d) for i, d in enumerate(domain)], "ordinal int, value string")
    counts = df.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("c"))
    return counts.join(F.broadcast(known), "value", "right").select("ordinal", "value", F.coalesce("c", F.lit(0)).alias("n"))


def blocked_sources(readiness: DataFrame) -> DataFrame:
    """Source and number of rules it blocks, most first."""
    return readiness.where(F.col("status").isin("missing_input", "unsupported_entity")).groupBy("source").agg(F.countDistinct("rule_id").alias("n_rules")).orderBy(F.desc("n_rules"), "source")


def check_schedule_project(schedule: DataFrame, projects: DataFrame) -> DataFrame:
    """Schedule rows whose project is unknown."""
    return schedule.join(projects.select("project_id"), "project_id", "left_anti")
