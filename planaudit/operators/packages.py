"""Hand-over packages, run overviews and promoted cases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planaudit.functions.predicates import bind_inputs

# Terms a boundary warning must name, statuses that block or wait, order of note statuses.
BOUNDARY_TERMS = ["candidate", "preview", "review-state", "missing input", "evidence_ready"]
BLOCKING = ["not_ready", "blocked", "manager_blocked", "archive_drift", "invalid"]
WAITING = ["handoff_ready_with_warnings", "needs_info", "manager_needs_info", "not_run", "not_recorded"]
NOTE_ORDER = ["needs_info", "blocked", "not_recorded", "invalid"]
# Gates in order: column, status that passes, status when absent, actor, action.
GATES = [
    ("quality_status", "handoff_ready", "not_run", "reviewer", "run_handoff_quality"),
    ("signoff_status", "ready", "not_recorded", "reviewer", "record_reviewer_signoff"),
    ("checklist_status", "checklist_complete", "missing", "reviewer", "close_checklist"),
    ("manager_status", "manager_ready", "not_recorded", "manager", "run_manager_checklist"),
    ("archive_status", "archive_manifest_ready", "not_recorded", "archive", "write_archive_manifest"),
    ("archive_verification_status", "archive_verified", "not_recorded", "archive", "verify_archive"),
]
# Names under which a failure report may hold the same thing.
REQUIREMENT_KEYS = ["requirements", "facets", "checks", "applicability"]
FAILED_KEYS = ["failed_entities", "failures", "failedEntities", "failed_entities_info"]
FAILED_WORDS = ["false", "fail", "failed", "invalid", "non_compliant"]


def _strings(*items: Column) -> Column:
    return F.array_compact(F.array(*items)).cast("array<string>")


def package_quality(manifests: DataFrame, files: DataFrame, schema: str, policy: str, terms: list[str] = BOUNDARY_TERMS) -> DataFrame:
    """Package, blockers and status (handoff_ready or not_ready).

    manifests: package, schema_version, read_only, mutation_policy, missing_required (array), artifacts (array of
    struct(artifact, status, path)), boundary_warnings (array); files: package, path. Null arrays count as empty.
    """
    copied = manifests.select("package", F.explode("artifacts").alias("a")).where("a.status = 'available'").select("package", F.coalesce("a.path", F.lit("")).alias("path"), F.coalesce(F.nullif("a.artifact", F.lit("")), F.nullif("a.path", F.lit("")), F.lit("unknown")).alias("artifact"))
    lost = copied.join(files.select("package", "path").distinct(), ["package", "path"], "left_anti").groupBy("package").agg(F.array_sort(F.collect_list("artifact")).alias("lost"))
    none = F.array().cast("array<string>")
    said = F.lower(F.array_join(F.coalesce("boundary_warnings", none), " "))
    blockers = F.concat(
        _strings(F.when(~F.col("schema_version").eqNullSafe(F.lit(schema)), F.lit("manifest_schema"))),
        _strings(F.when(~(F.coalesce("read_only", F.lit(False)) & F.col("mutation_policy").eqNullSafe(F.lit(policy))), F.lit("read_only_policy"))),
        F.transform(F.coalesce("missing_required", none), lambda v: F.concat(F.lit("required: "), v)),
        F.transform(F.coalesce("lost", none), lambda v: F.concat(F.lit("copied: "), v)),
        F.transform(F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: ~F.contains(said, t)), lambda v: F.concat(F.lit("term: "), v)),
    )
    rows = manifests.join(lost, "package", "left").select("package", blockers.alias("blockers"))
    return rows.withColumn("status", F.when(F.size("blockers") > 0, "not_ready").otherwise("handoff_ready"))


def package_next_action(packages: DataFrame, schema: str) -> DataFrame:
    """Package, status, open items, and actor and id of the first unmet gate (done and ready if all are met).

    packages: package, schema_version, missing_required (array) and the status columns of GATES; null means absent.
    """
    missing = F.coalesce("missing_required", F.array().cast("array<string>"))
    foreign = ~F.col("schema_version").eqNullSafe(F.lit(schema))
    state = {g[0]: F.coalesce(F.col(g[0]), F.lit(g[2])) for g in GATES}
    judged = F.array(*[state[c] for c in ("quality_status", "signoff_status", "manager_status", "archive_verification_status")])
    status = F.when(foreign | (F.size(missing) > 0), "package_blocked").when(F.arrays_overlap(judged, F.lit(BLOCKING)), "package_blocked").when(F.arrays_overlap(judged, F.lit(WAITING)), "package_needs_info").otherwise("package_ready")
    actor, action = F.when(foreign | (F.size(missing) > 0), "reviewer"), F.when(foreign, "restore_manifest").when(F.size(missing) > 0, "restore_required_artifacts")
    for column, passing, _, who, what in GATES:
        actor, action = actor.when(state[column] != passing, who), action.when(state[column] != passing, what)
    unmet = [F.when(state[c] != passing, F.concat(F.lit(f"{c}: "), state[c])) for c, passing, _, _, _ in GATES if c != "checklist_status"]
    items = F.concat(_strings(F.when(foreign, F.lit("manifest"))), F.transform(missing, lambda v: F.concat(F.lit("required: "), v)), _strings(*unmet))
    return packages.select("package", status.alias("status"), F.array_distinct(items).alias("open_items"), actor.otherwise("done").alias("actor"), action.otherwise("ready").alias("action_id"))


def triage_digest(packages: DataFrame) -> DataFrame:
    """One row per package and open matter: category, severity, reason and place in its queue.

    packages: package, actor, action_id, reason, provenance_available, provenance_weak, semantic_count,
    measurement_count, host_count, guidance_available, guidance_reason, note_status.
    """
    text = F.lower(F.concat_ws(" ", "action_id", "reason"))
    required = packages.where("actor <> 'done'").select("package", F.lit("required_next_action").alias("category"), F.when(text.rlike("blocked|invalid|drift|not_ready"), "blocker").otherwise("needs_info").alias("severity"), "reason", F.lit(0).alias("place"))
    lacking = F.array_join(_strings(*[F.when(F.coalesce(f"{n}_count", F.lit(0)) == 0, F.lit(name)) for n, name in (("semantic", "semantic"), ("measurement", "measurement"), ("host", "host_wall"))]), ", ")
    why = F.when(~F.coalesce("provenance_available", F.lit(False)), "provenance not available").when(lacking == "", "provenance weak").otherwise(F.concat(F.lit("provenance lacks "), lacking))
    weak = packages.where("provenance_weak").select("package", F.lit("opening_provenance").alias("category"), F.lit("guidance").alias("severity"), why.alias("reason"), F.lit(0).alias("place"))
    guidance = packages.where("guidance_available").select("package", F.lit("optional_guidance").alias("category"), F.lit("guidance").alias("severity"), F.col("guidance_reason").alias("reason"), F.lit(0).alias("place"))
    place = F.array_position(F.lit(NOTE_ORDER), F.col("note_status")).cast("int")
    notes = packages.where(F.col("note_status").isin(NOTE_ORDER)).select("package", F.lit("optional_guidance_note").alias("category"), F.when(F.col("note_status").isin("blocked", "invalid"), "blocker").otherwise("needs_info").alias("severity"), F.concat(F.lit("note is "), "note_status").alias("reason"), place.alias("place"))
    return reduce(DataFrame.unionByName, [required, weak, guidance, notes])


def workbench(runs: DataFrame, tables: dict[str, tuple[DataFrame, dict[str, Column]]], texts: dict[str, dict[str, tuple[Column, str]]] | None = None) -> DataFrame:
    """Per run the counts and texts of each artifact's table, the artifacts that have no row, and warnings.

    tables: artifact name to (table with run_id, {count name: condition}); texts: artifact name to {name: (column, what
    stands for a missing one)}. Warnings read the counts blocked_rules, sheet_graph_count, issue_count and
    candidate_review_states where they are given.
    """
    rows, names, said = runs.select("run_id"), [], {}
    for artifact, (table, counts) in tables.items():
        own = (texts or {}).get(artifact, {})
        sums = [F.count_if(c).alias(n) for n, c in counts.items()] + [F.max(c).alias(n) for n, (c, _) in own.items()]
        found = table.groupBy("run_id").agg(F.lit(True).alias(f"_{artifact}"), *sums)
        rows, names = rows.join(found, "run_id", "left"), names + list(counts)
        said |= {n: F.coalesce(F.nullif(F.col(n), F.lit("")), F.lit(missing)).alias(n) for n, (_, missing) in own.items()}
    rows = rows.fillna(0, names)
    absent = F.array_join(_strings(*[F.when(F.col(f"_{a}").isNull(), F.lit(a)) for a in tables]), ",")

    def more(name: str, than: int) -> Column:
        return F.col(name) > than if name in names else F.lit(False)

    warn = _strings(
        F.when(absent != "", F.lit("missing_artifacts")),
        F.when(more("blocked_rules", 0), F.lit("blocked_rules")),
        F.when(more("sheet_graph_count", 1), F.lit("several_sheet_graphs")),
        F.when(more("issue_count", 0) & more("candidate_review_states", 0), F.lit("unreviewed_candidates")),
    )
    return rows.select("run_id", *names, *said.values(), absent.alias("missing"), F.array_join(warn, ",").alias("warnings"))


def promote_cases(issues: DataFrame, entities: DataFrame, projects: DataFrame, rules: list[dict], known: DataFrame) -> DataFrame:
    """rule_id, name and inputs (JSON) of a test case for each confirmed issue that is not among known(rule_id, name) yet.

    issues: run_id, issue_id, rule_id, entity_ids, status, project_id. An issue counts by its first entity, with null
    inputs where that entity is gone; one of a project (`project:` id) needs a project row. Unknown rules give nothing.
    """
    rows = issues.where("status = 'confirmed'").withColumn("entity_id", F.get("entity_ids", F.lit(0))).where("entity_id is not null")
    name = F.concat(F.lit("confirmed-"), F.col("issue_id").cast("string"))
    of_project = F.startswith(F.col("entity_id").cast("string"), F.lit("project:"))
    parts = []
    for rule in rules:
        mine = rows.where(F.col("rule_id") == rule["rule_id"])

        def case(source: DataFrame, rule: dict = rule) -> Column:
            bound = bind_inputs(source, rule["inputs"])
            return F.to_json(F.struct(*[b.column.alias(n) for n, b in bound.items()]), {"ignoreNullFields": "false"}).alias("inputs")

        ids = mine.select("run_id", "issue_id", "rule_id", "entity_id", "project_id")
        by_entity = ids.where(~of_project).join(entities.drop("project_id", "rule_id", "issue_id"), ["run_id", "entity_id"], "left")
        by_project = ids.where(of_project).join(projects.drop("rule_id", "issue_id", "run_id", "entity_id"), "project_id")
        parts += [side.select("rule_id", name.alias("name"), case(side)) for side in (by_entity, by_project)]
    return reduce(DataFrame.unionByName, parts).join(known.select("rule_id", "name"), ["rule_id", "name"], "left_anti")


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _items(v: Column, key: str) -> Column:
    """What a variant holds under a key as an array: its items, or the value itself."""
    one = F.try_variant_get(v, f"$.{key}", "variant")
    none = F.array().cast("array<variant>")
    alone = F.when(one.isNull() | (_kind(one) == "VOID"), none).otherwise(F.array(one))
    return F.when(_kind(one).startswith("ARRAY"), F.try_variant_get(v, f"$.{key}", "array<variant>")).otherwise(alone)


def _objects(v: Column, key: str) -> Column:
    return F.filter(_items(v, key), lambda x: _kind(x).startswith("OBJECT"))


def _text(v: Column, *keys: str) -> Column:
    """The first non-empty text under the keys."""
    return F.coalesce(*[F.nullif(F.trim(F.try_variant_get(v, f"$.{k}", "string")), F.lit("")) for k in keys])


def flatten_failures(reports: DataFrame) -> DataFrame:
    """report_id, ordinal, specification, requirement, entity, actual, expected and message of each failed entity.

    reports: report_id, body (variant). A requirement fails by its status, or without one by having failed entities; one
    without entities gives one row.
    """
    spec = reports.select("report_id", F.posexplode(_objects(F.col("body"), "specifications")).alias("i", "s"))
    needs = spec.select("report_id", "i", _text(F.col("s"), "name", "description", "identifier").alias("specification"), F.posexplode(F.concat(*[_objects(F.col("s"), k) for k in REQUIREMENT_KEYS])).alias("j", "r"))
    r, e = F.col("r"), F.col("e")
    status = F.try_variant_get(r, "$.status", "variant")
    word = F.lower(F.try_variant_get(r, "$.status", "string"))
    needs = needs.withColumn("found", F.concat(*[_items(r, k) for k in FAILED_KEYS]))
    failed = F.when(_kind(status).isin("BOOLEAN", "STRING"), word.isin(FAILED_WORDS)).otherwise(F.size("found") > 0)
    rows = needs.where(failed).select("report_id", "i", "j", "specification", "r", F.posexplode_outer("found").alias("k", "e"))
    kind, key = _text(e, "type", "class", "ifc_class", "entity"), _text(e, "global_id", "globalId", "GlobalId", "id")
    named = F.coalesce(F.when(kind.isNotNull() & key.isNotNull(), F.concat(kind, F.lit(":"), key)), key, _text(e, "name", "Name"), kind)
    entity = F.when(_kind(e).startswith("OBJECT"), named).otherwise(F.nullif(F.trim(F.try_variant_get(e, "$", "string")), F.lit("")))
    flat = rows.select(
        "report_id", F.struct("i", "j", F.coalesce("k", F.lit(0)).alias("k")).alias("at"), "specification",
        F.coalesce(_text(r, "description", "requirement", "label", "name", "facet_type", "sentence"), "specification", F.lit("requirement failed")).alias("requirement"),
        entity.alias("entity"),
        F.coalesce(_text(e, "actual", "actual_value", "value"), _text(r, "actual", "actual_value", "value")).alias("actual"),
        F.coalesce(_text(e, "expected", "expected_value", "restriction", "value"), _text(r, "expected", "expected_value", "restriction", "value")).alias("expected"),
        _text(r, "message", "reason", "failure", "error").alias("message"),
    )
    order = Window.partitionBy("report_id").orderBy("at")
    return flat.withColumn("ordinal", F.row_number().over(order)).drop("at")
