"""Runs over time: differences, review state, queues and roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planaudit.operators.maintain import STATUSES

CHANGES = ["severity", "message", "bbox", "evidence"]
SEVERITY_RANK = ["error", "warning", "info"]
# Places that numbers are rounded to before they are compared.
PLACES = 4
#: Occurrences of equal rows that are expanded in one piece.
AT_ONCE = 65_536
# Checklist states that are closed.
CLOSED = ["done", "skipped_preview"]
# Stages of checklist items, with the counter of each.
STAGES = {"readiness": "readiness_items", "primary_issue_review": "primary_issue_items", "per_sheet_preview": "preview_items", "handoff": "handoff_items"}


def _rounded(col: Column, kind: T.DataType) -> Column:
    """A value with all floating numbers in it rounded."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.round(col, PLACES)
    if isinstance(kind, T.StructType):
        return F.when(col.isNotNull(), F.struct(*[_rounded(col[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: _rounded(x, kind.elementType))
    return col


def rounded(df: DataFrame, names: list[str]) -> DataFrame:
    """df with the floating numbers in these columns, however deep, rounded, so that noise is no change."""
    return df.withColumns({n: _rounded(F.col(n), df.schema[n].dataType) for n in names})


def fingerprint(df: DataFrame, group: list[str], rest: list[str]) -> tuple[Column, Column]:
    """L2: a short hash of canonical JSON (sorted names, nulls kept, numbers rounded) for the group key, and the sort key in a group."""
    value = {n: _rounded(F.col(n), df.schema[n].dataType).alias(n) for n in group + rest}
    canonical = [F.to_json(F.struct(*[value[n] for n in sorted(names)]), {"ignoreNullFields": "false"}) for names in (group, group + rest)]
    return F.substring(F.sha2(canonical[0], 256), 1, 16), canonical[1]


def changed_fields(fields: list[str]) -> Column:
    """L3: names, in the given order, of the fields that differ between before and after."""
    return F.array_compact(F.array(*[F.when(~F.col(f"before.{f}").eqNullSafe(F.col(f"after.{f}")), F.lit(f)) for f in fields]))


def diff_counts(before: DataFrame, after: DataFrame, group: list[str], fields: list[str]) -> DataFrame:
    """L1 in ranges: group_key, first and n (occurrences first + 1 to first + n of a group), before, after, status, changed.

    Equal rows of a run are counted before anything else, so each is one row with a range of occurrences, in order of
    canonical text. Where ranges of the two runs begin or end, a group is cut; every piece has one row of each run at most.
    """

    def ranges(df: DataFrame, side: str) -> DataFrame:
        key, sort = fingerprint(df, group, fields)
        rows = rounded(df.withColumn("group_key", key).withColumn("_sort", sort), group + fields)
        rows = rows.groupBy("group_key", "_sort").agg(F.count("*").alias("n"), F.first(F.struct(*group, *fields)).alias("row"))
        rows = rows.withColumn("stop", F.sum("n").over(Window.partitionBy("group_key").orderBy("_sort")))
        return rows.select("group_key", (F.col("stop") - F.col("n")).alias("at"), F.struct("stop", "row").alias(side))

    sides = [ranges(before, "before"), ranges(after, "after")]
    ends = [r.groupBy("group_key").agg(F.max(f"{side}.stop").alias("at")) for r, side in zip(sides, ("before", "after"), strict=True)]
    cuts = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [*sides, *ends])
    cuts = cuts.groupBy("group_key", "at").agg(F.first("before", True).alias("before"), F.first("after", True).alias("after"))
    order = Window.partitionBy("group_key").orderBy("at")
    held = {side: F.last(side, True).over(order.rowsBetween(Window.unboundedPreceding, 0)) for side in ("before", "after")}
    pieces = cuts.withColumns(held | {"n": F.lead("at").over(order) - F.col("at")}).where("n is not null")
    pieces = pieces.withColumns({side: F.when(F.col(f"{side}.stop") > F.col("at"), F.col(f"{side}.row")) for side in ("before", "after")})
    both = pieces.where("before is not null or after is not null").select("group_key", F.col("at").alias("first"), "n", "before", "after")
    changed = F.when(F.col("before").isNotNull() & F.col("after").isNotNull(), changed_fields(fields)).otherwise(F.array().cast("array<string>"))
    status = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "resolved").when(F.size(changed) > 0, "changed").otherwise("unchanged")
    return both.withColumn("status", status).withColumn("changed", changed)


def diff_runs(before: DataFrame, after: DataFrame, group: list[str], fields: list[str]) -> DataFrame:
    """L1: unchanged, changed, new or resolved, matched by group and occurrence in it; ids are not compared, numbers to 4 places.

    One row for each occurrence. Long ranges of equal rows are dealt in pieces before they are expanded.
    """
    rows = diff_counts(before, after, group, fields).withColumn("stop", F.col("first") + F.col("n"))
    steps = F.explode(F.sequence(F.col("first"), F.col("stop") - 1, F.lit(AT_ONCE).cast("long")))
    long = rows.where(F.col("n") > AT_ONCE).withColumn("first", steps).withColumn("stop", F.least("stop", F.col("first") + AT_ONCE))
    parts = rows.where(F.col("n") <= AT_ONCE).unionByName(long.repartition("group_key", "first"))
    parts = parts.withColumn("occurrence", F.explode(F.sequence(F.col("first") + 1, "stop")))
    return parts.select("group_key", F.col("occurrence").cast("int").alias("occurrence"), "before", "after", "status", "changed")


#: What names an issue where ids are unique; with files' own ids, pass ("run_id", "issue_id").
ISSUE = ("issue_id",)
# Columns of the review state beside its keys.
STATE = {"status": "string", "reviewer": "string", "note": "string", "target_run": "string", "source_run": "string", "created_at": "timestamp", "updated_at": "timestamp"}


def _state(df: DataFrame, keys: tuple[str, ...] = ISSUE) -> DataFrame:
    """The keys and all columns of the review state, null where df lacks one."""
    return df.select(*keys, *[(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in STATE.items()])


def build_state(issues: DataFrame, prior: DataFrame, now: Column, run_id: str | None = None, keys: tuple[str, ...] = ISSUE) -> DataFrame:
    """L4: earlier decisions stay by issue with all they hold, new issues are candidates, issues that are gone are dropped."""
    old = _state(prior, keys).withColumn("_old", F.lit(True))
    both = issues.select(*keys).join(old, list(keys), "left")
    fresh = F.col("_old").isNull()
    new = {"status": F.lit("candidate"), "source_run": F.lit(run_id), "created_at": now, "updated_at": now}
    rows = both.withColumns({c: F.when(fresh, v.cast(STATE[c])).otherwise(F.col(c)) for c, v in new.items()})
    return rows.withColumn("updated_at", F.coalesce("updated_at", now)).drop("_old")


def apply_transitions(state: DataFrame, updates: DataFrame, keys: tuple[str, ...] = ISSUE) -> tuple[DataFrame, DataFrame]:
    """The latest legal update of each known issue is applied; the others come back with a reason.

    updates(keys, status, target_run, reviewer, note, at): an empty status and
    `open` mean candidate; only superseded has a target run, and needs one. A reviewer
    or note that is given replaces the old one (an empty one removes it); an issue
    without a legal update stays as it is.
    """
    given = F.lower(F.trim(F.coalesce("status", F.lit(""))))
    rows = updates.withColumns({c: F.lit(None).cast("string") for c in ("target_run", "reviewer", "note") if c not in updates.columns})
    rows = rows.withColumn("status", F.when(given.isin("", "open"), "candidate").otherwise(given)).join(state.select(*keys, F.lit(True).alias("known")), list(keys), "left")
    target = F.coalesce("target_run", F.lit("")) != ""
    reason = F.when(F.col("known").isNull(), "unknown issue").when(~F.col("status").isin(STATUSES), "unknown status").when((F.col("status") == "superseded") & ~target, "no target run").when((F.col("status") != "superseded") & target, "unexpected target run")
    rows = rows.withColumn("reason", reason)
    texts = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(f"_{c}") for c in ("reviewer", "note")]
    last = rows.where("reason is null").groupBy(*keys).agg(F.max_by(F.struct("status", "target_run", "at"), "at").alias("u"), *texts)
    both = _state(state, keys).join(last, list(keys), "left")
    done = F.col("u").isNotNull()
    kept = {c: F.when(F.col(f"_{c}").isNotNull(), F.nullif(F.col(f"_{c}"), F.lit(""))).otherwise(F.col(c)) for c in ("reviewer", "note")}
    new = {"status": F.coalesce("u.status", "status"), "updated_at": F.when(done, F.col("u.at").cast("timestamp")).otherwise(F.col("updated_at")), "target_run": F.when(done, F.when(F.col("u.status") == "superseded", F.col("u.target_run").cast("string"))).otherwise(F.col("target_run"))}
    return both.withColumns(kept | new).drop("u", "_reviewer", "_note"), rows.where("reason is not null").drop("known")


def state_summary(state: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts in lifecycle order, of all issues or of each run; statuses without an issue are left out."""
    order = F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("status")).cast("int")
    return state.groupBy(*by, "status").agg(F.count("*").alias("n")).withColumn("ordinal", order)


def page_queue(issues: DataFrame, n: int = 3, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """The first n issues of each page of a run with preview ids, and how many were left out."""
    page = [*keys, "page_index"]
    ordered = Window.partitionBy(*page).orderBy("issue_id")
    first = issues.withColumn("at", F.row_number().over(ordered)).where(F.col("at") <= n)
    counts = issues.groupBy(*page).agg(F.count("*").alias("total"))
    preview = F.format_string("sheet-%d-preview-%03d", "page_index", "at")
    return first.join(counts, page).select(*page, "issue_id", preview.alias("preview_id"), F.greatest(F.col("total") - n, F.lit(0)).alias("omitted"))


def task_sequence(stages: list[tuple[str, DataFrame, int]]) -> DataFrame:
    """Stages of (name, rows(run_id, task_id, rank), limit) in order; beyond its limit a stage has one overflow row."""
    parts = []
    for i, (name, rows, limit) in enumerate(stages):
        at = rows.withColumn("at", F.row_number().over(Window.partitionBy("run_id").orderBy("rank", "task_id"))).select("run_id", "task_id", "at")
        over = at.groupBy("run_id").agg(F.count("*").alias("c")).where(F.col("c") > limit).select("run_id", F.concat(F.lit(f"{name}: "), (F.col("c") - limit).cast("string"), F.lit(" more")).alias("task_id"), F.lit(limit + 1).alias("at"))
        parts.append(at.where(F.col("at") <= limit).unionByName(over).select(F.lit(i).alias("stage_no"), F.lit(name).alias("stage"), "*"))
    both = reduce(DataFrame.unionByName, parts)
    return both.withColumn("ordinal", F.row_number().over(Window.partitionBy("run_id").orderBy("stage_no", "at"))).drop("stage_no", "at")


def checklist_summary(items: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """items(package, ordinal, check_id, title, stage, status) to counts, the first three open titles and a status.

    Done and skipped previews are done, all else is open, blocked and needs_info
    included. A package of `packages` without an item is empty.
    """
    status = F.coalesce("status", F.lit(""))
    is_open = ~status.isin(CLOSED)
    counts = {"items": F.lit(True), "done": ~is_open, "open": is_open, "blocked": status == "blocked", "needs_info": status == "needs_info"} | {name: F.coalesce(F.col("stage") == stage, F.lit(False)) for stage, name in STAGES.items()}
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), "check_id")
    titles = F.array_sort(F.collect_list(F.when(is_open, F.struct("ordinal", title.alias("title")))))
    rows = items.groupBy("package").agg(*[F.count_if(c).alias(n) for n, c in counts.items()], F.transform(F.slice(titles, 1, 3), lambda x: x["title"]).alias("first_open"))
    if packages is not None:
        rows = packages.select("package").distinct().join(rows, "package", "left")
        rows = rows.withColumns({n: F.coalesce(n, F.lit(0)) for n in counts} | {"first_open": F.coalesce("first_open", F.array().cast("array<string>"))})
    state = F.when(F.col("items") == 0, "checklist_empty").when(F.col("blocked") > 0, "checklist_blocked").when(F.col("needs_info") > 0, "checklist_needs_info").when(F.col("open") > 0, "checklist_open").otherwise("checklist_complete")
    return rows.withColumn("state", state)


def update_checklist(items: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """updates(package, check_id or ordinal, status, reviewer, note, at, completed_at) applied to items; the rest comes back.

    Exactly one of check_id and ordinal names the item. Where the new status is closed
    the item is completed at the given time, else at the time of the update; where it
    is not, only a given time counts. Of several updates of an item the last one counts.
    """
    ids = items.select("package", F.col("check_id").alias("_id"), F.col("ordinal").alias("_at"))
    by_id = ids.select("package", F.col("_id").alias("check_id"), F.col("_id").alias("_named")).distinct()
    by_place = ids.groupBy("package", F.col("_at").alias("ordinal")).agg(F.min("_id").alias("_placed"))
    one = F.col("check_id").isNull() != F.col("ordinal").isNull()
    rows = updates.join(by_id, ["package", "check_id"], "left").join(by_place, ["package", "ordinal"], "left").withColumn("_item", F.when(one, F.coalesce("_named", "_placed"))).drop("_named", "_placed")
    last = rows.where("_item is not null").groupBy("package", F.col("_item").alias("check_id")).agg(F.max_by(F.struct("status", "reviewer", "note", "at", "completed_at"), F.struct("at", "status")).alias("u"))
    both = items.join(last, ["package", "check_id"], "left")
    done = F.col("u").isNotNull()
    time = F.when(F.col("u.status").isin(CLOSED), F.coalesce("u.completed_at", "u.at")).otherwise(F.col("u.completed_at"))
    fields = {"status": F.coalesce("u.status", "status"), "completed_at": F.when(done, time).otherwise(F.col("completed_at"))} | {c: F.when(done, F.col(f"u.{c}")).otherwise(F.col(c) if c in items.columns else F.lit(None)) for c in ("reviewer", "note")}
    return both.withColumns(fields | {"updated_at": F.col("u.at")}).drop("u"), rows.where("_item is null").select(updates.columns)


def manager_gate(packages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The five checks of each package, and its status: the worst of pass, needs_info and fail wins.

    packages(package, missing_required, quality_status, signoff_status,
    checklist_status, items, open, blocked, needs_info, boundary_missing): the last is
    the list of absent boundary warnings.
    """
    missing, absent = F.coalesce("missing_required", F.array().cast("array<string>")), F.coalesce("boundary_missing", F.array().cast("array<string>"))
    quality, signoff = (F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("missing")) for c in ("quality_status", "signoff_status"))
    tasks = F.coalesce(F.nullif(F.col("checklist_status"), F.lit("")), F.lit("not_recorded"))
    counts = F.concat(*[x for n, c in ((": open=", "open"), ("/", "items"), (", blocked=", "blocked"), (", needs_info=", "needs_info")) for x in (F.lit(n), F.coalesce(F.col(c), F.lit(0)).cast("string"))])

    def check(name: str, result: Column, detail: Column) -> Column:
        return F.struct(F.lit(name).alias("check_id"), result.alias("result"), detail.alias("detail"))

    rows = F.array(
        check("required_artifacts_present", F.when(F.size(missing) == 0, "pass").otherwise("fail"), F.when(F.size(missing) == 0, "all required artifacts present").otherwise(F.concat(F.lit("missing required artifacts: "), F.array_join(missing, ", ")))),
        check("handoff_quality_ready", F.when(quality == "handoff_ready", "pass").when(quality == "not_ready", "fail").otherwise("needs_info"), F.concat(F.lit("handoff quality "), quality)),
        check("reviewer_signoff_ready", F.when(signoff == "ready", "pass").when(signoff == "blocked", "fail").otherwise("needs_info"), F.concat(F.lit("reviewer signoff "), signoff)),
        check("reviewer_task_checklist_complete", F.when(tasks == "checklist_complete", "pass").when(tasks.isin("checklist_blocked", "not_recorded"), "fail").otherwise("needs_info"), F.concat(F.lit("reviewer checklist "), tasks, counts)),
        check("boundary_warnings_present", F.when(F.size(absent) == 0, "pass").otherwise("fail"), F.when(F.size(absent) == 0, "boundary warnings present").otherwise(F.array_join(absent, "; "))),
    )
    rank = lambda x: F.when(x["result"] == "fail", 2).when(x["result"] == "needs_info", 1).otherwise(0)
    both = packages.select("package", rows.alias("checks")).withColumn("worst", F.array_max(F.transform("checks", rank)))
    status = F.element_at(F.array(*[F.lit(x) for x in ("manager_ready", "manager_needs_info", "manager_blocked")]), F.col("worst") + 1)
    unmet = F.size(F.filter("checks", lambda x: x["result"] != "pass"))
    return both.select("package", F.inline("checks")), both.select("package", status.alias("status"), unmet.alias("n_unmet"))


# Counters of a bundle that count a value of a column of its packages.
COUNTED = {
    "ready_count": ("package_status", "package_ready"),
    "needs_info_count": ("package_status", "package_needs_info"),
    "blocked_count": ("package_status", "package_blocked"),
    "quality_not_run_count": ("quality_status", "not_run"),
    "signoff_not_recorded_count": ("signoff_status", "not_recorded"),
    "checklist_missing_count": ("checklist_review_status", "checklist_missing"),
    "next_actor_reviewer_count": ("next_actor", "reviewer"),
    "next_actor_manager_count": ("next_actor", "manager"),
    "next_actor_archive_count": ("next_actor", "archive"),
    "next_actor_done_count": ("next_actor", "done"),
    "optional_guidance_note_reviewed_count": ("optional_guidance_note_status", "reviewed"),
    "optional_guidance_note_needs_info_count": ("optional_guidance_note_status", "needs_info"),
    "optional_guidance_note_blocked_count": ("optional_guidance_note_status", "blocked"),
    "optional_guidance_note_not_recorded_count": ("optional_guidance_note_status", "not_recorded"),
    "optional_guidance_note_invalid_count": ("optional_guidance_note_status", "invalid"),
}
# Counters that sum a column, and that count the packages where one holds.
SUMMED = {
    "missing_required_total": "missing_required_count",
    "checklist_open_item_total": "checklist_open_item_count",
    "checklist_blocked_item_total": "checklist_blocked_item_count",
    "checklist_needs_info_item_total": "checklist_needs_info_item_count",
    "opening_provenance_semantic_count": "opening_provenance_semantic_count",
    "opening_provenance_measurement_count": "opening_provenance_measurement_count",
    "opening_provenance_host_count": "opening_provenance_host_count",
    "opening_provenance_all_three_count": "opening_provenance_all_three_count",
    "package_index_optional_guidance_action_total": "package_index_optional_guidance_count",
}
HOLDING = {"opening_provenance_weak_package_count": "opening_provenance_weak", "package_index_optional_guidance_package_count": "package_index_optional_guidance_available"}


def bundle_summary(packages: DataFrame) -> DataFrame:
    """One row with all counters over packages and the status of the bundle; nulls count as 0 or absent."""
    counters = [F.count("*").alias("package_count"), F.count_if(F.col("checklist_open_item_count") > 0).alias("checklist_open_package_count")]
    counters += [F.count_if(F.col(c) == v).alias(n) for n, (c, v) in COUNTED.items()]
    counters += [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for n, c in SUMMED.items()] + [F.count_if(c).alias(n) for n, c in HOLDING.items()]
    status = F.when(F.col("package_count") == 0, "bundle_empty").when(F.col("blocked_count") > 0, "bundle_blocked").when(F.col("needs_info_count") > 0, "bundle_needs_info").otherwise("bundle_ready")
    return packages.agg(*counters).withColumn("status", status)


def package_digest(files: DataFrame) -> DataFrame:
    """One digest per package over its entries in order of path, as canonical JSON (names sorted)."""
    entries = F.transform(F.array_sort(F.collect_list(F.struct("path", "sha256", "size_bytes"))), lambda x: F.struct(x["path"].alias("path"), x["sha256"].alias("sha256"), x["size_bytes"].alias("size_bytes")))
    return files.groupBy("package").agg(F.count("*").alias("n_files"), F.sha2(F.to_json(entries), 256).alias("digest"))


def file_role(path: Column) -> Column:
    """What a file of a package is for, by its path."""
    return (
        F.when(path.startswith("artifacts/"), "copied_artifact")
        .when(path.isin("handoff_manifest.json", "handoff_summary.md"), "package_manifest")
        .when(path.startswith("handoff_quality"), "quality")
        .when(path.startswith("reviewer_signoff"), "signoff")
        .when(path.startswith("handoff_manager_checklist"), "manager_checklist")
        .otherwise("package_file")
    )


def verify_manifest(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Package, path and ok, missing, changed (size or hash) or unexpected."""
    sides = [df.select("package", "path", F.struct(F.coalesce("sha256", F.lit("")).alias("sha256"), F.coalesce("size_bytes", F.lit(0)).cast("long").alias("size_bytes")).alias(side)) for df, side in ((expected, "e"), (actual, "a"))]
    both = sides[0].join(sides[1], ["package", "path"], "full")
    return both.select("package", "path", F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "unexpected").when(F.col("a") != F.col("e"), "changed").otherwise("ok").alias("status"))


def archive_checks(expected: DataFrame, actual: DataFrame, digests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The checks of each package with their severity and number of findings, and archive_verified or archive_drift.

    digests(package, digest) is what the manifest says; any failed check is drift.
    """
    files = verify_manifest(expected, actual).groupBy("package").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("missing", "changed", "unexpected")])
    found = digests.select("package", F.col("digest").alias("e")).join(package_digest(actual).select("package", F.col("digest").alias("a")), "package", "left").join(files, "package", "left")
    apart = F.coalesce((F.col("e") != F.coalesce("a", F.lit(""))).cast("long"), F.lit(1))
    counts = {"manifest_schema": ("blocker", F.lit(0)), "files_present": ("blocker", F.col("missing")), "file_checksums_match": ("blocker", F.col("changed")), "no_unexpected_files": ("warning", F.col("unexpected")), "package_digest_match": ("blocker", apart)}
    rows = F.array(*[F.struct(F.lit(n).alias("check_id"), F.lit(s).alias("severity"), F.coalesce(c.cast("long"), F.lit(0)).alias("n")) for n, (s, c) in counts.items()])
    checks = found.select("package", F.inline(rows))
    return checks, checks.groupBy("package").agg(F.when(F.sum("n") > 0, "archive_drift").otherwise("archive_verified").alias("status"))


def report_rows(issues: DataFrame, state: DataFrame, clauses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Issues with their state (default candidate), and only the clauses they cite."""
    rows = issues.join(state.select("issue_id", F.col("status").alias("_s")), "issue_id", "left").withColumn("status", F.coalesce("_s", F.lit("candidate"))).drop("_s")
    return rows, clauses.join(issues.select("clause_id"), "clause_id", "left_semi")
