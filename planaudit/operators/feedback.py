"""Reviewer feedback, calibration and quality figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planaudit.operators.maintain import INDEPENDENT, INTERNAL, REVIEWER_CLASSES, SYNTHETIC, SYNTHETIC_PREFIXES
from planaudit.operators.rules import domain_counts

# Event types and the status each one sets; a comment sets none.
STATUS_OF = {"confirm": "confirmed", "reject": "rejected", "needs_info": "needs_info", "resolve": "resolved", "supersede": "superseded"}
# Confidence bins, closed below and open above; the last holds 1.
BINS = [(0.0, 0.2), (0.2, 0.4), (0.4, 0.6), (0.6, 0.8), (0.8, 1.001)]
# Severities in order.
SEVERITIES = ["error", "warning", "info"]
# What earns full marks, and the deviation that earns none.
FULL_PRECISION, FULL_RECALL, FULL_CASES = 0.85, 0.75, 15.0
FULL_AND_ZERO_DEVIATION, LEAST_BINS = (0.04, 0.20), 3


def _status(event: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, status in STATUS_OF.items():
        out = F.when(event == name, status).otherwise(out)
    return out


def status_from_events(events: DataFrame) -> DataFrame:
    """the latest event that sets a status wins."""
    rows = events.withColumn("s", _status(F.col("event_type"))).where("s is not null")
    return rows.groupBy("issue_id").agg(F.max_by("s", "event_id").alias("status"))


def rule_posteriors(events: DataFrame, issues: DataFrame, rules: DataFrame, a: float = 1.0, b: float = 1.0) -> DataFrame:
    """F2: Beta posterior of a rule's precision; only rules with a confirm or reject. Events are summed per issue before the join."""
    votes = events.where("event_type in ('confirm', 'reject')").groupBy("issue_id").agg(F.count_if(F.col("event_type") == "confirm").alias("c"), F.count_if(F.col("event_type") == "reject").alias("r"))
    sums = issues.select("issue_id", "rule_key").join(votes, "issue_id").groupBy("rule_key").agg(F.sum("c").alias("confirms"), F.sum("r").alias("rejects"))
    rows = sums.join(rules.select("rule_key", "rule_id"), "rule_key")
    alpha, beta = a + F.col("confirms"), b + F.col("rejects")
    return rows.select("rule_id", "confirms", "rejects", alpha.alias("alpha"), beta.alias("beta"), (alpha / (alpha + beta)).alias("mean"))


def calibrate(issues: DataFrame, posteriors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """issues with the posterior mean of their rule as confidence, and per rule how many were changed."""
    both = issues.join(posteriors.select("rule_id", F.col("mean").alias("_m")), "rule_id", "left")
    changed = both.where(F.col("_m").isNotNull() & ~F.col("confidence").eqNullSafe(F.col("_m"))).groupBy("rule_id").agg(F.count("*").alias("n_changed"))
    return both.withColumn("confidence", F.coalesce("_m", "confidence")).drop("_m"), changed


def reliability(issues: DataFrame, events: DataFrame, bins: list[tuple[float, float]] = BINS, min_n: int = 5) -> DataFrame:
    """per bin the confirms and rejects of its issues, their share of confirms and its distance from the bin's middle.

    The sample of a bin is its number of confirms and rejects; without any the
    precision is 0. `used` marks the bins with at least min_n.
    """
    votes = events.where("event_type in ('confirm', 'reject')").groupBy("issue_id").agg(*[F.count_if(F.col("event_type") == e).alias(e) for e in ("confirm", "reject")])
    judged = issues.where("confidence is not null").select("issue_id", "confidence").join(votes, "issue_id")
    at = F.lit(None).cast("int")
    for i, (low, high) in enumerate(bins):
        at = F.when((F.col("confidence") >= low) & (F.col("confidence") < high), i).otherwise(at)
    sums = judged.withColumn("bin", at).where("bin is not null").groupBy("bin").agg(F.sum("confirm").alias("c"), F.sum("reject").alias("r"))
    known = issues.sparkSession.createDataFrame([(i, low, high, (low + min(high, 1.0)) / 2) for i, (low, high) in enumerate(bins)], "bin int, low double, high double, middle double")
    rows = sums.join(F.broadcast(known), "bin", "right")
    confirmed, rejected = F.coalesce("c", F.lit(0)), F.coalesce("r", F.lit(0))
    rows = rows.select("bin", "low", "high", "middle", confirmed.alias("confirmed"), rejected.alias("rejected"), (confirmed + rejected).alias("n"))
    precision = F.coalesce(F.try_divide("confirmed", "n"), F.lit(0.0))
    return rows.select("bin", "low", "high", "n", "confirmed", "rejected", precision.alias("precision"), F.abs(F.col("middle") - precision).alias("deviation"), (F.col("n") >= min_n).alias("used"))


def mean_deviation(bins: DataFrame) -> DataFrame:
    """status, number of bins with enough samples and their mean deviation, to 4 places."""
    rows = bins.agg(F.count_if("used").alias("bins_used"), F.round(F.avg(F.when(F.col("used"), F.col("deviation"))), 4).alias("mean_abs_deviation"))
    return rows.select(F.when(F.col("bins_used") > 0, "ok").otherwise("no_bin_with_enough_samples").alias("status"), "bins_used", "mean_abs_deviation")


def rule_quality(issues: DataFrame, events: DataFrame, rules: DataFrame, expected: DataFrame) -> DataFrame:
    """per rule with issues: distinct issues, confirms (tp) and rejects (fp) of them, precision and recall.

    Recall needs an expected count: fn = max(0, expected - detected). Without one
    both are null.
    """
    votes = events.groupBy("issue_id").agg(F.count_if(F.col("event_type") == "confirm").alias("c"), F.count_if(F.col("event_type") == "reject").alias("r"))
    rows = issues.join(rules.select("rule_key", "rule_id"), "rule_key").join(votes, "issue_id", "left")
    sums = rows.groupBy("rule_id").agg(F.count("*").alias("detected"), F.coalesce(F.sum("c"), F.lit(0)).alias("tp"), F.coalesce(F.sum("r"), F.lit(0)).alias("fp"))
    both = sums.join(expected.select("rule_id", F.col("n").alias("expected")), "rule_id", "left")
    both = both.withColumn("fn", F.when(F.col("expected").isNotNull(), F.greatest(F.lit(0), F.col("expected") - F.col("detected"))))
    return both.select("rule_id", "detected", "expected", "tp", "fp", "fn", F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"))


def quality_totals(per_rule: DataFrame) -> DataFrame:
    """precision weighted by sample, recall weighted by true positives (both to 4 places), and how many rules have them."""
    sample, has_recall = F.col("tp") + F.col("fp"), F.col("recall").isNotNull() & (F.col("tp") > 0)
    weighted = [F.round(F.try_divide(F.sum(F.when(has, value * weight)), F.sum(F.when(has, weight))), 4) for has, value, weight in ((sample > 0, F.col("precision"), sample), (has_recall, F.col("recall"), F.col("tp")))]
    return per_rule.agg(weighted[0].alias("weighted_precision"), weighted[1].alias("weighted_recall"), F.count_if(sample > 0).alias("rules_with_precision"), F.count_if(has_recall).alias("rules_with_recall"))


def expected_counts(docs: DataFrame) -> DataFrame:
    """counts(map) summed per rule; keys that start with _ are notes."""
    return docs.select(F.explode("counts").alias("rule_id", "n")).where(~F.col("rule_id").startswith("_")).groupBy("rule_id").agg(F.sum("n").alias("n"))


def running_posterior(events: DataFrame, a: float = 1.0, b: float = 1.0, bucket: int = 4096) -> DataFrame:
    """the posterior mean after every confirm or reject of a rule, and whether it fell.

    Events are ordered within buckets of ids; a bucket starts from the sums of those
    before it, so no rule is gathered whole.
    """
    rows = events.where("event_type in ('confirm', 'reject')").select("rule_id", "event_id", F.when(F.col("event_type") == "confirm", 1).otherwise(0).alias("c"), F.floor(F.col("event_id") / bucket).alias("bucket"))
    sums = rows.groupBy("rule_id", "bucket").agg(F.sum("c").alias("c0"), F.count("*").alias("n0"))
    earlier = Window.partitionBy("rule_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = sums.select("rule_id", "bucket", F.coalesce(F.sum("c0").over(earlier), F.lit(0)).alias("c0"), F.coalesce(F.sum("n0").over(earlier), F.lit(0)).alias("n0"))
    so_far = Window.partitionBy("rule_id", "bucket").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("cs", F.sum("c").over(so_far)).withColumn("ns", F.count("*").over(so_far)).join(start, ["rule_id", "bucket"])
    n, confirms = F.col("n0") + F.col("ns"), F.col("c0") + F.col("cs")
    mean, before = (a + confirms) / (a + b + n), (a + confirms - F.col("c")) / (a + b + n - 1)
    return rows.select("rule_id", "event_id", mean.alias("mean"), F.when(n > 1, mean < before).alias("fell"))


def _named_synthetic(reviewer: Column) -> Column:
    name = F.trim(reviewer)
    return reduce(lambda x, y: x | y, [name.startswith(p) for p in SYNTHETIC_PREFIXES])


def reviewer_class(reviewer: Column, explicit: Column) -> Column:
    """F8: the explicit class, else synthetic by prefix, else internal; a synthetic name is never independent."""
    return F.when(_named_synthetic(reviewer) & (explicit.isNull() | (explicit == INDEPENDENT)), SYNTHETIC).when(explicit.isNotNull(), explicit).otherwise(INTERNAL)


def classify_reviewers(reviewers: DataFrame) -> DataFrame:
    """F8: reviewers(reviewer_id, reviewer_class) with their class."""
    return reviewers.withColumn("class", reviewer_class(F.col("reviewer_id"), F.col("reviewer_class")))


def instance_labels(events: DataFrame, reviewers: DataFrame) -> DataFrame:
    """events whose payload (variant) marks a label, with the class that the payload names, else that of the reviewer's name.

    A reviewer who is not listed is <unknown>; a class that is none of the three is synthetic.
    """
    rows = events.where(F.try_variant_get("payload", "$.instance_label", "boolean"))
    known = reviewers.select("reviewer_id", F.lit(True).alias("_k")).distinct()
    rows = rows.join(known, "reviewer_id", "left").withColumn("reviewer_id", F.when(F.col("_k"), F.col("reviewer_id")).otherwise("<unknown>")).drop("_k")
    given = F.nullif(F.try_variant_get("payload", "$.reviewer_class", "string"), F.lit(""))
    named = F.coalesce(given, reviewer_class(F.col("reviewer_id"), F.lit(None).cast("string")))
    return rows.withColumn("class", F.when(named.isin(REVIEWER_CLASSES), named).otherwise(SYNTHETIC)).withColumn("note", F.coalesce(F.try_variant_get("payload", "$.note", "string"), F.lit("")))


def label_provenance(events: DataFrame, reviewers: DataFrame) -> DataFrame:
    """one row: reviewers of each class, label events, shares of reviewers and events, and whether any review is independent."""
    labels = instance_labels(events, reviewers).agg(*[F.count_distinct(F.when(F.col("class") == c, F.col("reviewer_id"))).alias(f"{c}_reviewer_count") for c in (INTERNAL, INDEPENDENT)], F.count("*").alias("instance_label_event_count"))
    people = reviewers.select("reviewer_id").distinct().agg(F.count("*").alias("_people"), F.count_if(_named_synthetic(F.col("reviewer_id"))).alias("synthetic_reviewer_count"))
    total = events.agg(F.count("*").alias("_events"))
    # three tables of one row each
    rows = labels.join(F.broadcast(people), F.lit(True)).join(F.broadcast(total), F.lit(True))
    human = F.col(f"{INTERNAL}_reviewer_count") + F.col(f"{INDEPENDENT}_reviewer_count")
    return rows.select(
        "synthetic_reviewer_count",
        f"{INTERNAL}_reviewer_count",
        f"{INDEPENDENT}_reviewer_count",
        "instance_label_event_count",
        human.alias("instance_label_reviewer_count"),
        F.coalesce(F.try_divide("synthetic_reviewer_count", "_people"), F.lit(0.0)).alias("synthetic_label_share"),
        F.coalesce(F.try_divide("instance_label_event_count", "_events"), F.lit(0.0)).alias("human_validated_share"),
        (F.col(f"{INDEPENDENT}_reviewer_count") > 0).alias("any_independent_review"),
    )


def score_cases(expected: DataFrame, actual: DataFrame, info_rules: DataFrame | None = None) -> DataFrame:
    """(case_id, rule_id) with tp, fp or fn; info rules count only where they are expected."""
    e, a = expected.select("case_id", "rule_id").distinct().withColumn("e", F.lit(True)), actual.select("case_id", "rule_id").distinct().withColumn("a", F.lit(True))
    both = e.join(a, ["case_id", "rule_id"], "full")
    if info_rules is not None:
        both = both.join(info_rules.select("rule_id").distinct().withColumn("i", F.lit(True)), "rule_id", "left").where("i is null or e is not null").drop("i")
    return both.select("case_id", "rule_id", F.when(F.col("e") & F.col("a"), "tp").when(F.col("a"), "fp").otherwise("fn").alias("outcome"))


def scoreboard(scored: DataFrame) -> DataFrame:
    """counts, precision, recall and F1 per rule and overall (null rule_id), in one pass."""
    rows = scored.rollup("rule_id").agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("tp", "fp", "fn")])
    return rows.select("rule_id", "tp", "fp", "fn", F.expr("try_divide(tp, tp + fp)").alias("precision"), F.expr("try_divide(tp, tp + fn)").alias("recall"), F.expr("try_divide(2 * tp, 2 * tp + fp + fn)").alias("f1"))


def fire_rates(findings: DataFrame, targets: DataFrame, n_cases: int) -> DataFrame:
    """cases and findings of each target rule, zero-filled, as shares of n_cases."""
    sums = findings.groupBy("rule_id").agg(F.countDistinct("case_id").alias("c"), F.count("*").alias("f"))
    rows = targets.select("rule_id").join(sums, "rule_id", "left").select("rule_id", F.coalesce("c", F.lit(0)).alias("cases"), F.coalesce("f", F.lit(0)).alias("findings"))
    return rows.select("*", (F.col("cases") / n_cases).alias("rate"), (F.col("findings") / n_cases).alias("mean_per_case"))


def issue_metrics(issues: DataFrame, tiers: DataFrame, k: int = 6) -> DataFrame:
    """section, key, n, percent of all issues and tier; ties among the top k go to the smaller id.

    severity: error, warning, info and other (a null counts as info), zero-filled;
    rule: the k rules with most issues, with their tier, else UNKNOWN; tier: how many
    of these rules are of each tier; clause: the k most cited clauses, without percent.
    """
    level = F.coalesce("severity", F.lit("info"))
    severities = domain_counts(issues.select(F.when(level.isin(*SEVERITIES), level).otherwise("other").alias("severity")), "severity", [*SEVERITIES, "other"]).select(F.col("value").alias("key"), "n")
    total = issues.agg(F.count("*").alias("t"))

    def top(col: str) -> DataFrame:
        return issues.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("key")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(k)

    rules = top("rule_id").join(tiers.select(F.col("rule_id").alias("key"), "tier"), "key", "left").select("key", "n", F.coalesce("tier", F.lit("UNKNOWN")).alias("tier"))
    parts = [severities.select(F.lit("severity").alias("section"), "key", "n", F.lit(None).cast("string").alias("tier")), rules.select(F.lit("rule").alias("section"), "key", "n", "tier")]
    parts.append(rules.groupBy("tier").agg(F.count("*").alias("n")).select(F.lit("tier").alias("section"), F.col("tier").alias("key"), "n", "tier"))
    parts.append(top("clause_id").select(F.lit("clause").alias("section"), "key", "n", F.lit(None).cast("string").alias("tier")))
    rows = reduce(DataFrame.unionByName, parts).join(F.broadcast(total), F.lit(True))
    percent = F.when(F.col("section") != "clause", 100.0 * F.col("n") / F.greatest("t", F.lit(1)))
    return rows.select("section", "key", "n", percent.alias("percent"), "tier")


def clause_refs(issues: DataFrame, clauses: DataFrame, k: int = 5) -> DataFrame:
    """the k most cited clauses, their text cut to 85 characters."""
    top = issues.where("clause_id is not null").groupBy("clause_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "clause_id").limit(k)
    text = F.when(F.length("clause_text") > 85, F.concat(F.substring("clause_text", 1, 82), F.lit("..."))).otherwise(F.col("clause_text"))
    return top.join(clauses, "clause_id", "left").select("clause_id", "n", text.alias("text"))


def release_gate(cases: DataFrame, artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """F16: the checks of each suite, and its numbers of failed blockers and warnings with a status.

    cases(suite, fixture_kind, status): pass and fail are active, beside pending and
    known_gap. artifacts(suite, artifact, tier, available) of its representative run; a
    suite without any only gets a warning in place of the two artifact checks.
    """
    passed = F.col("status") == "pass"
    counts = {
        "failed": ~F.col("status").isin("pass", "pending", "known_gap"),
        "active": ~F.col("status").isin("pending", "known_gap"),
        "pending": F.col("status") == "pending",
        "gaps": F.col("status") == "known_gap",
        "real": passed & F.col("fixture_kind").startswith("real_"),
        "generated": passed & F.col("fixture_kind").startswith("generated_"),
    }
    suites = cases.groupBy("suite").agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    lacking = [F.array_sort(F.collect_list(F.when((F.col("tier") == t) & ~F.col("available"), F.col("artifact")))).alias(t) for t in ("core", "evidence")]
    rows = suites.join(artifacts.groupBy("suite").agg(*lacking), "suite", "left")
    none, given = F.array().cast("array<string>"), F.col("core").isNotNull()

    def check(name: str, ok: Column, severity: str, missing: Column = none) -> Column:
        return F.struct(F.lit(name).alias("check_id"), ok.alias("passed"), F.lit(severity).alias("severity"), missing.alias("missing"))

    own = F.array(
        check("suite:active-pass", F.col("failed") == 0, "blocker"),
        check("suite:active-count", F.col("active") >= 1, "blocker"),
        check("suite:real-active", F.col("real") >= 1, "blocker"),
        check("suite:known-gaps", F.col("gaps") == 0, "warning"),
        check("suite:pending", F.col("pending") == 0, "warning"),
        check("suite:generated-not-proxy", F.col("generated") <= F.col("real"), "warning"),
    )
    run = F.when(given, F.array(check("run:core-artifacts", F.size("core") == 0, "blocker", F.col("core")), check("run:evidence-artifacts", F.size("evidence") == 0, "warning", F.col("evidence")))).otherwise(F.array(check("run:representative-run", F.lit(False), "warning")))
    checks = rows.select("suite", F.inline(F.concat(own, run)))
    sums = checks.groupBy("suite").agg(*[F.count_if(~F.col("passed") & (F.col("severity") == s)).alias(f"{s}s") for s in ("blocker", "warning")])
    return checks, sums.withColumn("status", F.when(F.col("blockers") > 0, "not_ready").when(F.col("warnings") > 0, "demo_ready_with_known_gaps").otherwise("evidence_ready"))


def weakest_link(scores: DataFrame) -> DataFrame:
    """scores(name, score in 0..10): overall = min(sum, min * n), as a share of 10 * n in percent.

    at_99 needs every score at 9 or more and three quarters of them (rounded, one at
    least) at 10.
    """
    rows = scores.agg(F.sum("score").alias("s"), F.min("score").alias("m"), F.count("*").alias("n"), F.count_if(F.col("score") == 10).alias("full"), F.min_by("name", F.struct("score", "name")).alias("weakest"))
    overall = F.least(F.col("s"), F.col("m") * F.col("n")) / (10 * F.col("n")) * 100
    needed = F.greatest(F.lit(1), F.bround(0.75 * F.col("n")))
    return rows.select(overall.alias("overall"), "weakest", F.coalesce((F.col("m") >= 9) & (F.col("full") >= needed), F.lit(False)).alias("at_99"))


def score_curve(value: Column, full: float, zero: float, top: float = 10.0) -> Column:
    """`top` at `full`, 0 at `zero`, linear between, clamped outside; 0 for null."""
    return F.when(value.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(top), top * (zero - value) / (zero - full))))


def label_bonus(independent: Column, internal: Column, label_events: Column) -> Column:
    """1 for an independent reviewer and 50 label events, 0.5 for an internal one and 10, else 0."""
    return F.when((independent >= 1) & (label_events >= 50), 1.0).when((internal >= 1) & (label_events >= 10), 0.5).otherwise(0.0)


def score_dimensions(metrics: DataFrame) -> DataFrame:
    """name, score (0 to 10) and measurable, from one row of figures.

    metrics: mean_abs_deviation and bins_used (F4), weighted_precision and
    weighted_recall (F5), bonus (label_bonus), n_rules, n_real_cases, n_runs and
    n_expected_runs. What cannot be measured scores 0.
    """

    def share(x: Column, full: float) -> Column:
        return F.least(F.lit(1.0), F.coalesce(x, F.lit(0.0)) / full)

    calibrated = F.coalesce((F.col("bins_used") >= LEAST_BINS) & F.col("mean_abs_deviation").isNotNull(), F.lit(False))
    recognised = F.coalesce(F.col("n_rules") > 0, F.lit(False))
    recognition = F.least(F.lit(10.0), 4.5 * share(F.col("weighted_precision"), FULL_PRECISION) + 4.5 * share(F.col("weighted_recall"), FULL_RECALL) + F.coalesce("bonus", F.lit(0.0)))
    scores = [
        ("calibration", F.when(calibrated, score_curve(F.col("mean_abs_deviation"), *FULL_AND_ZERO_DEVIATION)), calibrated),
        ("recognition_quality", F.when(recognised, recognition), recognised),
        ("real_pdf_breadth", 10.0 * share(F.col("n_real_cases").cast("double"), FULL_CASES), F.col("n_real_cases").isNotNull()),
        ("kg_coverage", 10.0 * share(F.try_divide(F.col("n_runs").cast("double"), "n_expected_runs"), 1.0), F.col("n_runs").isNotNull()),
    ]
    rows = F.array(*[F.struct(F.lit(name).alias("name"), F.coalesce(score, F.lit(0.0)).alias("score"), measurable.alias("measurable")) for name, score, measurable in scores])
    return metrics.select(F.inline(rows))
