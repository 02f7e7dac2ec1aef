import math
import random
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from planaudit.operators import feedback, geometry, lifecycle, maintain, schedules, text
from planaudit.sources import artifacts


def test_gap_pairing_uses_the_next_start(spark):
    lines = spark.createDataFrame([(0, 0.0, 0.0, 100.0, 0.0), (0, 10.0, 0.1, 20.0, 0.0), (0, 130.0, 0.0, 200.0, 0.0)], "page int, x0 double, y0 double, x1 double, y1 double")
    got = geometry.detect_gaps(geometry.normalize_segments(lines), ["page"], 5.0, 120.0).collect()
    assert [(r.start, r.stop) for r in got] == [(20.0, 130.0)]


def test_point_in_concave_polygon(spark):
    shape = [(0, 0), (10, 0), (10, 10), (5, 5), (0, 10)]
    df = spark.createDataFrame([(x, y, [{"x": float(a), "y": float(b)} for a, b in shape]) for x, y in [(5.0, 8.0), (5.0, 5.0), (1.0, 1.0), (0.0, 4.0), (11.0, 1.0)]], "x double, y double, polygon array<struct<x: double, y: double>>")
    assert [r[0] for r in df.select(geometry.contains(F.col("polygon"), F.col("x"), F.col("y"))).collect()] == [False, True, True, True, False]


def test_dimension_binding(spark):
    texts = spark.createDataFrame([(0, 0, "DOOR 900", 0.0, 0.0), (0, 1, "1.1", 5.0, 0.0), (0, 2, "door 0.8", 1.0, 0.0), (0, 3, "door 7", 50.0, 0.0)], "page int, text_idx int, text string, x double, y double")
    targets = spark.createDataFrame([(0, "door", "d1", 1.0, 1.0), (0, "corridor", "c1", 5.0, 1.0)], "page int, kind string, target_id string, x double, y double")
    got = {r.target_id: r.value_m for r in geometry.bind_dimensions(texts, targets, ["page"], 10.0).collect()}
    assert got == {"d1": 0.8, "c1": 1.1}


def test_posterior_is_closed_form(spark):
    events = spark.createDataFrame([(i, 1, t) for i, t in enumerate(["reject", "reject", "reject", "confirm", "comment"])], "event_id long, issue_id long, event_type string")
    issues = spark.createDataFrame([(1, 1, 0.4)], "issue_id long, rule_key long, confidence double")
    rule = spark.createDataFrame([(1, "R")], "rule_key long, rule_id string")
    assert feedback.rule_posteriors(events, issues, rule).first()["mean"] == 2 / 6
    assert feedback.reliability(issues, events).where("n > 0").first()["bin"] == 2


def test_diff_handles_duplicate_groups(spark):
    a = spark.createDataFrame([("R", "m1"), ("R", "m1"), ("S", "x")], "rule string, message string")
    b = spark.createDataFrame([("R", "m1"), ("R", "m2"), ("T", "x")], "rule string, message string")
    got = sorted((r.status, tuple(r.changed)) for r in lifecycle.diff_runs(a, b, ["rule"], ["message"]).collect())
    assert got == [("changed", ("message",)), ("new", ()), ("resolved", ()), ("unchanged", ())]


def test_transitions_reject_illegal_updates(spark):
    state = spark.createDataFrame([("i1", "candidate"), ("i2", "candidate")], "issue_id string, status string")
    updates = spark.createDataFrame([("i1", "rejected", None, 1), ("i1", "open", None, 2), ("i2", "superseded", None, 1), ("i3", "confirmed", None, 1)], "issue_id string, status string, target_run string, at int")
    new, rejects = lifecycle.apply_transitions(state, updates)
    assert {r.issue_id: r.status for r in new.collect()} == {"i1": "candidate", "i2": "candidate"}
    assert sorted(r.reason for r in rejects.collect()) == ["no target run", "unknown issue"]


def test_replay_changes_nothing(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "run_id long, v string")
    new = spark.createDataFrame([(2, "c")], "run_id long, v string")
    once = maintain.replace_partition(base, new)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, maintain.replace_partition(once, new).collect())) == [(1, "a"), (2, "c")]


def test_room_schedule_precedence(spark):
    rooms = spark.createDataFrame([("A", "r1", "bath", 2.0), ("A", "r2", "bath", None), ("B", "r1", "bath", 2.1)], "project_id string, room_id string, label string, h double")
    rows = [("A", 0, None, "bath", 2.4), ("A", 1, "r1", None, 2.6), ("A", 2, "r1", None, None), ("B", 0, "r2", None, 9.0)]
    sched = spark.createDataFrame(rows, "project_id string, entry_idx int, room_id string, label string, h double")
    got = schedules.apply_room_schedule(rooms, sched, ["project_id"], ["h"]).collect()
    assert {(r.project_id, r.room_id): r.h for r in got} == {("A", "r1"): 2.6, ("A", "r2"): 2.4, ("B", "r1"): 2.1}
    audit = schedules.room_schedule_audit(rooms, sched, ["project_id"], ["h"]).orderBy("project_id", "entry_idx").collect()
    assert [(r.project_id, r.n_rooms, r.status) for r in audit] == [("A", 2, "matched"), ("A", 1, "matched"), ("A", 1, "empty"), ("B", 0, "unmatched")]


def test_labels_of_many_rooms_and_entries_are_not_paired(spark):
    rooms = spark.range(400).selectExpr("'A' AS project_id", "id AS room_id", "if(id = 399, 'hall', 'bath') AS label", "cast(null AS double) AS h", "1.5D AS w")
    entries = spark.range(300).selectExpr("'A' AS project_id", "id AS entry_idx", "if(id % 100 = 7, id, null) AS room_id", "'bath' AS label", "if(id < 250, cast(id AS double), null) AS h", "if(id = 3, 9D, null) AS w")
    got = schedules.apply_room_schedule(rooms, entries, ["project_id"], ["h", "w"])
    assert {(r.room_id, r.h, r.w) for r in got.collect()} == {(k, 249.0, 9.0) for k in range(399)} | {(399, None, 1.5)}
    first = schedules.apply_room_schedule(rooms, entries.where("entry_idx <= 207"), ["project_id"], ["h", "w"])
    assert {r.room_id: r.h for r in first.collect() if r.h != 206.0} == {207: 207.0, 399: None}
    audit = schedules.room_schedule_audit(rooms, entries, ["project_id"], ["h", "w"])
    assert {(r.n_rooms, r.status): 0 for r in audit.collect()}.keys() == {(399, "matched"), (399, "empty"), (1, "matched")}
    # entries meet rooms after they are brought to one row for each label
    for df in (got, audit):
        joins = _joined_rows(df)
        assert joins and max(joins) <= 400, joins


def test_ends_snap_without_a_row_for_each_vertical_line(spark):
    tall = [(1, 10.0, float(k % 40), 10.0, float(k % 40 + 50), "v") for k in range(400)] + [(1, 14.0, 300.0, 14.0, 310.0, "v"), (1, 14.0, 305.0, 14.0, 500.0, "v"), (2, 90.0, 0.0, 90.0, 9.0, "v")]
    flat = [(1, x, y, x + 80, y, "h") for x in (5.0, 6.0, 11.0, 14.0, 15.0) for y in (0.0, 89.0, 90.0, 304.0, 311.0, 501.0)] + [(2, 12.0, 1.0, 88.0, 1.0, "h")]
    segments = spark.createDataFrame(tall + flat, "page int, x0 double, y0 double, x1 double, y1 double, axis string")

    def place(page, x, y):
        near = [(abs(t[1] - x), t[1]) for t in tall if t[0] == page and abs(t[1] - x) <= 4 and t[2] <= y <= t[4]]
        return min(near)[1] if near else x

    got = geometry.snap_endpoints(segments, ["page"], 4.0)
    assert sorted(map(tuple, got.collect())) == sorted((p, y, place(p, a, y), place(p, b, y)) for p, a, y, b, _, _ in flat)
    assert max(_joined_rows(got)) <= len(flat)


def _joined_rows(df):
    """Rows that each join of an executed plan has returned."""
    df.collect()
    todo, found = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        else:
            found += [node.metrics().apply("numOutputRows").value()] if "Join" in name else []
            todo += [node.children().apply(k) for k in range(node.children().size())]
    return found


def test_stair_schedules_stay_in_their_project(spark):
    stairs = spark.createDataFrame([("A", "s1", None), ("B", "s1", None)], "project_id string, stair_id string, tread_m double")
    rows = [("A", 0, "s1", 0, 0.3), ("B", 0, "s2", 1, None), ("B", 1, "s2", 1, 0.2), ("B", 2, "s9", 0, 0.1)]
    sched = spark.createDataFrame(rows, "project_id string, entry_idx int, stair_id string, page_index int, tread_m double")
    got = {(r.project_id, r.stair_id): (r.tread_m, r.materialised) for r in schedules.apply_stair_schedule(stairs, sched, ["project_id"], ["tread_m"]).collect()}
    assert got == {("A", "s1"): (0.3, False), ("B", "s1"): (None, False), ("B", "s2"): (0.2, True), ("B", "s9"): (0.1, True)}
    pages = spark.createDataFrame([("A", 0), ("B", 1)], "project_id string, page_index int")
    found, rejects = schedules.stair_schedule_audit(stairs, sched, pages, ["project_id"], ["tread_m"])
    assert sorted((r.project_id, r.entry_idx, r.status, r.empty) for r in found.collect()) == [("A", 0, "conflicted", False), ("B", 0, "materialised", True), ("B", 1, "conflicted", False)]
    assert [(r.project_id, r.entry_idx) for r in rejects.collect()] == [("B", 2)]


def test_page_queue_counts_within_a_run(spark):
    issues = spark.createDataFrame([(run, 0, f"{run}{i}") for run in (1, 2) for i in range(4)], "run_id int, page_index int, issue_id string")
    got = lifecycle.page_queue(issues).collect()
    assert sorted((r.run_id, r.preview_id, r.omitted) for r in got) == [(run, f"sheet-0-preview-00{i}", 1) for run in (1, 2) for i in (1, 2, 3)]


def test_tokens_and_numbers(spark):
    df = spark.createDataFrame([("GB50096－5．5．2 净宽 door",), ("宽度 800 mm 且 1/4，GB 50096-6.4.1 三层",)], "t string")
    got = df.select(text.tokenize(F.col("t")).alias("k"), text.numbers(F.col("t"), "clause").alias("n")).collect()
    assert got[0].k[0] == "gb50096-5.5.2" and "净宽" in got[0].k and got[0].k[-1] == "door"
    assert sorted(got[1].n) == [0.25, 0.8, 3.0, 800.0]


def test_bm25_restricts_candidates_only(spark):
    docs = spark.createDataFrame([(1, "door width door"), (2, "stair riser"), (3, "door")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "door")], "query_id long, text string")
    every = {r.doc_id: r.score for r in text.bm25_search(docs, asked, 5).collect()}
    some = {r.doc_id: r.score for r in text.bm25_search(docs, asked, 5, docs.where("doc_id = 3")).collect()}
    assert set(every) == {1, 3} and some == {3: every[3]}


def test_pipe_tables(spark):
    lines = ["| id | note |", "|---|---|", "| 1 | ok |", "| 2 | too | many |", "end", "| a |", "| x |"]
    df = spark.createDataFrame([("f", i, s) for i, s in enumerate(lines)], "file string, line_no int, line string")
    got = sorted((r.block, r.row, r.name, r.value) for r in artifacts.parse_pipe_tables(df, ["file"]).collect())
    assert got == [(0, 2, "id", "1"), (0, 2, "note", "ok"), (1, 6, "a", "x")]


def test_artifacts_round_trip(spark, tmp_path):
    run = tmp_path / "p1_run"
    run.mkdir()
    (run / "entity_graph.json").write_text('{"rooms": [{"id": "r1", "page_index": 0, "confidence": 0.9, "uncertain": false, "area_m2": 12.5}], "doors": []}')
    schema = "rooms array<struct<id: string, page_index: int, confidence: double, uncertain: boolean, area_m2: double>>, doors array<struct<id: string, page_index: int, confidence: double, uncertain: boolean, width_m: double>>"
    got = artifacts.flatten_entities(artifacts.read_artifacts(spark, str(tmp_path), "graph", schema)).withColumn("a", F.try_variant_get("properties", "$.area_m2", "double")).collect()
    assert [(r.run_id, r.entity_type, r.a) for r in got] == [("p1_run", "Room", 12.5)]
    assert artifacts.file_manifest(spark, str(tmp_path)).count() == 1


def test_posterior_stream_equals_batch(spark, tmp_path):
    from planaudit.streaming.posterior import posterior_stream

    rows = spark.createDataFrame([(i % 40, f"R{i % 3}", "confirm" if i % 2 else "reject", f"2024-01-0{1 + i % 5} 00:00:00") for i in range(60)], "event_id long, rule_id string, event_type string, t string").withColumn("ts", F.to_timestamp("t")).drop("t")
    rows = rows.dropDuplicates(["event_id"])
    rows.union(rows).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    run = posterior_stream(stream).writeStream.outputMode("update").format("memory").queryName("posterior").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = {r.rule_id: (r.c, r.r) for r in spark.table("posterior").groupBy("rule_id").agg(F.max("confirms").alias("c"), F.max("rejects").alias("r")).collect()}
    want = {r.rule_id: (r.c, r.r) for r in rows.groupBy("rule_id").agg(F.count_if(F.col("event_type") == "confirm").alias("c"), F.count_if(F.col("event_type") == "reject").alias("r")).collect()}
    assert got == want


def test_compatible_forms_are_folded_as_in_the_standard(spark):
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    got = text._composed.func(pa.array([*every, None])).to_pylist()
    assert [c if g is None else g for c, g in zip(every, got)] == [unicodedata.normalize("NFKC", c) for c in every] and got[-1] is None
    rng = random.Random(4)
    forms = [c for c in every if unicodedata.normalize("NFKC", c) != c] + list("aeo é́̈ｶﾞ가각")
    mixes = ["".join(rng.choices(forms, k=rng.randint(0, 12))) for _ in range(300)]
    df = spark.createDataFrame([(m,) for m in [*mixes, None, "plain"]], "t string")
    assert [r[0] for r in df.select(text.fold_compatible(F.col("t"))).collect()] == [*[unicodedata.normalize("NFKC", m) for m in mixes], None, "plain"]


def test_best_documents_agree_with_a_plain_search(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    share = [1 / (i + 1) for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, share, k=rng.randint(0, 60)))) for i in range(150)] + [(150, None), (151, "w1 w1 w2")]
    queries = [(i, " ".join(rng.choices(words, k=rng.randint(0, 9)))) for i in range(25)] + [(30, "w1 w2"), (31, "none")]
    tokens = {d: (t or "").split() for d, t in docs}
    mean = sum(map(len, tokens.values())) / len(docs)
    df = Counter(w for t in tokens.values() for w in set(t))
    idf = {w: math.log((len(docs) - n + 0.5) / (n + 0.5) + 1) for w, n in df.items()}
    for only in (None, 3):
        want = {}
        for q, asked in queries:
            found = []
            for d, t in tokens.items():
                f = Counter(t)
                s = sum(idf.get(w, 0) * f[w] * 2.5 / (f[w] + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in asked.split())
                found += [(-round(s, 9), d)] if s > 0 and (only is None or d % only == 0) else []
            want |= {(q, i): (d, -s) for i, (s, d) in enumerate(sorted(found)[:4], 1)}
        rows = spark.createDataFrame(docs, "doc_id long, text string")
        some = rows.where(F.col("doc_id") % only == 0) if only else None
        got = text.bm25_search(rows, spark.createDataFrame(queries, "query_id long, text string"), 4, some).collect()
        assert {(r.query_id, r.rank): (r.doc_id, round(r.score, 6)) for r in got} == {k: (d, round(s, 6)) for k, (d, s) in want.items()}


def test_differences_of_multisets_agree_with_pairing_by_hand(spark):
    rng = random.Random(2)
    kinds = [("r", i % 3, f"m{i % 4}", i / 7) for i in range(9)]

    def run(n):
        return [rng.choice(kinds) for _ in range(n)]

    runs = [run(160), run(120)]
    runs = [[(f"g{rng.randint(0, 5)}", *r) for r in rows] for rows in runs]
    runs[0] += [("hot", "r", 1, "same", 0.5)] * 70_000
    runs[1] += [("hot", "r", 1, "same", 0.5)] * 66_000 + [("hot", "r", 1, "zz", 0.5)] * 10 + [("late", None, None, None, None)]
    schema = "rule string, kind string, n int, message string, v double"
    a, b = (spark.createDataFrame(rows, schema) for rows in runs)
    want = Counter()
    for g in {r[0] for rows in runs for r in rows}:
        sides = [sorted([r for r in rows if r[0] == g], key=lambda r: (r[1] or "", r[3] or "", r[2] or 0, str(round(r[4] or 0, 4)))) for rows in runs]
        # canonical order goes by name: kind, message, n, v
        for i in range(max(map(len, sides))):
            x, y = (s[i] if i < len(s) else None for s in sides)
            changed = tuple(c for c, k in (("message", 3), ("n", 2), ("v", 4), ("kind", 1)) if x and y and x[k] != y[k])
            want[g, i + 1, "new" if x is None else "resolved" if y is None else "changed" if changed else "unchanged", changed] += 1
    got = lifecycle.diff_runs(a, b, ["rule"], ["message", "n", "v", "kind"])
    assert Counter((r.rule, r.occurrence, r.status, tuple(r.changed)) for r in got.select(F.coalesce("before.rule", "after.rule").alias("rule"), "occurrence", "status", "changed").collect()) == want
    counted = lifecycle.diff_counts(a, b, ["rule"], ["message", "n", "v", "kind"]).where("before.rule = 'hot' or after.rule = 'hot'")
    assert sorted((r.first, r.n, r.status) for r in counted.collect()) == [(0, 66_000, "unchanged"), (66_000, 10, "changed"), (66_010, 3990, "resolved")]
