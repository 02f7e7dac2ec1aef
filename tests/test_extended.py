import random
import re

import numpy as np
from pyspark.sql import functions as F

from planaudit.operators import corridors, drafting, openings, packages
from planaudit.plans import extended, inventory, queries
from planaudit.sources import artifacts, runs


def _spaces(spark, rows):
    return spark.createDataFrame(rows, "page int, space_id string, space_idx int, kind string, x0 double, y0 double, x1 double, y1 double").withColumn("polygon", F.expr("array(struct(x0 as x, y0 as y), struct(x1 as x, y0 as y), struct(x1 as x, y1 as y), struct(x0 as x, y1 as y))"))


def test_levels_are_greedy_and_chords_are_long_and_covered(spark):
    rows = [(1, 0.0, 0.0, 60.0, 0.0), (1, 60.0, 2.0, 100.0, 2.0), (1, 0.0, 4.0, 100.0, 4.0), (1, 0.0, 50.0, 40.0, 50.0), (2, 0.0, 9.0, 10.0, 9.0), (2, 90.0, 9.0, 100.0, 9.0)]
    lines = spark.createDataFrame(rows, "page int, x0 double, y0 double, x1 double, y1 double")
    extents = spark.createDataFrame([(1, 0.0, 100.0), (2, 0.0, 100.0)], "page int, lo double, hi double")
    got = corridors.chords(lines, extents, ["page"]).orderBy("page", "y").collect()
    assert [(r.page, r.y, r.x_min, r.x_max) for r in got] == [(1, 0.0, 0.0, 100.0), (1, 4.0, 0.0, 100.0)]
    hosts = spark.createDataFrame([(1, "h", 0.0, 50.0)], "page int, space_id string, lo double, hi double")
    clipped = corridors.chords(lines, hosts, ["page"], ["space_id"], 0.7, 0.8, clip=True).orderBy("y").collect()
    assert [(r.y, r.x_max) for r in clipped] == [(0.0, 50.0), (4.0, 50.0), (50.0, 40.0)]


def test_levels_of_very_many_heights(spark):
    rng = random.Random(1)
    pages = {0: [i * 0.37 for i in range(100_000)], 1: [rng.choice([rng.uniform(0, 9e4), 3.0 * rng.randint(0, 40)]) for _ in range(30_000)], 2: [5.0]}
    rows = [(p, y) for p, ys in pages.items() for y in ys]
    rng.shuffle(rows)
    lines = spark.createDataFrame(rows, "page int, y double").select("page", F.lit(0.0).alias("x0"), F.col("y").alias("y0"), F.lit(9.0).alias("x1"), F.col("y").alias("y1"))
    extents = spark.createDataFrame([(p, 0.0, 10.0) for p in pages], "page int, lo double, hi double")
    want = set()
    for p, ys in pages.items():
        last = None
        for y in sorted(ys):
            last = y if last is None or y - last > 3.0 else last
            want.add((p, last))
    got = corridors.chords(lines, extents, ["page"])
    assert {(r.page, r.y) for r in got.collect()} == want
    assert "collect_list" not in got._jdf.queryExecution().executedPlan().toString()


def test_bands_need_a_host_room_on_both_sides_and_no_crossing(spark):
    chord = spark.createDataFrame([(1, 40.0, 0.0, 200.0, 200.0), (1, 60.0, 0.0, 200.0, 200.0), (1, 100.0, 0.0, 200.0, 200.0)], "page int, y double, x_min double, x_max double, span double")
    rooms = _spaces(spark, [(1, "r", 0, "room", 0.0, 0.0, 200.0, 120.0), (1, "s", 1, "room", 0.0, 0.0, 200.0, 300.0)])
    bands = corridors.band_candidates(chord, rooms, ["page"], (15.0, 45.0), 25.0)
    assert [(r.y_lo, r.y_hi, r.host_id) for r in bands.collect()] == [(40.0, 60.0, "r")]
    walls = spark.createDataFrame([(1, 10.0, 40.0, 10.0, 60.0, "v"), (1, 100.0, 40.0, 100.0, 50.0, "v")], "page int, x0 double, y0 double, x1 double, y1 double, axis string")
    assert corridors.exclude_crossed(bands, walls, ["page"]).count() == 1
    tall = spark.createDataFrame([(1, 100.0, 45.0, 100.0, 90.0, "v")], "page int, x0 double, y0 double, x1 double, y1 double, axis string")
    assert corridors.exclude_crossed(bands, tall, ["page"]).count() == 0
    assert corridors.corridor_bands(bands.unionByName(bands.withColumn("y_lo", F.lit(41.0))), ["page"]).count() == 1


def test_sides_and_openings(spark):
    spaces = _spaces(spark, [(1, "a", 0, "room", 0.0, 0.0, 100.0, 100.0), (1, "b", 1, "corridor", 100.0, 0.0, 200.0, 100.0), (1, "n", 2, "filtered", 0.0, 100.0, 100.0, 110.0)])
    bridges = spark.createDataFrame([(1, "in", 100.0, 20.0, 100.0, 60.0), (1, "out", 110.0, 0.0, 150.0, 0.0), (1, "noise", 20.0, 100.0, 60.0, 100.0), (1, "point", 5.0, 5.0, 5.0, 5.0), (1, "inner", 30.0, 50.0, 60.0, 50.0)], "page int, bridge_id string, x0 double, y0 double, x1 double, y1 double")
    sides = openings.classify_sides(bridges, spaces, ["page"])
    got = {(r.bridge_id, r.side): (r.kind, r.space_id) for r in sides.collect()}
    assert got[("in", -1)] == ("surviving", "b") and got[("in", 1)] == ("surviving", "a")
    assert got[("out", -1)] == ("exterior", None) and got[("out", 1)] == ("surviving", "b")
    assert got[("noise", 1)] == ("filtered", None) and got[("noise", -1)] == ("surviving", "a")
    assert got[("inner", 1)] == got[("inner", -1)] == ("exterior", None)
    doors = {r.bridge_id: r for r in openings.assemble_openings(bridges, sides, ["page"], 1.0).collect()}
    assert set(doors) == {"in", "out"}
    assert (doors["in"].confidence, doors["in"].uncertain, doors["in"].width_m) == (0.85, False, 0.8)
    assert (doors["in"].bbox.x0, doors["in"].bbox.x1, doors["in"].bbox.y0, doors["in"].bbox.y1) == (80.0, 120.0, 20.0, 60.0)
    assert openings.assemble_openings(bridges, sides, ["page"]).count() == 5


def test_length_beside_a_ring_agrees_with_sampling():
    rng = np.random.default_rng(3)
    ell = np.array([(0, 0), (8, 0), (8, 3), (4, 3), (4, 7), (0, 7)], float)
    rings, ends = [], []
    for i in range(60):
        turn = rng.uniform(0, 2 * np.pi)
        ring = ell @ np.array([[np.cos(turn), -np.sin(turn)], [np.sin(turn), np.cos(turn)]]) + rng.uniform(-3, 3, 2)
        ring = ring if i % 7 else np.repeat(ring, 2, axis=0)
        at = rng.integers(0, len(ring))
        a, b = ring[at], ring[(at + 1) % len(ring)]
        rings.append(ring)
        # along a wall, along it with a shift, or anywhere
        ends.append(np.concatenate([a, b]) + (0 if i % 3 == 0 else np.tile(rng.uniform(-0.4, 0.4, 2), 2) if i % 3 == 1 else rng.uniform(-3, 3, 4)))
    ends = np.array(ends)
    got = openings.length_beside(rings, *ends.T)
    share = (np.arange(20_000) + 0.5) / 20_000
    for ring, (x0, y0, x1, y1), found in zip(rings, ends, got, strict=True):
        p = np.stack([x0 + share * (x1 - x0), y0 + share * (y1 - y0)], axis=1)
        least = np.full(len(p), np.inf)
        for a, b in zip(ring, np.roll(ring, -1, axis=0), strict=True):
            v = b - a
            t = np.clip(((p - a) @ v) / max(v @ v, 1e-300), 0, 1)
            least = np.minimum(least, np.hypot(*(p - a - t[:, None] * v).T))
        assert abs(found - (least <= 0.5).mean() * np.hypot(x1 - x0, y1 - y0)) < 2e-3
    assert openings.length_beside([np.zeros((0, 2))], *np.zeros((4, 1))).tolist() == [0.0]


def test_layout_prefers_sheets(spark):
    schema = "run_id int, source string, page_index int, entity_type string, entity_id string, x0 double, y0 double, x1 double, y1 double, height_m double, is_window boolean"
    rows = [(1, "sheet", 0, "Room", "r", 0.0, 0.0, 50.0, 100.0, None, None), (1, "primary", 0, "Room", "p", 0.0, 0.0, 9.0, 9.0, None, None), (2, "primary", 3, "Door", "d", 0.0, 0.0, 50.0, 50.0, 1.9, True), (2, "primary", 3, "Tree", "t", 0.0, 0.0, 500.0, 50.0, None, None)]
    df = spark.createDataFrame(rows, schema).withColumn("bbox", F.struct("x0", "y0", "x1", "y1")).withColumn("polygon", F.when(F.col("entity_type") == "Room", F.expr("array(struct(x0 as x, y0 as y), struct(x1 as x, y0 as y), struct(x1 as x, y1 as y))")))
    objects, used = openings.layout_objects(df)
    got = {r.object_id: r for r in objects.collect()}
    assert len([k for k in got if "wall" in k]) == 3 and "page-0-room-volume-p" not in got
    assert (got["page-3-window-opening-d"].height_m, got["page-3-window-opening-d"].assumption_ids) == (1.9, ["A-WALL-THICKNESS"])
    assert got["page-3-floor-slab-slab"].x1 == 1.0 and got["page-0-floor-slab-slab"].z_base_m == -0.12
    assert {(r.run_id, r.assumption_id): r.n_objects for r in used.collect()}[(1, "A-WALL-HEIGHT")] == 3


def test_source_body_spans_pages_and_ends_at_the_next_heading(spark):
    clauses = spark.createDataFrame([("STD-5.5.27", "b", "at least 1.2 m", True), ("STD-5.5.27", "b", "left out", False), ("STD-9.9", "b", "no body", True)], "clause_id string, source string, clause_text string, paraphrase boolean")
    pages = spark.createDataFrame([("b", 0, "see 5.5.27 not\n"), ("b", 1, "x\n 5.5.27 width 1.2 m, 900 "), ("b", 2, "mm or 3\n5.6.1 other 8")], "source string, page_index int, text string")
    got = drafting.source_coverage(clauses, pages).collect()
    assert [(r.clause_id, r.source_only, r.text_only) for r in got] == [("STD-5.5.27", [0.9, 3.0, 5.5, 900.0], [])]


def test_the_last_part_of_a_path_counts_where_the_body_states_it(spark):
    clauses = spark.createDataFrame([(f"STD-7.2.{k}", "b", said, True) for k, said in ((112, "at least 113"), (113, "at least 9"), (114, "at least 114"))], "clause_id string, source string, clause_text string, paraphrase boolean")
    bodies = ["\n7.2.112 needs 112 of it, see 17.2.112", "\n7.2.113 needs 5, as 7.2.113 says", "\n7.2.114 needs 114"]
    got = drafting.source_coverage(clauses, spark.createDataFrame([("b", k, t) for k, t in enumerate(bodies)], "source string, page_index int, text string"))
    want = {"STD-7.2.112": ([7.2, 17.2, 112.0], [113.0]), "STD-7.2.113": ([5.0, 7.2], [9.0]), "STD-7.2.114": ([7.2], [])}
    assert {r.clause_id: (r.source_only, r.text_only) for r in got.collect()} == want


def _body(path, pages):
    """Of the pages of a source, in order: the text from the heading to the next sibling or section."""
    parts = path.split(".")
    ends = [".".join([*parts[:-1], str(int(parts[-1]) + 1)]), ".".join([*parts[:-2], str(int(parts[-2]) + 1)]) + "."]
    heading, body = re.compile(r"(?:^|\n)\s*" + re.escape(path) + r"(?!\d)"), ""
    for page in pages:
        found = None if body else heading.search(page)
        if not body and not found:
            continue
        piece, low = (page[found.start() :], len(path)) if found else (page, 0)
        for end in ends:
            at = piece.find(end, low)
            if at >= 0:
                return body + piece[:at]
        body += piece
    return body


def test_source_bodies_agree_with_a_plain_search(spark):
    rng = random.Random(12)
    paths = [f"{a}.{b}.{c}" for a in (1, 2) for b in (1, 2) for c in range(1, 6)] + ["2.3", "A.0.2", "10.2.1"]
    junk = ["see 1.1.2", "12.1.3", "1.1.", "7", " ", "\n", "\n ", "\n\u3000", "e.g.", "A.0.3", "x1.2.1", "2.1.30"]
    books = {f"b{k}": ["".join(rng.choice([*junk, *("\n" + p + " t" for p in paths), *paths]) + rng.choice([" ", "", "\n"]) for _ in range(rng.randint(0, 9))) for _ in range(8)] for k in range(12)}
    clauses = [(f"{book}S-{p}", book, "at least 7", True) for book in books for p in paths]
    pages = [(book, 3 * i, t) for book, texts in books.items() for i, t in enumerate(texts)]
    table = spark.createDataFrame(pages, "source string, page_index int, text string")
    got = drafting.source_coverage(spark.createDataFrame(clauses, "clause_id string, source string, clause_text string, paraphrase boolean"), table)
    want = {c: len(_body(c.split("-", 1)[1], books[book])) for c, book, _, _ in clauses}
    assert {r.clause_id: r.body_chars for r in got.collect()} == {c: n for c, n in want.items() if n}
    # clauses that cite a source add no copies of its pages: the join with texts has one row a page
    assert got._jdf.queryExecution().executedPlan().toString().count("NestedLoop") == 0


def test_drafts(spark):
    rows = [("a", "走廊净宽不小于 1.2 m", ">=", 1.2), ("b", "楼梯踏步", ">", 2.0), ("c", "净高 2.4 m 或 2.2 m", "<", 0.0), ("d", None, None, None)]
    got = {r.clause_id: r for r in drafting.draft_rules(spark.createDataFrame(rows, "clause_id string, clause_text string, threshold_op string, threshold_value double")).collect()}
    assert (got["a"].logic_expression, got["a"].missing) == ("min_width_m >= 1.2", [])
    assert [(c.value, c.expect_pass) for c in got["a"].test_cases] == [(1.2, True), (1.2 * 0.9, False)]
    assert got["b"].applies_to == "Stair" and got["b"].logic_expression is None and got["b"].missing == ["entity_input_mapping"]
    assert got["c"].test_cases[1].value == 1.0 and got["c"].missing == ["rule_split_or_branching"]
    assert got["d"].missing == ["entity_input_mapping", "machine_readable_threshold"]


def test_text_diagnostics(spark):
    rooms = _spaces(spark, [(1, "k", 0, "room", 0.0, 0.0, 10.0, 10.0)]).withColumn("label", F.lit("kitchen"))
    texts = spark.createDataFrame([(1, 0, "Bedroom", 0.9, 5.0, 5.0), (1, 1, "kitchen", 0.5, 10.0, 5.0), (1, 2, "living", 0.85, 50.0, 5.0), (1, 3, "wall", None, 50.0, 5.0)], "page int, text_idx int, text string, confidence double, x double, y double")
    rows, sums = drafting.ocr_diagnostics(texts, rooms, ["page"])
    assert {r.text_idx: r.reasons for r in rows.collect()} == {0: ["label_conflict"], 1: ["low_confidence_label"], 2: ["unbound_high_confidence_label"], 3: []}
    one = sums.collect()[0]
    assert (one.texts, one.bound_texts, one.low_confidence_texts) == (4, 2, 2)


def test_profile_of_nothing(spark):
    names = ["rooms", "doors", "corridors", "stairs", "dimensions", "dimension_texts", "texts", "lines", "unlabeled_rooms", "residential_rooms", "uncertain_stairs", "review_texts"]
    df = spark.createDataFrame([(1, *[None] * 12), (2, *[0] * 3, 2, *[0] * 6, 1, 0)], "run_id int, " + ", ".join(f"{n} int" for n in names))
    got = {r.run_id: r for r in drafting.drawing_profile(df).collect()}
    assert (got[1].drawing_type, got[1].level, got[1].signals, got[1].doubts) == ("unknown", "insufficient_evidence", [], ["no_dimension_evidence"])
    assert (got[2].likely_design, got[2].level, got[2].doubts) == ("vertical_circulation", "component_inventory", ["uncertain_stairs", "no_dimension_evidence"])


def test_regions_of_pages_with_and_without_a_title_block(spark):
    pages = spark.createDataFrame([(1, 1000.0, 800.0), (2, 1000.0, 800.0)], "page int, width_pt double, height_pt double")
    texts = spark.createDataFrame([(1, 0, "Project X", 800.0, 10.0), (1, 1, "Scale", 900.0, 30.0), (1, 2, "plan", 100.0, 10.0)], "page int, text_idx int, text string, x0 double, y0 double")
    texts = texts.select("page", "text_idx", "text", F.struct("x0", "y0", (F.col("x0") + 40).alias("x1"), (F.col("y0") + 10).alias("y1")).alias("bbox"))
    lines = spark.createDataFrame([(1, 760.0, 0.0, 990.0, 0.0)], "page int, x0 double, y0 double, x1 double, y1 double")
    found, left = drafting.region_candidates(pages, texts, lines, ["page"])
    got = {(r.page, r.kind): r for r in found.collect()}
    assert set(got) == {(1, "design_region"), (1, "title_block"), (2, "design_region")}
    assert (got[(1, "title_block")].x0, got[(1, "title_block")].x1, got[(1, "design_region")].x1) == (748.0, 1000.0, 740.0)
    assert abs(got[(1, "title_block")].confidence - (0.42 + 0.16 + 0.015)) < 1e-9 and got[(2, "design_region")].confidence == 0.45
    assert [r.text_idx for r in left.orderBy("nth").collect()] == [0, 1]


def test_package_ladder_and_quality(spark):
    cols = "package int, schema_version string, missing_required array<string>, quality_status string, signoff_status string, checklist_status string, manager_status string, archive_status string, archive_verification_status string"
    good = ["v1", None, "handoff_ready", "ready", "checklist_complete", "manager_ready", "archive_manifest_ready", "archive_verified"]
    rows = [(0, *good)]
    for at, value in enumerate([None, ["plan"], *[None] * 6]):
        bad = list(good)
        bad[at] = value
        rows.append((at + 1, *bad))
    got = {r.package: r for r in packages.package_next_action(spark.createDataFrame(rows, cols), "v1").collect()}
    assert [got[i].action_id for i in range(9)] == ["ready", "restore_manifest", "restore_required_artifacts", *[g[4] for g in packages.GATES]]
    assert got[0].status == "package_ready" and got[1].status == "package_blocked" and got[4].status == "package_needs_info"
    manifest = spark.createDataFrame([("p", "v1", True, "copy", None, [("a", "available", "a.json"), ("b", "missing", None)], ["candidate preview review-state missing input evidence_ready"]), ("q", None, None, None, ["x"], None, None)], "package string, schema_version string, read_only boolean, mutation_policy string, missing_required array<string>, artifacts array<struct<artifact:string,status:string,path:string>>, boundary_warnings array<string>")
    files = spark.createDataFrame([("p", "a.json")], "package string, path string")
    found = {r.package: r for r in packages.package_quality(manifest, files, "v1", "copy").collect()}
    assert (found["p"].status, found["p"].blockers) == ("handoff_ready", [])
    assert found["q"].status == "not_ready" and len(found["q"].blockers) == 8


def test_promotion_binds_inputs_and_skips_known_names(spark):
    issues = spark.createDataFrame([(1, "i1", "R", ["e"], "confirmed", 7), (1, "i2", "R", ["project:7"], "confirmed", 7), (1, "i3", "R", ["project:8"], "confirmed", 8), (1, "i4", "R", ["gone"], "confirmed", 7), (1, "i5", "R", [], "confirmed", 7), (1, "i6", "R", ["e"], "rejected", 7), (1, "i7", "R", ["e"], "confirmed", 7)], "run_id int, issue_id string, rule_id string, entity_ids array<string>, status string, project_id int")
    entities = spark.createDataFrame([(1, "e", 1.5)], "run_id int, entity_id string, width_m double")
    projects = spark.createDataFrame([(7, 3.0)], "project_id int, width_m double")
    known = spark.createDataFrame([("R", "confirmed-i7")], "rule_id string, name string")
    got = packages.promote_cases(issues, entities, projects, [{"rule_id": "R", "inputs": ["width_m"]}], known)
    assert {r.name: r.inputs for r in got.collect()} == {"confirmed-i1": '{"width_m":1.5}', "confirmed-i2": '{"width_m":3.0}', "confirmed-i4": '{"width_m":null}'}


def test_failures_under_other_names(spark):
    body = """{"specifications": [{"description": "S", "requirements": [{"status": false, "name": "N", "failed_entities": [{"type": "Door", "id": "d1", "value": 2}, "plain"], "value": 9, "reason": "bad"},
      {"status": "PASS", "failures": ["x"]}, {"failures": {"name": "lone"}}], "checks": {"status": "invalid"}}, "noise"]}"""
    rows = spark.createDataFrame([(1, body), (2, "{}"), (3, "[1]")], "report_id int, t string").select("report_id", F.parse_json("t").alias("body"))
    got = packages.flatten_failures(rows).orderBy("report_id", "ordinal").collect()
    assert [(r.requirement, r.entity, r.actual) for r in got] == [("N", "Door:d1", "2"), ("N", "plain", "9"), ("S", "lone", None), ("S", None, None)]
    assert got[0].message == "bad" and [r.ordinal for r in got] == [1, 2, 3, 4]


def test_artifacts_of_a_suite_and_a_report_round_trip(spark, tmp_path):
    for run in ("a_run", "b_run"):
        (tmp_path / "in" / run).mkdir(parents=True)
        (tmp_path / "in" / run / "issues.json").write_text('[{"id": "%s", "n": 1}]' % run)
    schema = "id string, n int"
    got = artifacts.read_artifacts(spark, str(tmp_path / "in"), "issues", schema)
    assert sorted((r.id, r.run_id) for r in got.collect()) == [("a_run", "a_run"), ("b_run", "b_run")]
    suite = artifacts.ingest_suite(spark, str(tmp_path / "in"), {"issues": schema})
    assert sorted((r.project_slug, r.run_id) for r in suite["issues"].collect()) == [("in-a", "in/a_run"), ("in-b", "in/b_run")]
    runs.write_report(got, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("run_id = 'a_run'").count() == 1
    assert artifacts.read_artifacts(spark, str(tmp_path / "none"), "issues", schema).count() == 0


def test_names_are_unique_and_have_oracles():
    assert set(extended.queries()) == set(extended.oracle_sql())
    assert not set(extended.queries()) & (set(queries.queries()) | set(inventory.queries()))
