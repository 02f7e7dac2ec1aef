from pyspark.sql import functions as F

from planaudit.operators import evidence, maintain, text
from planaudit.plans import inventory, queries


def test_stair_hints_need_a_whole_word_and_no_stair(spark):
    texts = spark.createDataFrame([(1, 0, "Up."), (1, 1, "upstairs"), (1, 2, "main stair 2"), (1, 3, "楼梯间"), (1, 4, None), (2, 0, "DN")], "run_id int, text_idx int, text string")
    stairs = spark.createDataFrame([(2,)], "run_id int")
    got = {r.text_idx: (r.hint_id, r.kind, r.band) for r in evidence.stair_hints(texts, stairs).collect()}
    assert got == {0: ("vertical-text-1", "stair_direction", "medium"), 2: ("vertical-text-2", "stair_keyword", "medium"), 3: ("vertical-text-3", "stair_keyword", "medium")}


def test_inventory_limits(spark):
    rows = [(1, kind, f"{kind}{i:02d}", 0.9, False) for kind in ("Dimension", "Stair", "Corridor", "Door", "Room") for i in range(14)] + [(2, "Door", "d", None, True), (2, "Tree", "t", 0.9, False)]
    df = spark.createDataFrame(rows, "run_id int, entity_type string, entity_id string, confidence double, uncertain boolean")
    got = evidence.component_inventory(df)
    first = got.where("run_id = 1").orderBy("ordinal").collect()
    assert [r.entity_id for r in first][::12] == ["Room00", "Door00", "Corridor00"] and len(first) == 36
    assert [(r.entity_id, r.band) for r in got.where("run_id = 2").collect()] == [("d", "external_or_unknown")]


def test_merge_keeps_the_larger_count_and_raises_the_level(spark):
    counts = "rooms int, doors int, corridors int, stairs int, dimensions int"
    profile = spark.createDataFrame([(1, 5, 0, 0, 0, 0, ["openings"], "basic"), (2, 1, 1, 0, 0, 0, None, "basic")], f"run_id int, {counts}, signals array<string>, level string")
    sheets = spark.createDataFrame([(1, 2, 1, 0, 0, 0), (1, 1, 1, 0, 0, 0)], f"run_id int, {counts}")
    got = {r.run_id: r for r in evidence.merge_sheet_evidence(profile, sheets).collect()}
    assert (got[1].rooms, got[1].doors, got[1].level) == (5, 2, "multi_sheet_layout_with_openings")
    assert got[1].signals == ["openings", "spatial_layout", "per_sheet_graphs"]
    assert (got[2].rooms, got[2].level, got[2].signals) == (1, "basic", [])


def test_authored_expectations_hold(spark):
    schema = "case_id string, name string, value long, text string, members array<string>, page_values array<long>"
    actual = spark.createDataFrame([("a", "rooms", 3, None, None, None), ("a", "doors", 0, None, None, None), ("b", "kind", None, "plan", None, None), ("b", "signals", None, None, ["x", "y", "x"], None)], schema)
    cases = spark.createDataFrame([("a", None), ("b", 0.5), ("c", None)], "case_id string, min_score double")
    checks, done = text.run_benchmark(actual, evidence.author_expected(actual), cases)
    assert checks.count() == 4 and sorted((r.case_id, r.n_checks, r.score, r.passed) for r in done.collect()) == [("a", 1, 1.0, True), ("b", 3, 1.0, True), ("c", 0, 1.0, True)]


def test_source_fallback(spark):
    df = spark.createDataFrame([("p", "g", "r"), ("", "g", "r"), (None, None, "r")], "p string, g string, r string")
    source, warning = maintain.resolve_source(F.col("p"), F.col("g"), F.col("r"))
    assert [tuple(r) for r in df.select(source, warning.isNotNull()).collect()] == [("p", False), ("g", False), ("<unknown-source-for:r>", True)]


def test_every_query_has_an_oracle_and_a_name_of_its_own():
    assert set(inventory.queries()) == set(inventory.oracle_sql())
    assert not set(inventory.queries()) & set(queries.queries())
