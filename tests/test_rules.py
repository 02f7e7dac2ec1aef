import math
import random

import pytest
from pyspark.sql import functions as F

from planaudit.functions.predicates import bind_inputs, measured, predicate_column, render_message, value_kinds
from planaudit.operators import rules

EXPRESSIONS = [
    "w >= 1.2",
    "w is not None and w >= 1.2",
    "0.5 <= w <= 2",
    "w >= 1 or h > 2",
    "not (w > h)",
    "name == 'a' and w != h",
    "w / h > 1 or name == 'b'",
    "w % h == 0",
    "w == None or h is None",
    "-w < h * 2 - 1",
]


def direct(expression, row):
    try:
        return bool(eval(expression, {"__builtins__": {}}, dict(row)))
    except (TypeError, ValueError, ArithmeticError):
        return False


def test_predicates_agree_with_direct_evaluation(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, math.nan, 0.0, -1.5, 1.0, 1.2, 2.0, 3.0]), rng.choice([None, math.nan, 0.0, -2.0, 1.0, 2.5]), rng.choice([None, "a", "b"])) for _ in range(200)]
    df = spark.createDataFrame(rows, "w double, h double, name string")
    inputs = bind_inputs(df, ["w", "h", "name"])
    got = df.select("*", *[predicate_column(e, inputs).alias(f"p{i}") for i, e in enumerate(EXPRESSIONS)]).collect()
    for r in got:
        for i, e in enumerate(EXPRESSIONS):
            assert r[f"p{i}"] == direct(e, {"w": r.w, "h": r.h, "name": r.name}), (e, r)


@pytest.mark.parametrize("bad", ["__import__('os')", "w.real", "unknown > 1", "[1][0] == 1"])
def test_unsafe_expressions_are_refused(spark, bad):
    df = spark.createDataFrame([(1.0,)], "w double")
    with pytest.raises((ValueError, SyntaxError)):
        predicate_column(bad, bind_inputs(df, ["w"]))


def test_message_and_measure(spark):
    df = spark.createDataFrame([(1.26, None), (None, 2.0)], "w double, h double")
    inputs = bind_inputs(df, ["w", "h"])
    got = df.select(render_message("w {w:.1f}", inputs).alias("m"), render_message("h {h}", inputs).alias("n"), measured(["w", "h"], inputs).alias("v"), measured(["w"], inputs, True).alias("s")).collect()
    assert [r.m for r in got] == ["w 1.3", "w {w:.1f}"]
    assert df.select(render_message("{w.real} {h:.1f", inputs), render_message("{x}", inputs)).first()[:] == ("{w.real} {h:.1f", "{x}")
    assert [r.n for r in got] == ["h ?", "h 2.0"]
    assert [r.v for r in got] == [1.26, 2.0] and got[0].s is None


def test_open_properties_and_ids(spark):
    df = spark.createDataFrame([(1, 0, "e1", "Room", '{"depth": 1.5}'), (1, 0, "e2", "Room", "{}")], "run_id long, page_index int, entity_id string, entity_type string, p string").withColumn("properties", F.parse_json("p"))
    rule = [{"rule_id": "R", "applies_to": "Room", "inputs": ["depth"], "logic_expression": "depth > 1"}]
    got = rules.evaluate(df, rule).collect()
    assert [r.entity_id for r in got] == ["e2"]
    assert got[0].issue_id == rules.evaluate(df, rule).first().issue_id


def test_selftest_finds_the_wrong_case(spark):
    rows = spark.createDataFrame([("R", "ok", 2.0, True), ("R", "bad", 0.5, True)], "rule_id string, case_name string, w double, expect_pass boolean")
    rule = [{"rule_id": "R", "applies_to": "Room", "inputs": ["w"], "logic_expression": "w >= 1"}]
    assert [r.case_name for r in rules.rule_selftest(rows, rule).collect()] == ["bad"]


def test_applicability_by_profile_agrees_with_each_project(spark):
    rng = random.Random(3)
    kinds, heights = ["house", "office", "school"], ["low", "high", "tower"]
    known = {f"c{i}": (rng.sample(kinds, rng.randint(0, 2)), rng.choice([None, [], ["low"], ["high", "tower"]])) for i in range(12)}
    cards = {f"r{i}": [f"c{rng.randint(0, 14)}" for _ in range(rng.randint(0, 3))] for i in range(20)}
    projects = {i: (rng.choice([*kinds, None]), rng.choice([*heights, None])) for i in range(40)}

    def fits(c, kind, height):
        return c in known and kind in known[c][0] and (known[c][1] is None or height in known[c][1])

    def said(c, kind, height):
        if c not in known:
            return f"{c}: unknown clause"
        return f"{c}: building type {kind or '?'} not covered" if kind not in known[c][0] else f"{c}: height class {height or '?'} not covered"

    want = {(p, r) for p, v in projects.items() for r, cs in cards.items() if any(fits(c, *v) for c in cs)}
    skips = {(p, r): "; ".join(said(c, *v) for c in cards[r]) or "no source clause" for p, v in projects.items() for r in cards if (p, r) not in want}
    rule_table = spark.createDataFrame(list(cards.items()), "rule_id string, source_clause_ids array<string>")
    clause_table = spark.createDataFrame([(c, *v) for c, v in known.items()], "clause_id string, applies_to_building_type array<string>, applies_to_height_class array<string>")
    project_table = spark.createDataFrame([(p, *v) for p, v in projects.items()], "project_id long, building_type string, height_class string")
    tables = (rule_table, clause_table, project_table)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found, left = rules.applicable_rules(*tables), rules.skip_reasons(*tables)
        assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
        assert {(r.project_id, r.rule_id): r.reason for r in left.collect()} == skips and left.count() == len(skips)
        for df in (found, left):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "NestedLoop" not in plan and "Cartesian" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_message_formats_are_those_of_the_format_language(spark):
    rng = random.Random(21)
    specs = ["", ".0f", ".1f", ".2f", "8.3f", "+.2f", "08.2f", ",.1f", ".1%", "e", ".3g", "<9.1f|", "^+12,.2f", "x", ".2d"]
    odd = [0.0, -0.0, 0.125, 0.25, 2.675, 1e22, 5e-324, -1.5, 2.5, float("inf"), float("nan"), None]
    values = [*odd, *(rng.uniform(-1, 1) * 10 ** rng.randint(-6, 18) for _ in range(4000)), *(rng.randint(-4000, 4000) / 8 for _ in range(3000))]
    df = spark.createDataFrame([(v, i, i % 2 == 0, f"t{i}") for i, v in enumerate(values)], "w double, n int, b boolean, t string")
    inputs = bind_inputs(df, ["w", "n", "b", "t"])
    kinds = value_kinds(df, inputs)
    texts = [f"{{w:{spec}}} {{n}} {{b}} {{t}}" for spec in specs]

    def plain(template, i, v):
        try:
            return template.format(w="?" if v is None else v, n=i, b=i % 2 == 0, t=f"t{i}")
        except ValueError:
            return template

    got = df.select(*[render_message(t, inputs, kinds).alias(f"m{k}") for k, t in enumerate(texts)]).collect()
    assert len(got) * len(specs) > 100_000
    assert all(r[k] == plain(t, i, v) for i, (r, v) in enumerate(zip(got, values, strict=True)) for k, t in enumerate(texts))


def test_many_rules_in_batches(spark, monkeypatch):
    df = spark.createDataFrame([(1, 0, f"e{i}", "Room" if i % 2 else "Door", i / 10) for i in range(20)], "run_id int, page_index int, entity_id string, entity_type string, w double")
    many = [{"rule_id": f"R'{i}\\", "applies_to": ["Room", "Door"][i % 2], "inputs": ["w"], "logic_expression": f"w >= {i / 50}", "output_template": f"{{w:.2f}} is below {i / 50}"} for i in range(100)]
    want = sorted(map(tuple, rules.evaluate(df, many).collect()))
    monkeypatch.setattr(rules, "AT_ONCE", 7)
    assert sorted(map(tuple, rules.evaluate(df, many).collect())) == want
    assert len(want) == sum(j / 10 < i / 50 for i in range(100) for j in range(20) if j % 2 == (i % 2 == 0))
