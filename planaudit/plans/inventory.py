"""More registered queries of the library's own operators, each with its oracle in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planaudit.operators import evidence, maintain, rules, schedules, text
from planaudit.operators import feedback as fb
from planaudit.operators import geometry as geo
from planaudit.operators import lifecycle as life
from planaudit.plans.harness import oracle, table, view
from planaudit.plans.queries import _FAILS, RULES, _actual
from planaudit.sources import artifacts

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(name: str, sql: str, *views: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[name] = f
        _oracles[name] = oracle(sql, *views) if views else sql
        return f

    return add


def _pick(value: str, **cases: str) -> Column:
    """A column by the value of another."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for k, v in cases.items():
        out = out.when(F.col(value) == k, v)
    return out


# sources and maintenance


@query(
    "s2_flatten_entities",
    """SELECT run_id, CASE WHEN mark = 'F' AND entity_type = 'Room' THEN 'Wall' WHEN mark = 'F' AND entity_type = 'Door' THEN 'Stair' ELSE entity_type END AS entity_type, entity_id, page_index, confidence, slope > 0.05 AS uncertain,
    width_m, CASE WHEN mark = 'F' AND entity_type = 'Room' THEN NULL ELSE area_m2 END AS area_m2 FROM v_entity""",
    "v_entity",
)
def flatten(s: SparkSession, d: str) -> DataFrame:
    kind = F.when((F.col("mark") == "F") & (F.col("entity_type") == "Room"), "Wall").when((F.col("mark") == "F") & (F.col("entity_type") == "Door"), "Stair").otherwise(F.col("entity_type"))
    common = [F.col("entity_id").alias("id"), "page_index", "confidence", (F.col("slope") > 0.05).alias("uncertain"), "width_m"]
    fields = {n: F.struct(*common) if k == "Wall" else F.struct(*common, "area_m2") for n, k in artifacts.ENTITY_TYPES.items()}
    graphs = view(s, d, "v_entity").withColumn("kind", kind).groupBy("run_id").agg(*[F.collect_list(F.when(F.col("kind") == k, fields[n])).alias(n) for n, k in artifacts.ENTITY_TYPES.items()])
    rows = artifacts.flatten_entities(graphs)
    return rows.select("run_id", "entity_type", "entity_id", "page_index", "confidence", "uncertain", *[F.try_variant_get("properties", f"$.{c}", "double").alias(c) for c in ("width_m", "area_m2")])


@query(
    "s5_import_labels",
    """SELECT event_id, event_id % 17 <> 0 AND event_id % 6 <> 3 AS good, CASE WHEN event_id % 6 = 3 THEN 'odd' WHEN event_id % 6 = 2 THEN 'synthetic' WHEN event_id % 6 <> 0 THEN 'project_internal'
    WHEN user_id % 5 <= 1 AND event_id % 17 <> 0 THEN 'synthetic' ELSE 'independent_third_party' END AS reviewer_class FROM v_label""",
    "v_label",
)
def labels(s: SparkSession, d: str) -> DataFrame:
    good, rejects = maintain.import_labels(view(s, d, "v_label"))
    return good.select("event_id", F.lit(True).alias("good"), "reviewer_class").unionByName(rejects.select("event_id", F.lit(False).alias("good"), "reviewer_class"))


@query(
    "s6_pipe_tables",
    """WITH lines AS (SELECT o_custkey, o_orderkey, o_orderpriority AS p, o_orderpriority LIKE '1%' AS stop FROM orders),
    blocks AS (SELECT *, sum(CAST(stop AS INT)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS block FROM lines),
    cells AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, block ORDER BY o_orderkey) AS at FROM blocks WHERE NOT stop),
    body AS (SELECT b.o_custkey, b.block, b.o_orderkey AS row, h.o_orderkey AS h1, h.p AS h2, b.p FROM cells b JOIN cells h ON h.o_custkey = b.o_custkey AND h.block = b.block AND h.at = 1 WHERE b.at > 1)
    SELECT o_custkey, CAST(block AS BIGINT) AS block, row, CAST(h1 AS VARCHAR) AS name, CAST(row AS VARCHAR) AS value FROM body
    UNION ALL SELECT o_custkey, CAST(block AS BIGINT), row, h2, p FROM body""",
)
def pipes(s: SparkSession, d: str) -> DataFrame:
    line = F.when(F.col("o_orderpriority").startswith("1"), "plain text").otherwise(F.concat(F.lit("| "), F.col("o_orderkey").cast("string"), F.lit(" | "), "o_orderpriority", F.lit(" |")))
    return artifacts.parse_pipe_tables(table(s, d, "orders").select("o_custkey", F.col("o_orderkey").alias("line_no"), line.alias("line")), ["o_custkey"])


def _linked(s: SparkSession, d: str) -> DataFrame:
    known = F.when(F.col("entity_key").isNull(), F.array().cast("array<bigint>")).otherwise(F.array("entity_key"))
    return view(s, d, "v_issue").select("issue_id", (F.col("issue_id") % 200).alias("run_id"), (F.col("issue_id") % 5).alias("page_index"), known.alias("entity_ids"), F.concat(F.lit("STD"), "rule_key", F.lit("-1")).alias("rule_id"), "confidence")


def _parties(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select((F.col("c_custkey") % 200).alias("run_id"), F.col("c_custkey").alias("entity_id"), (F.col("c_custkey") * 10).alias("entity_key"), F.col("c_acctbal").alias("confidence"))


@query(
    "u4_resolve_refs",
    """SELECT issue_id, r.rule_key, CASE WHEN c_custkey IS NULL THEN NULL ELSE c_custkey * 10 END AS entity_key, sheet_id FROM v_issue i
    LEFT JOIN v_rule r ON r.rule_key = i.rule_key LEFT JOIN customer ON c_custkey = entity_key AND c_custkey % 200 = issue_id % 200
    LEFT JOIN (SELECT p_partkey % 200 AS run, p_partkey % 7 AS page, min(p_partkey) AS sheet_id FROM part GROUP BY 1, 2) ON run = issue_id % 200 AND page = issue_id % 5""",
    "v_issue",
    "v_rule",
)
def refs(s: SparkSession, d: str) -> DataFrame:
    sheets = table(s, d, "part").groupBy((F.col("p_partkey") % 200).alias("run_id"), (F.col("p_partkey") % 7).alias("page_index")).agg(F.min("p_partkey").alias("sheet_id"))
    return maintain.resolve_refs(_linked(s, d), _parties(s, d), sheets, view(s, d, "v_rule")).select("issue_id", "rule_key", "entity_key", "sheet_id")


query("u5_confidence", "SELECT issue_id, coalesce(confidence, c_acctbal) AS confidence FROM v_issue LEFT JOIN customer ON c_custkey = entity_key AND c_custkey % 200 = issue_id % 200", "v_issue")(
    lambda s, d: maintain.propagate_confidence(_linked(s, d), _parties(s, d)).select("issue_id", "confidence")
)


@query("u7_source", "SELECT p_partkey, CASE WHEN p_size > 30 THEN p_brand WHEN p_size > 10 THEN p_type ELSE concat('<unknown-source-for:', p_name, '>') END AS source_path, p_size <= 10 AS warned FROM part")
def sources(s: SparkSession, d: str) -> DataFrame:
    source, warning = maintain.resolve_source(F.when(F.col("p_size") > 30, F.col("p_brand")), F.when(F.col("p_size") > 10, F.col("p_type")), F.col("p_name"))
    return table(s, d, "part").select("p_partkey", source.alias("source_path"), warning.isNotNull().alias("warned"))


# rules


@query("r10_clean_bbox", "SELECT space_id, CASE WHEN x0 = 0 AND y0 = 0 AND page_index % 2 = 0 THEN NULL ELSE x0 END AS x0 FROM v_box", "v_box")
def boxes(s: SparkSession, d: str) -> DataFrame:
    rows = view(s, d, "v_box").select("space_id", (F.col("page_index") % 2 == 0).alias("uncertain"), F.struct("x0", "y0", F.col("x0").alias("x1"), F.col("y0").alias("y1")).alias("bbox"))
    return rules.clean_bbox(rows).select("space_id", F.col("bbox.x0").alias("x0"))


@query(
    "r11_multi_page",
    f"""SELECT run_id, page_index, entity_id, rule_id, measured_value, severity, substr(sha256(concat_ws(chr(31), run_id, page_index, entity_id, rule_id)), 1, 16) AS issue_id FROM ({_FAILS}) UNION ALL
    SELECT run_id, 1, concat('project:', e.project_id), 'R-PROJ', height_m, 'info', substr(sha256(concat_ws(chr(31), run_id, 'R-PROJ', concat('project:', e.project_id))), 1, 16) FROM (SELECT DISTINCT run_id, project_id FROM v_entity WHERE page_index = 1) e JOIN v_project p ON p.project_id = e.project_id
    WHERE NOT coalesce(height_m > 0 AND height_class IS DISTINCT FROM 'high', false)""",
    "v_entity",
    "v_project",
)
def pages(s: SparkSession, d: str) -> DataFrame:
    rows = view(s, d, "v_entity").withColumn("is_primary", F.col("page_index") == 1)
    return rules.evaluate_multi_page(rows, view(s, d, "v_project"), RULES).select("run_id", "page_index", "entity_id", "rule_id", "measured_value", "severity", "issue_id")


query("r13_selftest", "SELECT 'R-ROOM-W' AS rule_id, entity_id AS case_name, slope <= 0.05 AS expect_pass, NOT slope <= 0.05 AS passes FROM v_entity WHERE coalesce(width_m >= 1.2, false) <> (slope <= 0.05)", "v_entity")(
    lambda s, d: rules.rule_selftest(view(s, d, "v_entity").select(F.lit("R-ROOM-W").alias("rule_id"), F.col("entity_id").alias("case_name"), "width_m", (F.col("slope") <= 0.05).alias("expect_pass")), RULES[:1])
)
query("r16_evidence_source", "SELECT entity_type, concat_ws('+', CASE WHEN width_m IS NOT NULL THEN 'graph' END, CASE WHEN confidence > 0.05 THEN 'text' END) AS source, count(*) AS n FROM v_entity GROUP BY 1, 2", "v_entity")(
    lambda s, d: view(s, d, "v_entity").groupBy("entity_type", rules.evidence_source({"graph": F.col("width_m").isNotNull(), "text": F.col("confidence") > 0.05}).alias("source")).agg(F.count("*").alias("n"))
)


_CARDS = "(SELECT *, CASE WHEN p_size % 10 = 0 THEN 'Stair' WHEN p_size % 10 = 1 THEN 'Project' ELSE p_brand END AS kind, CASE WHEN p_size > 45 THEN 'info' WHEN p_size % 3 = 0 THEN NULL ELSE 'error' END AS level FROM part)"
_TIER_SQL = """SELECT p_partkey AS rule_id, CASE WHEN known THEN '' ELSE p_type END AS missing, CASE WHEN kind = 'Stair' AND NOT {stairs} THEN 'STAIR_PENDING' WHEN coalesce(level, CASE WHEN kind = 'Project' THEN 'info' ELSE 'error' END) = 'info' THEN 'REMINDER_BY_DESIGN'
    WHEN kind = 'Project' THEN 'PROJECT_META_DRIVEN' WHEN NOT known THEN 'PARTIAL_AUTODETECT' ELSE 'AUTODETECTABLE' END AS tier FROM (SELECT *, kind IN (SELECT p_brand FROM part) AND p_type IN (SELECT q.p_type FROM part q WHERE q.p_brand = p.kind AND q.p_size > 25)
    OR {stairs} AND kind = 'Stair' AND p_type IN (SELECT p_type FROM part WHERE p_size > 40) AS known FROM """ + _CARDS + " p)"


def _tiers(s: SparkSession, d: str, stairs: bool) -> DataFrame:
    part = table(s, d, "part")
    kind = F.when(F.col("p_size") % 10 == 0, "Stair").when(F.col("p_size") % 10 == 1, "Project").otherwise(F.col("p_brand"))
    level = F.when(F.col("p_size") > 45, "info").when(F.col("p_size") % 3 != 0, "error")
    cards = part.select(F.col("p_partkey").alias("rule_id"), kind.alias("applies_to"), F.array("p_type").alias("inputs"), level.alias("severity"))
    known = part.where("p_size > 25").groupBy(F.col("p_brand").alias("applies_to")).agg(F.collect_set("p_type").alias("fields"))
    if stairs:
        known = known.unionByName(part.where("p_size > 40").groupBy(F.lit("Stair").alias("applies_to")).agg(F.collect_set("p_type").alias("fields")))
    return rules.readiness_tiers(cards, known).withColumn("missing", F.array_join("missing", ","))


query("r17_tiers", _TIER_SQL.format(stairs="false"))(lambda s, d: _tiers(s, d, False))
query("r17_stair_fields", _TIER_SQL.format(stairs="true"))(lambda s, d: _tiers(s, d, True))


query("r19_blocked_sources", "SELECT severity AS source, count(DISTINCT rule_key) AS n_rules FROM v_issue WHERE status IN ('candidate', 'confirmed') GROUP BY 1", "v_issue")(
    lambda s, d: rules.blocked_sources(view(s, d, "v_issue").select(F.col("rule_key").alias("rule_id"), F.col("severity").alias("source"), F.coalesce(_pick("status", candidate="missing_input", confirmed="unsupported_entity"), F.lit("ready")).alias("status")))
)


# schedules


def _stairs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Stairs and entries of two projects that use the same ids and pages."""
    box = F.struct(*[F.lit(1.0).alias(c) for c in ("x0", "y0", "x1", "y1")])
    key, entry = F.col("s_suppkey"), F.col("p_partkey")
    stairs = table(s, d, "supplier").select(
        (key % 2).alias("project_id"),
        F.floor(key / 2).alias("stair_id"),
        F.when(F.col("s_nationkey") % 2 == 1, F.col("s_acctbal")).alias("tread_m"),
        F.lit(0.5).alias("confidence"),
        F.lit(False).alias("uncertain"),
        F.lit(7).cast("long").alias("page_index"),
        box.alias("bbox"),
    )
    size = F.when(F.col("p_size") % 4 != 0, F.col("p_size").cast("double"))
    rows = table(s, d, "part").select((F.floor(entry / 3) % 2).alias("project_id"), entry.alias("entry_idx"), (entry % 75).alias("stair_id"), (entry % 30).alias("page_index"), size.alias("tread_m"))
    return stairs, rows


_STAIR_ENTRIES = """WITH st AS (SELECT s_suppkey % 2 AS project_id, s_suppkey // 2 AS stair_id, CASE WHEN s_nationkey % 2 = 1 THEN s_acctbal END AS tread_m, s_nationkey AS page_index FROM supplier),
    en AS (SELECT p_partkey // 3 % 2 AS project_id, p_partkey AS entry_idx, p_partkey % 75 AS stair_id, p_partkey % 30 AS page_index, CASE WHEN p_size % 4 <> 0 THEN CAST(p_size AS DOUBLE) END AS t FROM part)"""
query(
    "d3_stair_schedule",
    _STAIR_ENTRIES
    + """ SELECT project_id, stair_id, coalesce(tread_m, t) AS tread_m, CASE WHEN here IS NULL THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS confidence, here IS NULL AS materialised, here IS NULL AS uncertain,
    CASE WHEN here IS NULL THEN page ELSE 7 END AS page_index, CASE WHEN here IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS x1
    FROM (SELECT project_id, stair_id, tread_m, true AS here FROM st) s
    FULL JOIN (SELECT project_id, stair_id, arg_min(t, entry_idx) FILTER (WHERE t IS NOT NULL) AS t, arg_min(page_index, entry_idx) AS page FROM en GROUP BY 1, 2) e USING (project_id, stair_id)""",
)(lambda s, d: schedules.apply_stair_schedule(*_stairs(s, d), ["project_id"], ["tread_m"]).withColumn("x1", F.col("bbox.x1")).drop("bbox"))


@query(
    "d4_stair_audit",
    _STAIR_ENTRIES
    + """ SELECT project_id, entry_idx, stair_id, CASE WHEN NOT on_page THEN 'reject' WHEN made THEN 'materialised' ELSE 'conflicted' END AS status, on_page AND made AND t IS NULL AS empty FROM (
    SELECT *, on_page AND (project_id, stair_id) NOT IN (SELECT (project_id, stair_id) FROM st) AND row_number() OVER (PARTITION BY project_id, stair_id, on_page ORDER BY entry_idx) = 1 AS made
    FROM (SELECT *, (project_id, page_index) IN (SELECT (project_id, page_index) FROM st) AS on_page FROM en))""",
)
def stair_audit(s: SparkSession, d: str) -> DataFrame:
    stairs, rows = _stairs(s, d)
    pages = table(s, d, "supplier").select((F.col("s_suppkey") % 2).alias("project_id"), F.col("s_nationkey").alias("page_index"))
    found, rejects = schedules.stair_schedule_audit(stairs, rows, pages, ["project_id"], ["tread_m"])
    return found.unionByName(rejects.select("project_id", "entry_idx", "stair_id", F.lit("reject").alias("status"), F.lit(False).alias("empty")))


query("d5_schedule_project", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")(
    lambda s, d: rules.check_schedule_project(table(s, d, "orders").withColumnRenamed("o_custkey", "project_id"), table(s, d, "customer").where("c_acctbal > 0").withColumnRenamed("c_custkey", "project_id")).select("o_orderkey")
)


# geometry

_LONG = "(SELECT l_linenumber AS page_index, floor(l_extendedprice % 500) * 8 AS x0, l_suppkey * 2.0E0 AS y0, floor(l_extendedprice % 500) * 8 + l_quantity * 8 AS x1 FROM lineitem)"


def _wide(s: SparkSession, d: str) -> DataFrame:
    at = F.floor(F.col("l_extendedprice") % 500) * 8
    return geo.normalize_segments(table(s, d, "lineitem").select(F.col("l_linenumber").alias("page_index"), at.cast("double").alias("x0"), (F.col("l_suppkey") * 2.0).alias("y0"), (at + F.col("l_quantity") * 8).alias("x1"), (F.col("l_suppkey") * 2.0).alias("y1")))


def _gaps_sql(lo: float, hi: float, least: float) -> str:
    return f"SELECT page_index, y0 AS coord, x1 AS start, nxt AS stop FROM (SELECT *, lead(x0) OVER (PARTITION BY page_index, y0 ORDER BY x0, x1) AS nxt FROM {_LONG} WHERE x1 - x0 >= {least}) WHERE nxt - x1 > {lo} AND nxt - x1 < {hi}"


@query("g3_wide_openings", f"SELECT w.* FROM ({_gaps_sql(10, 70, 150)}) w ANTI JOIN ({_gaps_sql(10, 40, 0)}) b USING (page_index, coord, start, stop)")
def wide_openings(s: SparkSession, d: str) -> DataFrame:
    rows = _wide(s, d)
    return geo.close_wide_openings(rows, geo.detect_gaps(rows, ["page_index"], 10, 40), ["page_index"], 10).select("page_index", "coord", "start", "stop")


query("g9_noise", "SELECT entity_id, CASE WHEN area_m2 < 20 THEN 'filtered' ELSE 'kept' END AS side, area_m2 FROM v_entity", "v_entity")(
    lambda s, d: reduce(DataFrame.unionByName, [p.select("entity_id", F.lit(side).alias("side"), "area_m2") for p, side in zip(geo.split_noise(view(s, d, "v_entity"), 20.0), ("kept", "filtered"), strict=True)])
)
query(
    "g14_dedupe_walls",
    f"""WITH b AS (SELECT *, floor(y0 / 7) AS bin FROM {_LONG}), m AS (SELECT page_index, bin, floor(avg(y0)) AS mid FROM b GROUP BY 1, 2),
    i AS (SELECT *, CASE WHEN x0 <= max(x1) OVER (PARTITION BY page_index, bin ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 3 THEN 0 ELSE 1 END AS fresh FROM b),
    n AS (SELECT *, sum(fresh) OVER (PARTITION BY page_index, bin ORDER BY x0, x1) AS island FROM i)
    SELECT page_index, CAST(mid AS BIGINT) AS "at", min(x0) AS lo, max(x1) AS hi, count(*) AS n FROM n JOIN m USING (page_index, bin) GROUP BY page_index, bin, mid, island""",
)(lambda s, d: geo.dedupe_walls(_wide(s, d), ["page_index"], 7, 3.0).select("page_index", "at", "lo", "hi", "n"))
query(
    "g18_issue_focus",
    """SELECT space_id, CASE WHEN page_index > 15 THEN 'no page' WHEN x0 >= 300 OR y0 >= 150 THEN 'off page' END AS omitted,
    CASE WHEN page_index <= 15 AND x0 < 300 AND y0 < 150 THEN round(100 * least(x1, 300.0::DOUBLE) / 300, 3) END AS x1_pct FROM v_box""",
    "v_box",
)(lambda s, d: geo.issue_focus(view(s, d, "v_box").select("space_id", "page_index", F.struct("x0", "y0", "x1", "y1").alias("bbox")), view(s, d, "v_box").where("page_index <= 15").select("page_index", F.lit(300.0).alias("width_pt"), F.lit(150.0).alias("height_pt")).distinct(), ["page_index"]).select("space_id", "omitted", "x1_pct"))
query("g19_page_overlay", "SELECT space_id AS issue_id, x0 FROM v_box WHERE page_index = 3 AND space_id % 3 = 1", "v_box")(
    lambda s, d: geo.page_overlay(view(s, d, "v_box").select(F.col("space_id").alias("issue_id"), F.col("page_index").alias("run_id"), F.struct("x0", "y0", "x1", "y1").alias("bbox"), F.parse_json(F.to_json(F.struct((F.col("space_id") % 3).alias("page_index")))).alias("evidence")), 3, 1).select("issue_id", F.col("bbox.x0").alias("x0"))
)
query("g23_provenance", "SELECT project_id AS run_id, count(*) AS openings, count(CASE WHEN mark = 'F' THEN 1 END) AS semantic, count(width_m) AS measurement, count(CASE WHEN mark = 'F' AND width_m IS NOT NULL AND slope > 0.02 THEN 1 END) AS all_three FROM v_entity WHERE entity_type = 'Door' GROUP BY 1", "v_entity")(
    lambda s, d: geo.opening_provenance(view(s, d, "v_entity").where("entity_type = 'Door'").select(F.col("project_id").alias("run_id"), F.when(F.col("mark") == "F", "swing").alias("kind"), "width_m", F.when(F.col("slope") > 0.02, "w").alias("host_id"))).select("run_id", "openings", "semantic", "measurement", "all_three")
)


# text and evidence

_PAGE = "(SELECT l_orderkey AS run_id, l_linenumber AS page_index, CASE min(l_returnflag) WHEN 'A' THEN 'plan' WHEN 'N' THEN 'title' ELSE 'unknown' END AS t, max(l_discount) > 0.04 AS sure FROM lineitem GROUP BY 1, 2)"
_THERE = "NOT (run_id % 13 = 0 AND page_index = 2)"


def _typed(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Classified pages, and the pages that hold primitives."""
    rows = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("page_index")).agg(F.min("l_returnflag").alias("flag"), F.max("l_discount").alias("sure"))
    kind = F.coalesce(_pick("flag", A="plan", N="title"), F.lit("unknown"))
    rows = rows.select("run_id", "page_index", kind.alias("page_type"), F.when(F.col("sure") > 0.04, 0.5).otherwise(0.49).alias("confidence"))
    return rows, rows.where(_THERE).select("run_id", "page_index")


query(
    "t2_route_documents",
    f"""SELECT run_id, reason IS NULL AS narrowed, CASE WHEN reason IS NULL THEN page END AS page, reason FROM (SELECT *, CASE WHEN n <= 1 THEN 'single_page_run' WHEN gone > 0 THEN 'classification_page_mismatch' WHEN p = 0 THEN 'no_eligible_plan_page' WHEN p > 1 THEN 'multiple_eligible_plan_pages'
    WHEN w > 0 THEN 'unknown_or_low_confidence_non_plan_page' END AS reason FROM (SELECT run_id, count(CASE WHEN {_THERE} THEN 1 END) AS n, count(CASE WHEN NOT ({_THERE}) THEN 1 END) AS gone, count(CASE WHEN t = 'plan' AND sure THEN 1 END) AS p,
    count(CASE WHEN t = 'unknown' OR NOT sure THEN 1 END) AS w, min(CASE WHEN t = 'plan' AND sure THEN page_index END) AS page FROM {_PAGE} GROUP BY 1))""",
)(lambda s, d: text.route_documents(*_typed(s, d), "run_id"))


@query(
    "t3_split_pages",
    f"""SELECT run_id, page_index, t AS page_type, reason, rooms, doors, corridors, CASE WHEN reason IS NULL THEN 0 END AS stairs FROM (SELECT *, CASE WHEN NOT ({_THERE}) THEN 'page missing from graph primitives' WHEN NOT (t = 'plan' AND sure) THEN 'not a confident graph-eligible plan page' END AS reason FROM {_PAGE}) p
    LEFT JOIN (SELECT run_id AS r, page_index AS i, count(CASE WHEN entity_type = 'Room' THEN 1 END) AS rooms, count(CASE WHEN entity_type = 'Door' THEN 1 END) AS doors, count(CASE WHEN entity_type = 'Corridor' THEN 1 END) AS corridors FROM v_entity GROUP BY 1, 2) e ON e.r = run_id AND e.i = page_index AND reason IS NULL""",
    "v_entity",
)
def split(s: SparkSession, d: str) -> DataFrame:
    kept, skipped = text.split_pages(*_typed(s, d), view(s, d, "v_entity"))
    both = kept.withColumn("reason", F.lit(None).cast("string")).unionByName(skipped, allowMissingColumns=True)
    return both.select("run_id", "page_index", "page_type", "reason", "rooms", "doors", "corridors", "stairs")


@query(
    "t8_fidelity",
    """WITH r AS (SELECT p_partkey AS rule_id, p_brand AS clause_ids, p_size * 1.0E0 AS e, p_size % 9 * 1.0E0 AS m, CAST(substr(p_brand, 7) AS DOUBLE) AS c FROM part WHERE p_size % 6 <> 0)
    SELECT rule_id, clause_ids, 'error' AS severity, 'numeric-drift-expression' AS kind, e AS number FROM r WHERE e <> 0 AND e <> c UNION ALL SELECT rule_id, clause_ids, 'warning', 'numeric-drift-template', m FROM r WHERE m <> 0 AND m <> c AND m <> e""",
)
def fidelity(s: SparkSession, d: str) -> DataFrame:
    part, size = table(s, d, "part"), F.col("p_size").cast("string")
    known = F.when(F.col("p_size") % 6 == 0, F.array(F.lit("nope"))).otherwise(F.array(F.lit("nope"), F.col("p_brand")))
    # the digits of names and placeholders count for nothing
    cards = part.select(F.col("p_partkey").alias("rule_id"), F.concat(F.lit("area_m2 >= "), size).alias("logic_expression"), F.concat(F.lit("at least {w2} "), F.col("p_size") % 9, F.lit(", GB 50096-1")).alias("output_template"), known.alias("source_clause_ids"))
    return text.fidelity_findings(cards, part.select(F.col("p_brand").alias("clause_id"), F.concat(F.lit("GB 50096-5: at least "), F.substring("p_brand", 7, 9)).alias("clause_text")).distinct())


query("t10_clause_coverage", "SELECT count(*) AS n_clauses, count(k) AS n_cited, CAST(100 * count(k) // count(*) AS INT) AS percent FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) ON k = c_custkey")(
    lambda s, d: text.clause_coverage(table(s, d, "orders").select(F.array("o_custkey").alias("source_clause_ids")), table(s, d, "customer").withColumnRenamed("c_custkey", "clause_id"))[0]
)
_COUNTS = "SELECT project_id, count(CASE WHEN entity_type = 'Room' THEN 1 END) AS rooms, count(CASE WHEN entity_type = 'Door' THEN 1 END) AS doors, count(CASE WHEN entity_type = 'Corridor' AND mark = 'X' THEN 1 END) AS corridors FROM v_entity GROUP BY 1"
query("t19_noise_flags", f"SELECT *, concat_ws(',', CASE WHEN rooms > 50 THEN 'many_rooms' END, CASE WHEN doors > 50 THEN 'many_doors' END, CASE WHEN rooms > 0 AND corridors = 0 THEN 'rooms_without_corridor' END) AS flags FROM ({_COUNTS})", "v_entity")(
    lambda s, d: text.noise_flags(view(s, d, "v_entity").groupBy("project_id").agg(F.count_if(F.col("entity_type") == "Room").alias("rooms"), F.count_if(F.col("entity_type") == "Door").alias("doors"), F.count_if((F.col("entity_type") == "Corridor") & (F.col("mark") == "X")).alias("corridors")))
)
query(
    "t21_suite_rollup",
    "SELECT CASE WHEN o_orderkey IS NULL THEN 'pending' WHEN c_nationkey > 15 THEN CASE WHEN good THEN 'unexpected_pass' ELSE 'known_gap' END WHEN good THEN 'pass' ELSE 'fail' END AS outcome, count(*) AS n FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey, sum(o_totalprice) > 1000000 AS good FROM orders GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1",
)(
    lambda s, d: text.suite_rollup(table(s, d, "orders").groupBy(F.col("o_custkey").alias("case_id")).agg((F.sum("o_totalprice") > 1000000).alias("passed")), table(s, d, "customer").select(F.col("c_custkey").alias("case_id"), F.when(F.col("c_nationkey") > 15, "known_gap").otherwise("active").alias("state")))
)
query(
    "t15_stair_hints",
    """SELECT user_id AS run_id, event_id AS text_idx, CASE event_type WHEN 'view' THEN 'stair_direction' ELSE 'stair_keyword' END AS kind, CASE event_type WHEN 'view' THEN 0.62::DOUBLE ELSE 0.70::DOUBLE END AS confidence,
    concat('vertical-text-', row_number() OVER (PARTITION BY user_id ORDER BY event_id)) AS hint_id, 'medium' AS band FROM events WHERE event_type IN ('view', 'click') AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)""",
)(
    lambda s, d: evidence.stair_hints(table(s, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("text_idx"), F.coalesce(_pick("event_type", view=" Up.", click="main stairway 2"), F.lit("upstairs")).alias("text")), table(s, d, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("run_id"))).drop("text")
)
query(
    "t17_component_inventory",
    """SELECT run_id, entity_id, ordinal, band FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY place, nth) AS ordinal FROM (SELECT project_id AS run_id, entity_id, place, row_number() OVER (PARTITION BY project_id, place ORDER BY entity_id) AS nth,
    CASE WHEN confidence <= 0 THEN 'unknown' WHEN confidence * 12 >= 0.8 THEN 'high' WHEN confidence * 12 >= 0.6 THEN 'medium' ELSE 'low' END AS band FROM (SELECT *, CASE entity_type WHEN 'Room' THEN 1 WHEN 'Door' THEN 2 ELSE 3 END AS place FROM v_entity)) WHERE nth <= 12) WHERE ordinal <= 36""",
    "v_entity",
)(lambda s, d: evidence.component_inventory(view(s, d, "v_entity").select("entity_id", "entity_type", F.col("project_id").alias("run_id"), (F.col("confidence") * 12).alias("confidence"), F.lit(False).alias("uncertain"))).select("run_id", "entity_id", "ordinal", "band"))


@query(
    "t18_merge_evidence",
    """SELECT run_id, rooms, doors, concat_ws(',', CASE WHEN rooms > 0 THEN 'spatial_layout' END, CASE WHEN doors > 0 THEN 'openings' END, CASE WHEN halls > 0 THEN 'horizontal_circulation' END, 'per_sheet_graphs') AS signals,
    CASE WHEN rooms > 0 AND doors > 0 THEN 'multi_sheet_layout_with_openings' WHEN rooms > 0 THEN 'multi_sheet_component_inventory' ELSE 'basic' END AS level
    FROM (SELECT run_id, count(CASE WHEN entity_type = 'Room' THEN 1 END) AS rooms, count(CASE WHEN entity_type = 'Door' THEN 1 END) AS doors, count(CASE WHEN entity_type = 'Corridor' THEN 1 END) AS halls FROM v_entity GROUP BY 1)""",
    "v_entity",
)
def merged(s: SparkSession, d: str) -> DataFrame:
    kinds = {"rooms": "Room", "doors": "Door", "corridors": "Corridor", "stairs": "Stair", "dimensions": "Dimension"}
    counts = [F.count_if(F.col("entity_type") == k).alias(n) for n, k in kinds.items()]
    rows = view(s, d, "v_entity")
    profile = rows.groupBy("run_id").agg(*[F.count_if((F.col("entity_type") == k) & (F.col("page_index") == 1)).alias(n) for n, k in kinds.items()])
    profile = profile.withColumn("signals", F.array().cast("array<string>")).withColumn("level", F.lit("basic"))
    return evidence.merge_sheet_evidence(profile, rows.groupBy("run_id", "page_index").agg(*counts)).select("run_id", "rooms", "doors", F.array_join("signals", ",").alias("signals"), "level")


query(
    "t22_author_expected",
    """WITH a AS (SELECT o_custkey AS case_id, count(*) AS n, max(o_orderpriority) AS type FROM orders GROUP BY 1) SELECT case_id, 'n' AS name, 'count' AS op, n AS exact, NULL AS wanted FROM a
    UNION ALL SELECT case_id, 'type', 'text', NULL, type FROM a UNION ALL SELECT DISTINCT o_custkey, 'kinds', 'member', CAST(NULL AS BIGINT), o_orderpriority FROM orders""",
)(lambda s, d: evidence.author_expected(_actual(s, d)).select("case_id", "name", "op", "exact", "wanted"))


# feedback and lifecycle

query("f6_expected_counts", "SELECT o_orderpriority AS rule_id, sum(o_orderkey) AS n FROM orders GROUP BY 1")(
    lambda s, d: fb.expected_counts(table(s, d, "orders").select(F.create_map(F.col("o_orderpriority"), F.col("o_orderkey"), F.lit("_note"), F.lit(1).cast("long")).alias("counts")))
)


query(
    "l2_fingerprint",
    """SELECT o_orderkey, substr(sha256('{"o_custkey":' || o_custkey || ',"o_orderpriority":"' || o_orderpriority || '","o_totalprice":' || CAST(round(o_totalprice, 4) AS VARCHAR) || '}'), 1, 16) AS fingerprint FROM orders""",
)(lambda s, d: (lambda rows: rows.select("o_orderkey", life.fingerprint(rows, ["o_orderpriority", "o_totalprice", "o_custkey"], [])[0].alias("fingerprint")))(table(s, d, "orders").withColumn("o_totalprice", F.col("o_totalprice") + 0.00001)))
query("l3_changed_fields", "SELECT o_orderkey, concat_ws(',', CASE WHEN o_totalprice > 200000 THEN 'price' END, CASE WHEN o_custkey % 2 = 1 THEN 'cust' END) AS changed FROM orders")(
    lambda s, d: table(s, d, "orders").select("o_orderkey", F.struct(F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("cust")).alias("before"), F.struct(F.least("o_totalprice", F.lit(200000.0)).alias("price"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).alias("cust")).alias("after")).select("o_orderkey", F.array_join(life.changed_fields(["price", "cust"]), ",").alias("changed"))
)


@query(
    "l8_task_sequence",
    """, a AS (SELECT run_id, CAST(issue_id AS VARCHAR) AS task_id, status = 'candidate' AS first, row_number() OVER (PARTITION BY run_id, status = 'candidate' ORDER BY confidence NULLS FIRST, CAST(issue_id AS VARCHAR)) AS nth,
      count(*) OVER (PARTITION BY run_id, status = 'candidate') AS c FROM v_issue),
    t AS (SELECT run_id, task_id, first, nth FROM a WHERE nth <= CASE WHEN first THEN 2 ELSE 3 END UNION ALL
      SELECT DISTINCT run_id, CASE WHEN first THEN concat('open: ', c - 2, ' more') ELSE concat('rest: ', c - 3, ' more') END, first, CASE WHEN first THEN 3 ELSE 4 END FROM a WHERE c > CASE WHEN first THEN 2 ELSE 3 END)
    SELECT run_id, CASE WHEN first THEN 'open' ELSE 'rest' END AS stage, task_id, row_number() OVER (PARTITION BY run_id ORDER BY NOT first, nth) AS ordinal FROM t""",
    "v_issue",
)
def tasks(s: SparkSession, d: str) -> DataFrame:
    rows = view(s, d, "v_issue").select("run_id", F.col("issue_id").cast("string").alias("task_id"), F.col("confidence").alias("rank"), "status")
    return life.task_sequence([("open", rows.where("status = 'candidate'"), 2), ("rest", rows.where("status <> 'candidate'"), 3)]).select("run_id", "stage", "task_id", "ordinal")


def _checklist(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    orders = table(s, d, "orders").select(F.col("o_custkey").alias("package"), F.col("o_orderkey").alias("check_id"), place.alias("ordinal"), F.col("o_totalprice").alias("p"))
    p = F.col("p")
    items = orders.select("package", "check_id", "ordinal", F.lit("todo").alias("status"), F.lit("first").alias("reviewer"), F.lit(2).alias("completed_at"))
    by_id = (p > 150000) | p.between(40000, 90000) | (p < 10000)
    named = F.when(p < 10000, -F.col("check_id")).when(by_id, F.col("check_id"))
    placed = F.when(~by_id | p.between(40000, 50000), F.col("ordinal"))
    status = F.when(p > 150000, "done").when(p > 90000, "skipped_preview").when(p > 60000, "open").otherwise("blocked")
    updates = orders.select("package", named.alias("check_id"), placed.alias("ordinal"), status.alias("status"), F.lit("second").alias("reviewer"), F.lit(None).cast("string").alias("note"), F.lit(5).alias("at"), F.when(p.between(60000, 120000), 9).alias("completed_at"))
    return items, updates


query(
    "l10_update_checklist",
    """SELECT package, check_id, CASE WHEN u THEN s ELSE 'todo' END AS status, CASE WHEN NOT u THEN 2 WHEN s IN ('done', 'skipped_preview') THEN coalesce(c, 5) ELSE c END AS completed_at, CASE WHEN u THEN 'second' ELSE 'first' END AS reviewer FROM (
    SELECT o_custkey AS package, o_orderkey AS check_id, NOT (o_totalprice BETWEEN 40000 AND 50000 OR o_totalprice < 10000) AS u, CASE WHEN o_totalprice > 150000 THEN 'done' WHEN o_totalprice > 90000 THEN 'skipped_preview' WHEN o_totalprice > 60000 THEN 'open' ELSE 'blocked' END AS s,
    CASE WHEN o_totalprice BETWEEN 60000 AND 120000 THEN 9 END AS c FROM orders)""",
)(lambda s, d: life.update_checklist(*_checklist(s, d))[0].select("package", "check_id", "status", "completed_at", "reviewer"))
query("l10_rejects", "SELECT o_custkey AS package, CASE WHEN o_totalprice < 10000 THEN -o_orderkey ELSE o_orderkey END AS check_id FROM orders WHERE o_totalprice BETWEEN 40000 AND 50000 OR o_totalprice < 10000")(
    lambda s, d: life.update_checklist(*_checklist(s, d))[1].select("package", "check_id")
)
def _bundle_sql() -> str:
    """Columns of the packages of L14 by remainders of their key."""
    cases = {}
    for i, (column, value) in enumerate(life.COUNTED.values()):
        cases.setdefault(column, []).append(f"WHEN c_custkey % {3 + i} = {i % 3} THEN '{value}'")
    shown = [f"CASE {' '.join(w)} ELSE 'other' END AS {c}" for c, w in cases.items()]
    shown += [f"CASE WHEN c_custkey % {7 + i} = 0 THEN NULL ELSE c_custkey % {4 + i} END AS {c}" for i, c in enumerate(life.SUMMED.values())]
    return "SELECT " + ", ".join(shown + [f"c_custkey % {5 + i} = 1 AS {c}" for i, c in enumerate(life.HOLDING.values())]) + " FROM customer"


def _bundle(s: SparkSession, d: str) -> DataFrame:
    table(s, d, "customer").createOrReplaceTempView("customer")
    return life.bundle_summary(s.sql(_bundle_sql()))


query(
    "l14_bundle_summary",
    f"SELECT *, CASE WHEN blocked_count > 0 THEN 'bundle_blocked' ELSE 'bundle_ready' END AS status FROM (SELECT count(*) AS package_count, count(CASE WHEN checklist_open_item_count > 0 THEN 1 END) AS checklist_open_package_count, "
    + ", ".join([f"count(CASE WHEN {c} = '{v}' THEN 1 END) AS {n}" for n, (c, v) in life.COUNTED.items()] + [f"CAST(sum({c}) AS BIGINT) AS {n}" for n, c in life.SUMMED.items()] + [f"count(CASE WHEN {c} THEN 1 END) AS {n}" for n, c in life.HOLDING.items()])
    + f" FROM ({_bundle_sql()}))",
)(_bundle)
query(
    "l16_package_digest",
    """SELECT o_custkey AS package, count(*) AS n_files, sha256('[' || string_agg('{"path":"' || o_orderkey || '","sha256":"' || o_orderpriority || '","size_bytes":' || o_custkey || '}', ',' ORDER BY CAST(o_orderkey AS VARCHAR)) || ']') AS digest FROM orders GROUP BY 1""",
)(lambda s, d: life.package_digest(table(s, d, "orders").select(F.col("o_custkey").alias("package"), F.col("o_orderkey").cast("string").alias("path"), F.col("o_custkey").alias("size_bytes"), F.col("o_orderpriority").alias("sha256"))))
query("l19_report_rows", "SELECT issue_id, CASE WHEN confidence > 0.5 THEN status ELSE 'candidate' END AS status FROM v_issue", "v_issue")(
    lambda s, d: life.report_rows(view(s, d, "v_issue").select("issue_id", F.col("rule_key").alias("clause_id")), view(s, d, "v_issue").where("confidence > 0.5"), view(s, d, "v_rule").withColumnRenamed("rule_key", "clause_id"))[0].select("issue_id", "status")
)


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
