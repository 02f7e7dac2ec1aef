"""Views of the driver's tables in the shape of the library's inputs.

The view texts are plain SQL that Spark and DuckDB read alike; queries and oracles share them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_entity": """SELECT l_orderkey AS run_id, l_linenumber AS page_index, l_partkey % 64 AS project_id,
        concat(CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(20)), '-', CAST(l_partkey AS VARCHAR(20)), '-', CAST(l_suppkey AS VARCHAR(20))) AS entity_id,
        CASE l_returnflag WHEN 'A' THEN 'Room' WHEN 'N' THEN 'Door' ELSE 'Corridor' END AS entity_type,
        CASE WHEN l_quantity % 7 = 0 THEN NULL ELSE l_quantity / 20.0E0 END AS width_m,
        l_discount + 0.0E0 AS slope, l_extendedprice / 1000.0E0 AS area_m2, l_tax + 0.0E0 AS confidence, l_linestatus AS mark FROM lineitem""",
    "v_project": "SELECT c_custkey AS project_id, c_name AS slug, c_mktsegment AS building_type, CASE WHEN c_nationkey % 4 = 0 THEN NULL WHEN c_nationkey % 4 = 1 THEN 'high' ELSE 'low' END AS height_class, c_acctbal AS height_m FROM customer",
    "v_drawing": "SELECT p_partkey AS drawing_id, p_partkey % 50 AS project_id, concat('d', CAST(p_partkey AS VARCHAR(20))) AS source_path, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 5 = 1 THEN 0 ELSE p_size END AS page_count FROM part",
    "v_run": "SELECT p_partkey AS run_id, p_partkey AS drawing_id, p_partkey % 50 AS project_id FROM part",
    "v_rule": "SELECT r_regionkey AS rule_key, concat('STD', CAST(r_regionkey AS VARCHAR(20)), '-1') AS rule_id FROM region",
    "v_clause": "SELECT concat('STD', CAST(n_regionkey AS VARCHAR(20)), '-', n_name) AS clause_id, concat('STD', CAST(n_regionkey AS VARCHAR(20))) AS standard_id, n_name AS clause_text FROM nation",
    "v_issue": """SELECT o_orderkey AS issue_id, o_orderkey % 200 AS run_id, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderkey % 4 AS INT) END AS rule_key,
        CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS entity_key, concat('I', CAST(o_orderkey AS VARCHAR(20))) AS source_issue_id, o_orderpriority AS severity,
        CASE o_orderkey % 6 WHEN 0 THEN 'candidate' WHEN 1 THEN 'confirmed' WHEN 2 THEN 'rejected' WHEN 3 THEN 'needs_info' WHEN 4 THEN 'resolved' ELSE 'superseded' END AS status,
        CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE (o_orderkey % 100) / 100.0E0 END AS confidence FROM orders""",
    "v_event": """SELECT event_id, event_id % 1500 AS issue_id, concat('u', CAST(user_id AS VARCHAR(20))) AS reviewer_id, concat('R', CAST(user_id % 12 AS VARCHAR(20))) AS rule_id,
        CASE event_type WHEN 'purchase' THEN 'confirm' WHEN 'error' THEN 'reject' WHEN 'view' THEN 'comment' WHEN 'click' THEN 'needs_info' ELSE 'resolve' END AS event_type FROM events""",
    "v_reviewer": """SELECT DISTINCT user_id, CASE user_id % 5 WHEN 0 THEN concat('synthetic-', CAST(user_id AS VARCHAR(20))) WHEN 1 THEN concat('demo-reviewer', CAST(user_id AS VARCHAR(20)))
        WHEN 2 THEN concat(' smoke-runner-', CAST(user_id AS VARCHAR(20))) ELSE concat('u', CAST(user_id AS VARCHAR(20))) END AS reviewer_id,
        CASE user_id % 3 WHEN 0 THEN 'independent_third_party' WHEN 1 THEN 'project_internal' END AS reviewer_class FROM events""",
    "v_label": """SELECT event_id, CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_id % 1500 END AS issue_id, user_id, event_type = 'purchase' AS is_label, event_type,
        CASE user_id % 5 WHEN 0 THEN concat('synthetic-', CAST(user_id AS VARCHAR(20))) WHEN 1 THEN concat('demo-reviewer', CAST(user_id AS VARCHAR(20)))
        WHEN 2 THEN concat(' smoke-runner-', CAST(user_id AS VARCHAR(20))) ELSE concat('u', CAST(user_id AS VARCHAR(20))) END AS reviewer_id,
        CASE event_id % 6 WHEN 0 THEN 'independent_third_party' WHEN 1 THEN 'project_internal' WHEN 2 THEN 'synthetic' WHEN 3 THEN 'odd' WHEN 4 THEN '' END AS reviewer_class FROM events""",
    "v_segment": "SELECT l_linenumber AS page_index, l_extendedprice % 500 AS x0, l_suppkey * 2.0E0 AS y0, l_extendedprice % 500 + l_quantity AS x1, l_suppkey * 2.0E0 AS y1 FROM lineitem",
    "v_box": "SELECT p_partkey AS space_id, p_partkey % 20 AS page_index, (p_partkey % 37) * 12.0E0 AS x0, (p_partkey % 23) * 9.0E0 AS y0, (p_partkey % 37) * 12.0E0 + p_size * 3.0E0 AS x1, (p_partkey % 23) * 9.0E0 + (p_partkey % 9 + 1) * 4.0E0 AS y1 FROM part",
    "v_point": "SELECT event_id AS text_idx, event_id % 20 AS page_index, CASE WHEN value IS NULL THEN 0.0E0 ELSE value END AS x, CAST(event_id % 200 AS DOUBLE) AS y, event_type AS label FROM events",
}
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view as a DataFrame; its base table becomes a temporary view of the session."""
    base = VIEWS[name].rsplit("FROM ", 1)[1].strip()
    table(spark, sf_dir, base).createOrReplaceTempView(base)
    return spark.sql(VIEWS[name])


def oracle(body: str, *names: str) -> str:
    """SQL over views: the views as common table expressions, then the body."""
    views = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    return f"WITH {views} {body}"
