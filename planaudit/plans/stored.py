"""Registered queries of artifacts and runs on disk, each with its oracle in SQL. Files are derived from the given tables and lie in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planaudit.plans.harness import table
from planaudit.sources import artifacts, runs
from planaudit.sources.shared import fresh_path
from planaudit.streaming.loading import artifact_stream, load_new

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}
ISSUE = "id long, price double, version int"
FILES = "part-*.json"


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[name] = f
        _oracles[name] = sql
        return f

    return add


def _land(df: DataFrame, root: str) -> str:
    """JSON artifacts in a folder for each project and, in it, for each run."""
    df.write.mode("append").partitionBy("parent", "run").json(root)
    return root


def _issues(spark: SparkSession, sf_dir: str, version: int = 1) -> DataFrame:
    customer = F.col("o_custkey")
    parent = F.concat(F.lit("p"), customer % 3).alias("parent")
    run = F.concat(F.lit("r"), customer % 30, F.when(customer % 30 == 7, "_draft").otherwise("_run")).alias("run")
    return table(spark, sf_dir, "orders").select(parent, run, F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.lit(version).alias("version"))


_RUN = "concat('r', o_custkey % 30, CASE WHEN o_custkey % 30 = 7 THEN '_draft' ELSE '_run' END)"


@query("s1_artifacts", f"SELECT o_orderkey AS id, o_totalprice AS price, concat('p', o_custkey % 3) AS parent, {_RUN} AS run_id FROM orders")
def read_back(s: SparkSession, d: str) -> DataFrame:
    root = _land(_issues(s, d), fresh_path(s, "artifacts"))
    return artifacts.read_artifacts(s, root, "issues", ISSUE, FILES).select("id", "price", "parent", "run_id")


@query(
    "s3_suite",
    f"""SELECT o_orderkey AS id, concat('p', o_custkey % 3, '/', {_RUN}) AS run_id, concat('p', o_custkey % 3, '-r', o_custkey % 30) AS project_slug, n_issues FROM orders
    JOIN (SELECT o_custkey % 30 AS k, count(*) AS n_issues FROM orders GROUP BY 1) ON k = o_custkey % 30 WHERE o_custkey % 30 <> 7""",
)
def suite(s: SparkSession, d: str) -> DataFrame:
    issues, root = _issues(s, d), fresh_path(s, "artifacts")
    _land(issues, f"{root}/issues")
    _land(issues.groupBy("parent", "run").agg(F.count("*").alias("n_issues")), f"{root}/project")
    rows = artifacts.ingest_suite(s, f"{root}/issues", {"issues": ISSUE}, {"issues": FILES})["issues"]
    project = artifacts.ingest_suite(s, f"{root}/project", {"project": "n_issues long"}, {"project": FILES})["project"]
    return rows.join(project, ["run_id", "project_slug"]).select("id", "run_id", "project_slug", "n_issues")


def _facts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select((F.col("o_custkey") % 40).cast("string").alias("run_id"), "o_orderkey", "o_totalprice")


def _run(df: DataFrame, cond: Callable[[Column], Column]) -> DataFrame:
    return df.where(cond(F.col("run_id").cast("int")))


def _reloaded(s: SparkSession, d: str) -> tuple[str, DataFrame]:
    """Runs 0-29 are loaded, then 20-39 with other prices, of which run 25 has no rows any more, then these again."""
    facts, path = _facts(s, d), fresh_path(s, "runs")
    runs.replace_runs(_run(facts, lambda r: r < 30), path)
    late = _run(facts, lambda r: r >= 20).withColumn("o_totalprice", F.round(F.col("o_totalprice") * 2, 2))
    for _ in range(2):
        state = runs.replace_runs(_run(late, lambda r: r != 25), path, runs=late.select("run_id"))
    return path, state


@query(
    "u3_replace_runs",
    """SELECT CAST(o_custkey % 40 AS VARCHAR) AS run_id, o_orderkey, CASE WHEN o_custkey % 40 >= 20 THEN round(o_totalprice * 2, 2) ELSE o_totalprice END AS o_totalprice
    FROM orders WHERE o_custkey % 40 <> 25""",
)
def replaced(s: SparkSession, d: str) -> DataFrame:
    return runs.read_runs(s, _reloaded(s, d)[0], "run_id string, o_orderkey long, o_totalprice double")


@query(
    "u3_repeated_load",
    """SELECT CAST(o_custkey % 40 AS VARCHAR) AS run_id, CASE WHEN o_custkey % 40 = 25 THEN 0 ELSE count(*) END AS n_rows, 'unchanged' AS action
    FROM orders WHERE o_custkey % 40 >= 20 GROUP BY o_custkey % 40""",
)
def repeated(s: SparkSession, d: str) -> DataFrame:
    return _reloaded(s, d)[1].select("run_id", "n_rows", "action")


@query("s7_report", "SELECT CAST(o_custkey % 40 AS VARCHAR) AS run_id, o_orderkey, CASE WHEN o_custkey % 40 < 10 THEN -1.0::DOUBLE ELSE o_totalprice END AS o_totalprice FROM orders")
def report(s: SparkSession, d: str) -> DataFrame:
    facts, path = _facts(s, d), fresh_path(s, "reports")
    runs.write_report(facts, path, fmt="json")
    runs.write_report(_run(facts, lambda r: r < 10).withColumn("o_totalprice", F.lit(-1.0)), path, fmt="json")
    return s.read.schema("run_id string, o_orderkey long, o_totalprice double").json(path).select("run_id", "o_orderkey", "o_totalprice")


@query(
    "u1_stream_load",
    f"""SELECT {_RUN} AS run_id, o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN -o_totalprice ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 10 = 0 THEN 2 ELSE 1 END AS version,
    (SELECT count(*) FROM orders WHERE o_orderkey % 2 = 1 OR o_orderkey % 10 = 0) AS read_later FROM orders""",
)
def streamed(s: SparkSession, d: str) -> DataFrame:
    """Even orders land and are loaded; then the odd ones and new versions of every tenth land, and the next start reads these alone."""
    root, path, seen = (fresh_path(s, k) for k in ("artifacts", "runs", "offsets"))
    even, tenth = F.col("id") % 2 == 0, F.col("id") % 10 == 0
    read = 0
    for drop in (_issues(s, d).where(even), _issues(s, d).where(~even).unionByName(_issues(s, d, 2).where(tenth).withColumn("price", -F.col("price")))):
        _land(drop, root)
        read = load_new(artifact_stream(s, root, "issues", ISSUE, FILES).drop("parent"), path, seen, ["id"], "version")
    return runs.read_runs(s, path, "run_id string, id long, price double, version int").withColumn("read_later", F.lit(read).cast("long"))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
