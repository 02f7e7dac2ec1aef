import pytest
from pyspark.sql import functions as F

from planaudit.plans import stored
from planaudit.sources import runs
from planaudit.streaming.loading import artifact_stream, load_new, merge_runs

SCHEMA = "run_id string, id long, v double"


def rows(spark, path):
    return sorted(map(tuple, runs.read_runs(spark, path, SCHEMA).collect()))


def test_a_run_is_replaced_and_others_stay(spark, tmp_path):
    path = str(tmp_path / "t")
    a, b = [("A", 1, 1.0), ("A", 2, 2.0)], [("B", 1, 5.0)]
    runs.replace_runs(spark.createDataFrame(a, SCHEMA), path)
    runs.replace_runs(spark.createDataFrame(b, SCHEMA), path)
    kept = {f.name for f in (tmp_path / "t/rows/run_id=A").glob("*.parquet")}
    state = runs.replace_runs(spark.createDataFrame([("B", 2, 6.0), (None, 1, 1.0)], SCHEMA), path)
    assert [(r.run_id, r.n_rows, r.action) for r in state.collect()] == [("B", 1, "replaced")]
    assert rows(spark, path) == [*a, ("B", 2, 6.0)]
    assert {f.name for f in (tmp_path / "t/rows/run_id=A").glob("*.parquet")} == kept
    again = runs.replace_runs(spark.createDataFrame([*a[::-1], ("B", 2, 6.0)], SCHEMA), path)
    assert {r.action for r in again.collect()} == {"unchanged"} and len(list((tmp_path / "t/loads").glob("*.parquet"))) == 3
    emptied = runs.replace_runs(spark.createDataFrame([], SCHEMA), path, runs=spark.createDataFrame([("A",), ("C",)], "run_id string"))
    assert {(r.run_id, r.action) for r in emptied.collect()} == {("A", "replaced"), ("C", "added")}
    assert rows(spark, path) == [("B", 2, 6.0)]


def test_a_failed_load_leaves_the_old_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    old = [("A", i, 1.0) for i in range(20)]
    runs.replace_runs(spark.createDataFrame(old, SCHEMA), path)
    bad = spark.createDataFrame([("A", i, 2.0) for i in range(20)], SCHEMA)

    def breaks(batches):
        for batch in batches:
            if (batch["id"] == 7).any():
                raise RuntimeError("lost")
            yield batch

    with pytest.raises(Exception, match="lost"):
        runs.write_report(bad.repartition(4).mapInPandas(breaks, SCHEMA), f"{path}/rows")
    with pytest.raises(Exception, match="lost"):
        runs.replace_runs(bad.mapInPandas(breaks, SCHEMA), path)
    assert rows(spark, path) == old
    runs.replace_runs(bad, path)
    assert rows(spark, path) == [("A", i, 2.0) for i in range(20)]


def test_a_second_start_reads_what_is_new(spark, tmp_path):
    root, path, seen = (str(tmp_path / x) for x in ("in", "t", "seen"))

    def land(run, body):
        (tmp_path / "in/p" / run).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in/p" / run / "issues.json").write_text(body)

    def load():
        stream = artifact_stream(spark, root, "issues", "id long, v double").withColumn("at", F.lit(1)).drop("parent")
        return load_new(stream, path, seen, ["id"], "at")

    land("a_run", '[{"id": 1, "v": 1.0}, {"id": 2, "v": 2.0}]')
    assert load() == 2
    land("b_run", '[{"id": 1, "v": 3.0}]')
    assert load() == 1 and load() == 0
    got = runs.read_runs(spark, path, f"{SCHEMA}, at int")
    assert sorted((r.run_id, r.id, r.v) for r in got.collect()) == [("a_run", 1, 1.0), ("a_run", 2, 2.0), ("b_run", 1, 3.0)]


def test_merging_a_batch_twice_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([("A", 1, 1.0), ("A", 2, 2.0)], SCHEMA)
    batch = spark.createDataFrame([("A", 2, 3.0), ("A", 3, 1.0), ("A", 3, 2.0)], SCHEMA)
    merge_runs(first, path, ["id"], "v")
    merge_runs(batch, path, ["id"], "v")
    want = [("A", 1, 1.0), ("A", 2, 3.0), ("A", 3, 2.0)]
    assert rows(spark, path) == want
    assert {r.action for r in merge_runs(batch, path, ["id"], "v").collect()} == {"unchanged"} and rows(spark, path) == want


def test_names_have_oracles():
    assert set(stored.queries()) == set(stored.oracle_sql())
