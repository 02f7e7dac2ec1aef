import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from planaudit.llm import mixing

RNG = random.Random(77)
VOCAB = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 7))) for _ in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, component_id int, copy string"


def sentence(n):
    return " ".join(RNG.choice(VOCAB) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean documents with copies, near copies, junk, a shared line, leaks, nulls and repeated rows."""
    clean = {i: sentence(80) for i in range(120)}
    items = [(k, sentence(30) + ". " + sentence(6) + ".") for k in range(5)] + [(9, None)]
    near = clean[3].split()
    near[40] = "changed"
    line = sentence(40)
    extra = {
        200: clean[2],  # an exact copy
        201: " ".join(near),  # a near copy
        202: "#### $$$$ %%%% " * 40,  # junk
        203: f"{sentence(60)} {items[2][1]} {sentence(60)}",  # a leak
        204: f"{line}\n{sentence(70)}",
        205: f"{sentence(70)}\n{line}",  # repeats a line
        206: None,
        207: "",
    }
    rows = [(i, t, "en" if i % 7 else None, f"s{i % 3}" if i % 11 else None, None if t is None else len(t), "clash", 1, "clash") for i, t in (clean | extra).items()]
    rows += [rows[5], (None, sentence(80), "en", "s0", 10, "clash", 1, "clash")]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(100)] + [(202, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_each_stage_does_its_work_on_what_it_gets(spark, corpus):
    path, rows = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    every = Counter(r[0] for r in rows)
    assert ids(corpus_pipeline.quality_stage(spark, docs, path)) == every - Counter({202: 1, 206: 1, 207: 1})
    text = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_stage(spark, docs, path).collect()}
    by_id = {r[0]: r[1] for r in rows}
    first_half = by_id[205].split("\n")[0]
    # whole texts of one line go as well if they repeat an earlier one
    want = by_id | {205: first_half, 200: "", 201: ""}
    assert text == {i: (t, None if t is None else len(t)) for i, t in want.items() if i is not None} | {None: (by_id[None], len(by_id[None]))}
    assert ids(corpus_pipeline.near_stage(spark, docs, path)) == every - Counter({200: 1, 201: 1})
    assert ids(corpus_pipeline.benchmark_stage(spark, docs, path)) == every - Counter({203: 1})
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, path).columns == docs.columns


def test_the_whole_pipeline(spark, corpus):
    path, rows = corpus
    got = corpus_pipeline.run(spark, path).collect()
    survivors = Counter(r[0] for r in rows) - Counter({202: 1, 203: 1, 206: 1, 207: 1})
    assert {r.doc_id for r in got} <= set(survivors) and len(got) > 80
    # copies of one line have nothing left, and are no group any more
    left = {200: "", 201: "", 205: next(r[1] for r in rows if r[0] == 205).split("\n")[0]}
    assert all(r.text == left.get(r.doc_id, next(x[1] for x in rows if x[0] == r.doc_id)) for r in got)
    kept = [(r[0], left.get(r[0], r[1]), *r[2:]) for r in rows if r[0] in survivors]
    plan = {r.doc_id: r.copies for r in mixing.plan_mix(spark.createDataFrame(kept, SCHEMA)).collect()}
    assert {i: n for i, n in Counter(r.doc_id for r in got).items() if survivors[i] == 1} == {i: n for i, n in plan.items() if n and survivors[i] == 1}
    assert all(1 <= r.copy <= 3 for r in got) and "copy" in got[0].asDict()


def test_empty_tables(spark, corpus, tmp_path):
    path, _ = corpus
    none = str(tmp_path / "none")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{none}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{none}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{none}/benchmark.parquet")
    assert corpus_pipeline.run(spark, none).count() == 0
    docs = spark.read.parquet(f"{path}/documents.parquet")
    # without labels nothing trains: only texts without characters go
    assert set(ids(docs)) - set(ids(corpus_pipeline.quality_stage(spark, docs, none))) == {206, 207}
    assert ids(corpus_pipeline.benchmark_stage(spark, docs, none)) == ids(docs)


def test_columns_named_like_the_helpers_are_carried_along(spark, corpus):
    path, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    names = ["_id", "_gone", "_copies", "_new", "_left", "Copy"]
    plain = docs
    for name in names:
        docs = docs.withColumn(name, F.concat(F.lit(name), F.col("doc_id").cast("string")))
    for _, stage in corpus_pipeline.STAGES:
        docs, plain = (stage(spark, x, path) for x in (docs, plain))
    assert set(names) <= set(docs.columns) | {"Copy"}
    assert Counter(r.doc_id for r in docs.collect()) == Counter(r.doc_id for r in plain.collect())
    assert docs.where(F.col("_id") != F.concat(F.lit("_id"), F.col("doc_id").cast("string"))).count() == 0
