"""A training-corpus pipeline: quality filter, line and document deduplication, decontamination, mixing.

Every stage returns the rows and columns of its input but for what it takes out or
changes. Rows are named by doc_id: rows that share an id are judged apart and leave
together if one of them is rejected, and rows with a null id are never taken out.
Null texts are rejected by the quality stage (they have no perplexity) and pass all
others. Columns beside doc_id, text, lang, source and n_chars are carried along,
whatever their names. An empty table gives an empty result; an empty table of labels
or of benchmark items takes nothing out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planaudit.llm import decontaminate, line_dedup, mixing, near_dedup, quality
from planaudit.llm.common import materialize, without
from planaudit.llm.queries import trusted


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose perplexity is within the limits of their language."""
    judged = quality.classify(docs, trusted(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return without(docs, judged.where("not keep"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that are the same or nearly so, only the first stays in the corpus; n_chars follows the text."""
    text = line_dedup.drop_repeated_lines(docs)
    return text.withColumn("n_chars", F.when(text["text"].isNull(), text["n_chars"]).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id."""
    return without(docs, near_dedup.near_duplicates(docs, percent=80).where("not kept"))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    items = decontaminate.split_items(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, decontaminate.contaminated(docs, items))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, with its copy number (in place of a column `copy`, if there is one)."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("mixing sources", mixing_stage),
]

#: Language models, sketches and indexes are beyond SQL; tests/llm/test_pipeline.py holds run() against its definition.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other on the documents table, each reading what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
