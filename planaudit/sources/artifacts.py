"""Run artifacts (S1-S3, S6, L16); `runs` writes them."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from planaudit.operators.lifecycle import file_role

# Artifact kinds and their file names.
ARTIFACTS = {"graph": "entity_graph.json", "issues": "issues.json", "sheets": "sheet_classification.json", "state": "review_state.json", "project": "project_meta.json", "profile": "drawing_profile.json", "skipped": "skipped_rules.json"}
ENTITY_TYPES = {"rooms": "Room", "doors": "Door", "walls": "Wall", "corridors": "Corridor", "stairs": "Stair"}
COMMON = ["id", "page_index", "confidence", "uncertain"]


def located(reader: DataFrameReader | DataStreamReader, root: str, kind: str, pattern: str | None = None) -> DataFrame:
    """Files of one kind below root with run_id and parent, the names of the two folders above a file (as `name` or `key=name`)."""
    rows = reader.option("recursiveFileLookup", True).option("pathGlobFilter", pattern or ARTIFACTS[kind]).json(root)
    path = F.split(F.col("_metadata.file_path"), "/")
    names = {c: F.url_decode(F.regexp_replace(F.element_at(path, at), "^[^=]*=", "")) for c, at in (("run_id", -2), ("parent", -3))}
    return rows.withColumns(names)


def read_artifacts(spark: SparkSession, root: str, kind: str, schema: str, pattern: str | None = None) -> DataFrame:
    """One kind of artifact of all runs below root, with run_id and parent from the path; an empty table if there is none.

    Files have the kind's name and hold one object or array each; with a `pattern` of their own they hold one object a line.
    """
    try:
        return located(spark.read.schema(schema).option("multiLine", pattern is None), root, kind, pattern)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"{schema}, run_id string, parent string")


def flatten_entities(graphs: DataFrame) -> DataFrame:
    """Five per-type arrays to one table; fields beyond the common ones become properties (variant)."""
    parts = []
    for field, kind in ENTITY_TYPES.items():
        if field not in graphs.columns:
            continue
        rows = graphs.select("run_id", F.explode(field).alias("e"))
        rest = [f.name for f in graphs.schema[field].dataType.elementType.fields if f.name not in COMMON]
        extra = F.parse_json(F.to_json(F.struct(*[F.col(f"e.{n}").alias(n) for n in rest]))) if rest else F.parse_json(F.lit("{}"))
        parts.append(rows.select("run_id", F.lit(kind).alias("entity_type"), F.col("e.id").alias("entity_id"), *[F.col(f"e.{c}").alias(c) for c in COMMON[1:]], extra.alias("properties")))
    return reduce(DataFrame.unionByName, parts)


def ingest_suite(spark: SparkSession, root: str, schemas: dict[str, str], patterns: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """S3: every *_run directory; the project is its parent and its own name without _run, and so is the run's id."""
    out = {}
    for kind, schema in schemas.items():
        rows = read_artifacts(spark, root, kind, schema, (patterns or {}).get(kind)).where(F.col("run_id").endswith("_run"))
        slug = F.concat_ws("-", "parent", F.regexp_replace("run_id", "_run$", ""))
        out[kind] = rows.withColumn("project_slug", slug).withColumn("run_id", F.concat_ws("/", "parent", "run_id")).drop("parent")
    return out


def parse_pipe_tables(lines: DataFrame, keys: list[str], line_no: str = "line_no", text: str = "line") -> DataFrame:
    """Cells of pipe tables: keys, block, row, column name and value.

    The first pipe line of a block is its header, the rule line below it is skipped, a line without pipes ends the
    block, and rows with another number of cells are dropped.
    """
    order = Window.partitionBy(*keys).orderBy(line_no)
    is_row = F.trim(F.col(text)).startswith("|")
    rows = lines.withColumn("_pipe", is_row).withColumn("block", F.sum((~is_row).cast("int")).over(order)).where("_pipe")
    cells = F.transform(F.split(F.regexp_replace(F.trim(F.col(text)), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    rows = rows.withColumn("cells", cells).withColumn("at", F.row_number().over(Window.partitionBy(*keys, "block").orderBy(line_no)))
    rows = rows.where(~F.forall("cells", lambda c: c.rlike("^:?-+:?$")))
    head = rows.where("at = 1").select(*keys, "block", F.col("cells").alias("names"))
    body = rows.where("at > 1").join(head, [*keys, "block"]).where("size(cells) = size(names)")
    return body.select(*keys, "block", F.col(line_no).alias("row"), F.inline(F.arrays_zip(F.col("names").alias("name"), F.col("cells").alias("value"))))


def file_manifest(spark: SparkSession, root: str) -> DataFrame:
    """Path below root, role, size and SHA-256 of every file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    below = re.sub(r"^\w+:/*", "/", root).rstrip("/") + "/"
    path = F.substring("path", F.locate(below, F.col("path")) + len(below), F.length("path"))
    return files.select(path.alias("path"), file_role(path).alias("role"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
