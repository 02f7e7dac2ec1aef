"""Clause sources and rule drafts (T9, T11), text diagnostics and drawing profiles (T14, T16), region suggestions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planaudit.operators import tiles
from planaudit.operators.geometry import boxed, nearest_targets
from planaudit.operators.text import normalize_labels, numbers
from planaudit.sources.shared import written

#: Runs of a page in which section numbers can stand.
NUMBERED = re.compile(r"[0-9A-Za-z]+(?:\.[0-9A-Za-z]*)+")

# Keywords of a clause in order, with the rule's scope and inputs.
SCOPES = [
    (["走廊", "通廊"], "Corridor", ["min_width_m"]),
    (["户门", "门"], "Door", ["width_m"]),
    (["楼梯", "踏步"], "Stair", []),
    (["净高"], "Room", ["net_height_m"]),
    (["使用面积", "卧室", "起居室"], "Room", ["area_m2"]),
    (["电梯", "高度", "层"], "Project", ["floors", "height_m"]),
    (["栏杆", "窗台"], "Dimension", ["height_m"]),
]
STAIR_INPUTS = [("扶手", "handrail_height_m"), ("宽度", "flight_width_m")]
MENTION = r"(?i)\d+(?:\.\d+)?\s*(?:m\^2|m²|m|mm|层|个|%)"
# Confidences below and above which a text needs review.
LOW, HIGH = 0.70, 0.85
# Keywords of regions, the right part of a page, paddings, limit of excluded texts.
TITLE = ["title", "sheet", "project", "drawing", "revision", "rev", "date", "scale", "not for review"]
REGIONS = {"schedule": ["schedule", "table", "row", "door schedule", "room schedule"], "legend": ["legend", "symbol", "abbrev", "abbreviation", "notes"]}
RIGHT, TITLE_PAD, WORD_PAD, TITLE_GAP, EXCLUDED = 0.68, 12.0, 10.0, 8.0, 20


def _any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def _marks(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[pa.RecordBatch]:
    """Of pages (source, page_index, text), everything in a run of letters, digits and dots that may be a section number.

    at: where it stands; head: where the line break and blanks before it begin, if it can be a heading.
    """
    for batch in batches:
        rows: dict[str, list] = {"row": [], "mark": [], "at": [], "head": []}
        for row, text in enumerate(batch.column(2).to_pylist()):
            for run in NUMBERED.finditer(text or ""):
                word, begin = run.group(), run.start()
                if not re.search("[0-9]", word):
                    continue
                blank = begin
                while blank and text[blank - 1].isspace():
                    blank -= 1
                head = 0 if blank == 0 else text.find("\n", blank, begin)
                for i in range(len(word)):
                    for j in range(i + 3, min(len(word), i + longest) + 1):
                        mark = word[i:j]
                        if mark[0] != "." and "." in mark and (mark[-1] == "." or mark[-1].isdigit()):
                            rows["row"].append(row)
                            rows["mark"].append(mark)
                            rows["at"].append(begin + i)
                            rows["head"].append(head if i == 0 and head >= 0 and not text[begin + j : begin + j + 1].isdecimal() else None)
        own = pa.array(rows["row"], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array(rows["mark"], pa.string()), pa.array(rows["at"], pa.int32()), pa.array(rows["head"], pa.int32())], names=["source", "page_index", "mark", "at", "head"])


def source_coverage(clauses: DataFrame, page_texts: DataFrame) -> DataFrame:
    """clause_id, numbers only in the source's body of a paraphrased clause, numbers only in its text, body length.

    clauses: clause_id (code-path, as STD-5.5.27), source, clause_text, paraphrase; page_texts: source, page_index, text.
    The body starts at the heading, a line that begins with the path, and ends before the next sibling, else before the
    next section, on the first page that has either; pages between are whole. The last part of the clause's own path is
    no number of the body, unless the body states it beside its mentions of the path. A clause without a body gives no row. Paths are of ASCII letters, digits and dots, and none
    is looked for across the end of a page.

    Every page is searched once for all that may be a section number; these marks, not texts, meet the clauses. The end
    of a clause is the next mark behind its start, in order of page and place. Each page then gets the places at which
    to cut it for all clauses at once, so its text is moved once however many clauses cite its source.
    """
    path = F.regexp_replace("clause_id", "^[^-]*-", "")
    parts = F.split("path", r"\.")
    n, leaf = F.size("parts"), F.element_at("parts", -1)
    up = F.try_element_at("parts", F.size("parts") - 1).try_cast("int")
    wanted = clauses.where("paraphrase").withColumn("path", path).withColumn("parts", parts).where((n > 1) & leaf.rlike(r"^\d+$"))
    wanted = wanted.withColumn("sibling", F.array_join(F.concat(F.slice("parts", F.lit(1), n - 1), F.array((leaf.cast("int") + 1).cast("string"))), "."))
    wanted = wanted.withColumn("section", F.concat(F.array_join(F.concat(F.slice("parts", F.lit(1), F.greatest(n - 2, F.lit(0))), F.array((up + 1).cast("string"))), "."), F.lit(".")))
    longest = wanted.agg(F.max(F.greatest(F.length("path"), F.length("sibling"), F.length("section")))).first()[0] or 0
    pages = page_texts.select("source", "page_index", "text")
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    marks = pages.mapInArrow(lambda it: _marks(it, longest), f"source {kinds['source']}, page_index {kinds['page_index']}, mark string, at int, head int")
    known = wanted.select("source", F.explode(F.array("path", "sibling", "section")).alias("mark")).distinct()
    marks = written(marks.join(known, ["source", "mark"], "left_semi"))
    heads = marks.where("head is not null").groupBy("source", F.col("mark").alias("path")).agg(F.min(F.struct("page_index", "head")).alias("start"))
    begun = written(wanted.join(heads, ["source", "path"]).select("clause_id", "source", "path", "sibling", "section", "start"))
    # where a clause looks ahead from, among the marks that end it, latest first
    names = F.explode(F.array(*[F.struct(F.lit(k).alias("rank"), F.col(c).alias("mark")) for k, c in enumerate(("sibling", "section"))])).alias("m")
    asked = begun.select("source", "clause_id", "start.page_index", (F.col("start.head") + F.length("path")).cast("int").alias("at"), names).where("m.mark is not null")
    asked = asked.select("source", "m.mark", "page_index", "at", "clause_id", "m.rank", F.lit(0).alias("found"))
    seen = marks.select("source", "mark", "page_index", "at", F.lit(None).cast(wanted.schema["clause_id"].dataType).alias("clause_id"), F.lit(None).cast("int").alias("rank"), F.lit(1).alias("found"))
    ahead = Window.partitionBy("source", "mark").orderBy(F.desc("page_index"), F.desc("at"), F.desc("found")).rowsBetween(Window.unboundedPreceding, 0)
    place = F.last(F.when(F.col("found") == 1, F.struct("page_index", "at")), ignorenulls=True).over(ahead)
    ends = asked.unionByName(seen).withColumn("next", place).where("found = 0 and next is not null")
    ends = ends.groupBy("clause_id", "source").agg(F.min(F.struct("next.page_index", "rank", "next.at")).alias("end"))
    last = pages.groupBy("source").agg(F.max("page_index").alias("last"))
    spans = begun.join(ends, ["clause_id", "source"], "left").join(last, "source")
    spans = spans.select("clause_id", "source", "start", "end", F.explode(F.sequence(F.col("start.page_index"), F.coalesce("end.page_index", "last"))).alias("page_index"))
    low = F.when(F.col("page_index") == F.col("start.page_index"), F.col("start.head")).otherwise(0)
    high = F.when(F.col("page_index") == F.col("end.page_index"), F.col("end.at"))
    cuts = spans.groupBy("source", "page_index").agg(F.collect_list(F.struct("clause_id", low.alias("low"), high.alias("high"))).alias("cuts"))
    pieces = pages.join(cuts, ["source", "page_index"]).select("page_index", "text", F.explode("cuts").alias("c"))
    piece = F.substring("text", F.col("c.low") + 1, F.coalesce("c.high", F.length("text")) - F.col("c.low"))
    pieces = pieces.select("c.clause_id", "page_index", piece.alias("t"))
    body = pieces.groupBy("clause_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_index", "t"))), lambda v: v["t"]), "").alias("body"))
    mention = F.concat(F.lit(r"(?<![0-9A-Za-z.])\Q"), F.col("path"), F.lit(r"\E(?![0-9])"))
    stated = numbers(F.regexp_replace(F.col("body"), mention, F.lit(" ")), "clause")
    own = F.array(F.when(~F.array_contains(stated, leaf.cast("double")), leaf.cast("double")))
    rows = body.where("body <> ''").join(wanted.select("clause_id", "clause_text", "path", "parts"), "clause_id")
    rows = rows.withColumn("b", F.array_except(numbers(F.col("body"), "clause"), own)).withColumn("c", numbers(F.col("clause_text"), "clause"))
    only = [F.array_sort(F.array_except(a, b)).alias(name) for a, b, name in (("b", "c", "source_only"), ("c", "b", "text_only"))]
    return rows.select("clause_id", *only, F.length("body").alias("body_chars"))


def draft_rules(clauses: DataFrame) -> DataFrame:
    """A draft for each clause: scope and inputs by the first keyword, expression, boundary cases and what is missing.

    clauses: clause_id, clause_text, threshold_op, threshold_value. Cases: the threshold itself, and a tenth beyond it.
    """
    text, op, value = F.coalesce("clause_text", F.lit("")), F.col("threshold_op"), F.col("threshold_value")
    none = F.array().cast("array<string>")
    scope, inputs = F.lit(None).cast("string"), none
    for words, kind, names in reversed(SCOPES):
        own = F.array(*[F.lit(n) for n in names]) if names else none
        if kind == "Stair":
            for word, name in reversed(STAIR_INPUTS):
                own = F.when(F.contains(text, F.lit(word)), F.array(F.lit(name))).otherwise(own)
        hit = _any(text, words)
        scope, inputs = F.when(hit, F.lit(kind)).otherwise(scope), F.when(hit, own).otherwise(inputs)
    rows = clauses.withColumn("applies_to", scope).withColumn("inputs", inputs)
    ready = (F.size("inputs") > 0) & op.isNotNull() & value.isNotNull()
    plain = F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))
    logic = F.when(ready, F.concat_ws(" ", F.element_at("inputs", 1), op, plain))
    floor = op.isin(">", ">=")
    beyond = F.when(value == 0, F.when(floor, -1.0).otherwise(1.0)).otherwise(F.when(floor, value * 0.9).otherwise(value * 1.1))
    cases = F.array(F.struct(F.lit("edge").alias("name"), value.alias("value"), op.isin(">=", "<=").alias("expect_pass")), F.struct(F.when(floor, "below").otherwise("above").alias("name"), beyond.alias("value"), F.lit(False).alias("expect_pass")))
    missing = F.array_compact(F.array(F.when(F.col("applies_to").isNull() | (F.size("inputs") == 0), F.lit("entity_input_mapping")), F.when(op.isNull() | value.isNull(), F.lit("machine_readable_threshold")), F.when(F.regexp_count(text, F.lit(MENTION)) > 1, F.lit("rule_split_or_branching"))))
    return rows.select("clause_id", "applies_to", "inputs", logic.alias("logic_expression"), F.when(ready & op.isin(">", ">=", "<", "<="), cases).alias("test_cases"), missing.alias("missing"))


def _held(texts: pa.Table, rooms: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Places of texts and of the first room that each lies in."""
    order = tiles.in_order(rooms, ["space_idx", "space_id", "room_label"])
    at, rings = tiles.boxes(texts), tiles.rings(rooms)
    rings = [rings[k] for k in order]
    shaped = np.array([r is not None for r in rings])

    def check(q: np.ndarray, i: np.ndarray) -> np.ndarray:
        ok = ~shaped[i]
        q, i = q[~ok], i[~ok]
        ok[~ok] = tiles.inside([rings[k] for k in i], at[0, q], at[1, q])
        return ok

    found = tiles.first_over(at, tiles.column(texts, "_page"), tiles.boxes(rooms)[:, order], tiles.column(rooms, "_page")[order], check if shaped.any() else None)
    held = np.flatnonzero(found >= 0)
    return held, order[found[held]]


def ocr_diagnostics(texts: DataFrame, rooms: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Texts with the room they lie in and the reasons to review them, and the counts of each page.

    texts: keys, text_idx, text, confidence, x, y; rooms: keys, space_id, space_idx, polygon, label. The first room by
    space_idx takes the text. Reasons: label_conflict, unbound_high_confidence_label, low_confidence_label.
    """
    named = boxed(rooms.select(*keys, "space_id", "space_idx", "polygon", F.col("label").alias("room_label")))
    points = texts.select(*keys, "text_idx", *[c.cast("double").alias(n) for n, c in tiles.point("x", "y").items()])
    held = tiles.meet(points, named, keys, _held, ["space_idx", "space_id", "room_label"]).groupBy(*keys, "text_idx").agg(F.min(F.struct("space_idx", "space_id", "room_label")).alias("r"))
    rows = texts.join(held, [*keys, "text_idx"], "left").withColumn("label", normalize_labels(F.col("text"))).withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    low, bound = F.col("confidence") < LOW, F.col("r").isNotNull()
    reasons = F.array(
        F.when(F.nullif(F.col("r.room_label"), F.lit("")) != F.col("label"), F.lit("label_conflict")),
        F.when(~bound & (F.col("confidence") >= HIGH), F.lit("unbound_high_confidence_label")),
        F.when(low, F.lit("low_confidence_label")),
    )
    none = F.array().cast("array<string>")
    rows = rows.select(*keys, "text_idx", "label", F.col("r.space_id").alias("space_id"), low.alias("low_confidence"), bound.alias("bound"), F.when(F.col("label").isNotNull(), F.array_compact(reasons)).otherwise(none).alias("reasons"))
    counts = [F.count_if(F.array_contains("reasons", r)).alias(r) for r in ("label_conflict", "unbound_high_confidence_label", "low_confidence_label")]
    return rows, rows.groupBy(*keys).agg(F.count("*").alias("texts"), F.count_if("bound").alias("bound_texts"), F.count_if("low_confidence").alias("low_confidence_texts"), *counts)


def dimension_targets(texts: DataFrame, targets: DataFrame, keys: list[str], cap: float) -> DataFrame:
    """Each text with the door or corridor whose centre is nearest, strictly within cap; texts without one are left out.

    texts: keys, text_idx, text, x, y; targets: keys, kind (corridor or door), target_idx, target_id, x, y, value_m. A
    text that names only doors or only corridors looks at those alone; corridors come first among equals, then the
    smaller target_idx.
    """
    rows = texts.select(*keys, "text_idx", "text", "x", "y")
    near = nearest_targets(rows, targets, keys, ["kind", "target_idx", "target_id", "value_m"], ["kind", "target_idx", "target_id", "value_m"], cap)
    return near.groupBy(*keys, "text_idx").agg(F.min(F.struct("dist", "kind", "target_idx", "target_id", "value_m")).alias("b")).select(*keys, "text_idx", "b.kind", "b.target_id", "b.value_m", "b.dist")


def drawing_profile(counts: DataFrame) -> DataFrame:
    """run_id, drawing type, likely design, level, signals and doubts.

    counts: run_id and rooms, doors, corridors, stairs, dimensions, dimension_texts, texts, lines, unlabeled_rooms,
    residential_rooms, uncertain_stairs, review_texts; null counts as none.
    """
    has = {c: F.coalesce(F.col(c), F.lit(0)) > 0 for c in counts.columns if c != "run_id"}
    measured = has["dimensions"] | has["dimension_texts"]
    kind = F.when(has["rooms"] | has["doors"] | has["corridors"], "floor_plan").when(has["stairs"], "vertical_circulation").when(has["lines"], "line_drawing").otherwise("unknown")
    design = F.when(has["residential_rooms"], "residential_plan").otherwise(kind)
    level = F.when(has["rooms"] & has["doors"] & measured, "layout_with_dimensions").when(has["rooms"] | has["doors"] | has["corridors"] | has["stairs"], "component_inventory").when(has["lines"] | has["texts"], "raw_drawing_signals").otherwise("insufficient_evidence")
    signals = {"spatial_layout": has["rooms"], "residential_room_labels": has["residential_rooms"], "openings": has["doors"], "horizontal_circulation": has["corridors"], "vertical_circulation": has["stairs"], "dimension_evidence": measured, "ocr_text": has["texts"]}
    doubts = {"unlabeled_rooms": has["unlabeled_rooms"], "rooms_without_openings": has["rooms"] & ~has["doors"], "rooms_without_corridor": has["rooms"] & ~has["corridors"], "uncertain_stairs": has["uncertain_stairs"], "no_dimension_evidence": ~measured, "label_review": has["review_texts"]}

    def names(flags: dict[str, Column]) -> Column:
        return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()]))

    return counts.select("run_id", kind.alias("drawing_type"), design.alias("likely_design"), level.alias("level"), names(signals).alias("signals"), names(doubts).alias("doubts"))


def region_candidates(pages: DataFrame, texts: DataFrame, lines: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Keys, kind, box and confidence of suggested regions, and up to 20 texts of each page outside its design region.

    pages: keys, width_pt, height_pt; texts: keys, text_idx, text, bbox; lines: keys, x0, y0, x1, y1. Every page has a
    design region: left of the title block, or all of it.
    """
    w, h = F.col("width_pt"), F.col("height_pt")
    size = pages.select(*keys, "width_pt", "height_pt")
    box = {c: F.col(f"bbox.{c}") for c in ("x0", "y0", "x1", "y1")}
    words = texts.join(size, keys).withColumn("cx", (box["x0"] + box["x1"]) / 2).withColumn("cy", (box["y0"] + box["y1"]) / 2).withColumn("low", F.lower("text"))
    right = F.col("cx") >= w * RIGHT

    def union(c: dict[str, Column], when: Column, tag: str) -> list[Column]:
        return [f(F.when(when, c[n])).alias(f"{tag}{n}") for f, n in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))]

    found = {k: _any(F.col("low"), v) for k, v in REGIONS.items()}
    per = [F.count_if(right).alias("n_right"), F.count_if(right & _any(F.col("low"), TITLE)).alias("n_title"), *union(box, right, "t_")]
    for kind, hit in found.items():
        per += [F.count_if(hit).alias(f"n_{kind}"), *union(box, hit, f"{kind}_")]
    stats = size.join(words.groupBy(*keys).agg(*per), keys, "left")
    edge = stats.withColumn("edge", F.greatest(w * RIGHT, F.coalesce(F.col("t_x0") - 30.0, w * RIGHT)))
    ends = {"x0": F.least("x0", "x1"), "y0": F.least("y0", "y1"), "x1": F.greatest("x0", "x1"), "y1": F.greatest("y0", "y1")}
    near = lines.join(edge.select(*keys, "edge"), keys).where((F.col("x0") + F.col("x1")) / 2 >= F.col("edge"))
    flat = F.abs(F.col("x1") - F.col("x0")) >= F.abs(F.col("y1") - F.col("y0"))
    near = near.groupBy(*keys).agg(F.count("*").alias("n_lines"), F.count_if(flat).alias("n_flat"), *union(ends, F.lit(True), "l_"))
    rows = edge.join(near, keys, "left").fillna(0, ["n_right", "n_title", "n_lines", "n_flat", *[f"n_{k}" for k in REGIONS]])
    grid = F.least("n_flat", F.col("n_lines") - F.col("n_flat"))
    titled = ~((F.col("n_title") < 2) & ((F.col("n_right") < 4) | (grid < 3)))

    def padded(a: str, b: str, pad: float) -> list[Column]:
        low = [F.greatest(F.lit(0.0), F.least(F.col(f"{a}{c}"), F.col(f"{b}{c}")) - pad) for c in ("x0", "y0")]
        high = [F.least(s, F.greatest(F.col(f"{a}{c}"), F.col(f"{b}{c}")) + pad) for c, s in (("x1", w), ("y1", h))]
        return [*low, *high]

    def region(kind: str, use: Column, at: list[Column], confidence: Column) -> Column:
        return F.when(use, F.struct(F.lit(kind).alias("kind"), *[c.alias(n) for c, n in zip(at, ("x0", "y0", "x1", "y1"))], confidence.alias("confidence")))

    title = padded("t_", "l_", TITLE_PAD)
    sure = F.least(F.lit(0.95), 0.42 + 0.08 * F.col("n_title") + 0.015 * F.col("n_lines") + 0.03 * F.least(grid, F.lit(6)))
    design_x1 = F.when(titled, F.greatest(F.lit(0.0), title[0] - TITLE_GAP)).otherwise(w)
    parts = [region("design_region", F.lit(True), [F.lit(0.0), F.lit(0.0), design_x1, h], F.when(titled, 0.82).otherwise(0.45)), region("title_block", titled, title, sure)]
    for kind in REGIONS:
        parts.append(region(kind, F.col(f"n_{kind}") > 0, padded(f"{kind}_", f"{kind}_", WORD_PAD), F.least(F.lit(0.9), 0.58 + 0.06 * F.col(f"n_{kind}"))))
    out = rows.select(*keys, F.inline(F.array_compact(F.array(*parts))))
    outside = words.join(rows.select(*keys, design_x1.alias("right")), keys).where(~(F.col("cx").between(0, F.col("right")) & F.col("cy").between(0, h)))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("text_idx"))
    return out, outside.withColumn("nth", nth).where(F.col("nth") <= EXCLUDED).select(*keys, "text_idx", "nth")
