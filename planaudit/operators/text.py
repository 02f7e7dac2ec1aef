"""Pages and texts: classification, search, number audits."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planaudit.sources.shared import written

# Page types in order of precedence and their keywords.
PAGE_KEYWORDS = {
    "schedule": ["schedule", "door schedule", "room schedule", "table", "mark width height", "表"],
    "title": ["title", "title sheet", "project data", "revision", "sheet index", "封面"],
    "legend": ["legend", "symbol", "abbrev", "abbreviation", "notes", "图例"],
    "detail": ["detail", "enlarged", "大样", "详图"],
    "elevation": ["elevation", "section", "立面", "剖面"],
    "plan": ["plan", "floor plan", "first floor", "second floor", "bedroom", "living", "corridor", "room", "平面"],
}
# Label keywords in order, with the room label of each.
ROOM_LABELS = [("bedroom", "bedroom"), ("卧室", "bedroom"), ("bathroom", "bathroom"), ("卫生间", "bathroom"), ("living", "living"), ("客厅", "living"), ("kitchen", "kitchen"), ("厨房", "kitchen"), ("balcony", "balcony"), ("阳台", "balcony"), ("study", "study"), ("书房", "study"), ("dining", "dining"), ("餐厅", "dining"), ("kids", "kids"), ("儿童房", "kids")]
# Exact room aliases, and patterns of numbered bedrooms, opening sizes and lengths in feet and inches.
ROOM_ALIASES = {"卧室": "bedroom", "LIVING": "living", "客厅": "living", "DINING": "dining", "餐厅": "dining", "KITCHEN": "kitchen", "厨房": "kitchen", "BATH": "bath", "卫生间": "bath", "WALK-IN": "walk_in", "WIC": "walk_in", "CLOSET": "closet", "BALCONY": "balcony", "阳台": "balcony", "FOYER": "foyer", "COMMON": "common", "STUDY": "study", "书房": "study", "MECH": "mech", "CLT": "clt", "LIN": "linen", "LINEN": "linen"}
NUMBERED_ROOM = r"^BEDROOM(?:\s*#\d+)?$"
OPENING_SIZE = r"^(?:SLD)?\d{4}$"
FEET, LEAST_FEET = r"^(\d+)'-\d+\"$", 4
# BM25.
K1, B = 1.5, 0.75
#: Rows of (query, token) that are broadcast.
MAX_ASKED = 500_000
#: Postings that a query's rarest tokens read and documents scored first for each of its results; the part of a score that is left to common tokens; what scores may differ by rounding.
FIRST, TRIED, WEAK, SLACK = 200, 5, 0.4, 1e-6
# Patterns of tokens and numbers.
CLAUSE_ID = r"[A-Za-z]{2,4}\d+(?:[-.]\d+)+"
CJK_RUN = r"[一-鿿]+"
WORD = r"[A-Za-z0-9]+"
CITATION = r"GB\s*\d{4,5}(?:[\s\-－–]\d+)?(?:\.\d+){0,3}"
FRACTION = r"(\d+)\s*/\s*(\d+)"
NUMBER = r"\d+(?:\.\d+)?"
TABLE = r"表\s*\d+(?:\.\d+){0,3}"
LIST_MARKER = r"(?<![\d.])\d+[．）)](?=[\s一-鿿])"
PLACEHOLDER = r"\{[^}]+\}"
FLOORS = "一二三四五六七八九十"
WIDE_DIGITS = "０１２３４５６７８９"
# Number literals of an expression, and its quoted texts.
LITERAL = r"(?<![\w.])(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
QUOTED = r"'[^']*'|\"[^\"]*\""
# Reasons to keep all pages of a document, in order.
ROUTING = ["single_page_run", "classification_page_mismatch", "no_eligible_plan_page", "multiple_eligible_plan_pages", "unknown_or_low_confidence_non_plan_page"]
# Counters of components and their types.
COMPONENTS = {"rooms": "Room", "doors": "Door", "corridors": "Corridor", "stairs": "Stair", "dimensions": "Dimension"}


def classify_pages(pages: DataFrame, texts: str = "texts", keywords: dict[str, list[str]] = PAGE_KEYWORDS) -> DataFrame:
    """Page type, confidence, number of keywords and up to six texts as evidence.

    pages: texts (array, in order), n_lines, n_texts. The type with most keywords in
    the joined texts wins, the first in order on a tie. Without any, a page with many
    lines and few texts is a plan, else unknown. Evidence is the texts that hold a
    keyword of the type (the first three of all if none does by itself), or the first
    four texts of a page without keywords.
    """
    shown = F.filter(F.transform(F.coalesce(texts, F.array().cast("array<string>")), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    rows = pages.withColumn("_t", shown)
    low = F.lower(F.array_join("_t", " "))
    scores = [F.struct(reduce(lambda a, b: a + b, [low.contains(k.lower()).cast("int") for k in words]).alias("score"), F.lit(-i).alias("o"), F.lit(kind).alias("kind")) for i, (kind, words) in enumerate(keywords.items())]
    rows = rows.withColumn("_b", F.array_max(F.array(*scores)))
    hit, dense = F.col("_b.score") > 0, (F.col("n_lines") >= 10) & (F.col("n_texts") <= 8)
    kind = F.when(hit, F.col("_b.kind")).when(dense, "plan").otherwise("unknown")
    sure = F.when(hit, F.least(F.lit(0.92), 0.55 + 0.12 * F.col("_b.score"))).when(dense, 0.5).otherwise(0.2)

    def holding(words: list[str]) -> Column:
        return F.filter("_t", lambda x: reduce(lambda a, b: a | b, [F.lower(x).contains(k.lower()) for k in words]))

    found = reduce(lambda out, item: out.when(F.col("_b.kind") == item[0], holding(item[1])), keywords.items(), F.when(F.lit(False), F.col("_t")))
    evidence = F.when(hit, F.when(F.size(found) > 0, F.slice(found, 1, 6)).otherwise(F.slice("_t", 1, 3))).otherwise(F.slice("_t", 1, 4))
    return rows.withColumns({"page_type": kind, "confidence": sure, "n_keywords": F.col("_b.score"), "evidence": evidence}).drop("_b", "_t")


def route_documents(classified: DataFrame, pages: DataFrame, doc: str, least: float = 0.5) -> DataFrame:
    """A document narrows to one page only if exactly one page is a sure plan and all others are known and sure.

    classified and pages are told apart by (doc, page_index); reasons to stay with all
    pages are tried in order.
    """
    plan = (F.col("page_type") == "plan") & (F.col("confidence") >= least)
    given = classified.select(doc, "page_index", "page_type", "confidence", F.lit(True).alias("_c"))
    both = pages.select(doc, "page_index", F.lit(True).alias("_p")).join(given, [doc, "page_index"], "full")
    weak = F.col("_c") & ~plan & ((F.col("page_type") == "unknown") | (F.col("confidence") < least))
    rows = both.groupBy(doc).agg(F.count("_p").alias("n"), F.count_if(F.col("_p").isNull() | F.col("_c").isNull()).alias("apart"), F.count_if(plan).alias("plans"), F.count_if(weak).alias("weak"), F.min(F.when(plan, F.col("page_index"))).alias("page"))
    reason = F.when(F.col("n") <= 1, ROUTING[0]).when(F.col("apart") > 0, ROUTING[1]).when(F.col("plans") == 0, ROUTING[2]).when(F.col("plans") > 1, ROUTING[3]).when(F.col("weak") > 0, ROUTING[4])
    return rows.select(doc, reason.isNull().alias("narrowed"), F.when(reason.isNull(), F.col("page")).alias("page"), reason.alias("reason"))


def split_pages(classified: DataFrame, pages: DataFrame, components: DataFrame, least: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Sure plan pages with their number of components of each kind, and the skipped pages with a reason.

    pages(run_id, page_index) are those that hold primitives; components(run_id,
    page_index, entity_type).
    """
    keys = ["run_id", "page_index"]
    rows = classified.join(pages.select(*keys, F.lit(True).alias("_p")).distinct(), keys, "left")
    reason = F.when(F.col("_p").isNull(), "page missing from graph primitives").when(~F.coalesce((F.col("page_type") == "plan") & (F.col("confidence") >= least), F.lit(False)), "not a confident graph-eligible plan page")
    rows = rows.withColumn("reason", reason).drop("_p")
    counts = components.groupBy(*keys).agg(*[F.count_if(F.col("entity_type") == kind).alias(name) for name, kind in COMPONENTS.items()])
    kept = rows.where("reason is null").drop("reason").join(counts, keys, "left")
    return kept.withColumns({c: F.coalesce(c, F.lit(0)) for c in COMPONENTS}), rows.where("reason is not null")


@F.arrow_udf(T.StringType())
def _composed(texts: pa.Array) -> pa.Array:
    """NFKC of each text, null for those that are in that form."""
    return pa.array([None if t is None or unicodedata.is_normalized("NFKC", t) else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def fold_compatible(col: Column) -> Column:
    """NFKC: compatibility forms (full and half width, ligatures, squared units, roman numerals) to plain ones, composed. Only texts beyond ASCII leave the JVM."""
    return F.coalesce(_composed(F.when(col.rlike(r"[^\x00-\x7F]"), col)), col)


def tokenize(col: Column) -> Column:
    """T4: clause ids, CJK characters and pairs, and lower-cased words, in this order."""
    text = fold_compatible(col)
    none = F.array().cast("array<string>")
    # most texts have neither, and a search for one character is quicker than one for all runs
    ids = F.when(text.rlike(r"[A-Za-z]\d"), F.transform(F.regexp_extract_all(text, F.lit(CLAUSE_ID), F.lit(0)), lambda x: F.lower(x))).otherwise(none)
    runs = F.when(text.rlike("[一-鿿]"), F.regexp_extract_all(text, F.lit(CJK_RUN), F.lit(0))).otherwise(none)

    def pieces(run: Column) -> Column:
        at = F.sequence(F.lit(1), F.length(run))
        pairs = F.when(F.length(run) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.transform(at, lambda i: F.substring(run, i, F.lit(1))), pairs)

    words = F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda x: F.lower(x))
    return F.concat(ids, F.flatten(F.transform(runs, pieces)), words)


def _postings(docs: DataFrame, tokens: DataFrame) -> DataFrame:
    """token, doc_id, len and f of the tokens named, and one row for each document with a null token; texts are read once."""
    words = docs.select("doc_id", tokenize(F.coalesce("text", F.lit(""))).alias("t"))
    none = F.array(F.lit(None).cast("string"))
    words = words.select("doc_id", F.size("t").alias("len"), F.explode(F.concat(none, "t")).alias("token"))
    named = words.join(tokens.withColumn("_asked", F.lit(True)), "token", "left").where("_asked or token is null")
    return named.groupBy("token", "doc_id", "len").agg(F.count("*").alias("f"))


def bm25_search(docs: DataFrame, queries: DataFrame, k: int, candidates: DataFrame | None = None) -> DataFrame:
    """query_id, rank, doc_id and score > 0 of the best k; statistics cover all docs, candidates only restrict.

    docs(doc_id, text), queries(query_id, text). A token given twice in a query counts twice; ties go to the smaller id.

    Postings are written once. A query's rarest tokens give a first score to the documents that hold them; the best of
    these are scored in full, and the k-th of these scores is one that a document must reach. The query's common tokens, whose
    largest weights add up to less than a part of that, cannot lift a document there that lacks the rest: documents are
    scored by the other tokens, and the common ones are looked up for those few that may still get there. While the queries have at most
    MAX_ASKED different (query, token) rows, these and their statistics are broadcast; beyond that joins are shuffled.
    """
    asked = written(queries.select("query_id", F.explode(tokenize(F.col("text"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qf")))
    small = asked.count() <= MAX_ASKED

    def sent(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    postings = written(_postings(docs, sent(asked.select("token").distinct())))
    stats = postings.where("token is null").agg(F.sum("f").alias("n"), (F.sum(F.col("len") * F.col("f")) / F.sum("f")).alias("mean"))
    held = postings.where("token is not null")
    df = held.groupBy("token").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    weight = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    weighted = held.join(sent(df), "token").join(F.broadcast(stats), F.lit(True)).select("token", "doc_id", weight.alias("w"))
    if candidates is not None:
        weighted = weighted.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")
    weighted = written(weighted)
    known = weighted.groupBy("token").agg(F.count("*").alias("df"), F.max("w").alias("most"))
    terms = asked.join(sent(known), "token").select("query_id", "token", "qf", "df", (F.col("most") * F.col("qf")).alias("most"))

    def scored(chosen: DataFrame) -> DataFrame:
        return weighted.join(sent(chosen.select("query_id", "token", "qf")), "token").groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * F.col("qf")).alias("score"))

    def looked_up(pairs: DataFrame, chosen: DataFrame) -> DataFrame:
        rows = pairs.select("query_id", "doc_id").join(sent(chosen.select("query_id", "token", "qf")), "query_id").join(weighted, ["doc_id", "token"])
        return rows.select("query_id", "doc_id", (F.col("w") * F.col("qf")).alias("score"))

    per_query = Window.partitionBy("query_id")
    rarest = per_query.orderBy("df", "token").rowsBetween(Window.unboundedPreceding, -1)
    rare = terms.withColumn("read", F.coalesce(F.sum("df").over(rarest), F.lit(0))).where(F.col("read") < FIRST * k)
    tried = scored(rare).withColumn("at", F.row_number().over(per_query.orderBy(F.desc("score"), "doc_id"))).where(F.col("at") <= TRIED * k)
    reached = looked_up(tried.select("query_id", "doc_id"), terms).groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))
    reached = reached.withColumn("at", F.row_number().over(per_query.orderBy(F.desc("score")))).where(F.col("at") == k)
    bound = reached.select("query_id", (F.col("score") - SLACK).alias("least"))
    weakest = per_query.orderBy("most", "token").rowsBetween(Window.unboundedPreceding, 0)
    terms = written(terms.join(bound, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0))).withColumn("below", F.sum("most").over(weakest)))
    weak = F.col("below") < WEAK * F.col("least")
    lift = terms.where(weak).groupBy("query_id").agg(F.max("below").alias("lift"))
    least = terms.groupBy("query_id").agg(F.first("least").alias("least"))
    strong = scored(terms.where(~weak)).join(sent(least), "query_id").join(sent(lift), "query_id", "left")
    strong = written(strong.where(F.col("score") + F.coalesce("lift", F.lit(0.0)) >= F.col("least")).select("query_id", "doc_id", "score"))
    parts = strong.unionByName(looked_up(strong, terms.where(weak)))
    scores = parts.groupBy("query_id", "doc_id").agg(F.sum("score").alias("score")).where("score > 0")
    best = per_query.orderBy(F.desc(F.round("score", 9)), "doc_id")
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def numbers(col: Column, mode: str) -> Column:
    """Distinct numbers of a text.

    expression: the number literals of a rule; names and quoted texts have none.
    template: plain numbers, without placeholders, citations and table references; mm
    and cm also as m. clause: the same, with fractions as their quotient and without
    list markers, and the number of "n floors" in words.
    """
    text = F.translate(col, WIDE_DIGITS, "0123456789")
    if mode == "expression":
        bare = F.regexp_replace(text, QUOTED, " ")
        return F.array_distinct(F.transform(F.regexp_extract_all(bare, F.lit(LITERAL), F.lit(0)), lambda x: x.cast("double")))
    if mode not in ("template", "clause"):
        raise ValueError(f"no such mode: {mode}")
    clean = F.regexp_replace(text, PLACEHOLDER, " ") if mode == "template" else F.regexp_replace(text, FRACTION, " ")
    clean = F.regexp_replace(F.regexp_replace(clean, CITATION, " "), TABLE, " ")
    clean = F.regexp_replace(clean, LIST_MARKER, " ") if mode == "clause" else clean
    scanned = clean if mode == "template" else text

    def scaled(unit: str, by: float) -> Column:
        return F.transform(F.regexp_extract_all(scanned, F.lit(rf"({NUMBER})\s*{unit}(?![A-Za-z])"), F.lit(1)), lambda x: x.cast("double") / by)

    found = [F.transform(F.regexp_extract_all(clean, F.lit(NUMBER), F.lit(0)), lambda x: x.cast("double")), scaled("mm", 1000.0), scaled("cm", 100.0)]
    if mode == "clause":
        quotients = F.transform(F.regexp_extract_all(text, F.lit(FRACTION), F.lit(0)), lambda x: F.try_divide(F.trim(F.split(x, "/")[0]).cast("double"), F.trim(F.split(x, "/")[1]).cast("double")))
        floors = F.transform(F.regexp_extract_all(text, F.lit(f"([{FLOORS}])层"), F.lit(1)), lambda x: F.instr(F.lit(FLOORS), x).cast("double"))
        found += [F.array_compact(quotients), floors]
    return F.array_distinct(F.coalesce(F.concat(*found), F.array().cast("array<double>")))


def fidelity_findings(rules: DataFrame, clauses: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Numbers of a rule's expression that none of its clauses has (error), and of its template in neither (warning).

    clause_ids names the rule's known clauses; a rule without one has no finding.
    """
    links = rules.select("rule_id", F.posexplode("source_clause_ids").alias("at", "clause_id")).join(clauses.select("clause_id", numbers(F.col("clause_text"), "clause").alias("c")), "clause_id")
    by = links.groupBy("rule_id").agg(F.flatten(F.collect_list("c")).alias("c"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "clause_id"))), lambda x: x["clause_id"]), ",").alias("clause_ids"))
    rows = rules.join(by, "rule_id").withColumn("e", numbers(F.col("logic_expression"), "expression")).withColumn("m", numbers(F.col("output_template"), "template"))

    def absent(xs: str, *known: str) -> Column:
        have = F.concat(*known) if len(known) > 1 else F.col(known[0])
        return F.filter(xs, lambda x: (x != 0) & ~F.exists(have, lambda y: F.abs(x - y) < tol))

    kinds = [("error", "numeric-drift-expression", absent("e", "c")), ("warning", "numeric-drift-template", absent("m", "c", "e"))]
    found = rows.select("rule_id", "clause_ids", F.explode(F.array(*[F.struct(F.lit(s).alias("severity"), F.lit(k).alias("kind"), v.alias("v")) for s, k, v in kinds])).alias("f"))
    return found.select("rule_id", "clause_ids", "f.severity", "f.kind", F.explode("f.v").alias("number"))


def clause_coverage(rules: DataFrame, clauses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Whole percent of clauses that a rule cites, and the clauses that none cites."""
    cited = rules.select(F.explode("source_clause_ids").alias("clause_id")).distinct()
    rows = clauses.select("clause_id").join(cited.withColumn("c", F.lit(1)), "clause_id", "left")
    share = rows.agg(F.count("*").alias("n_clauses"), F.count("c").alias("n_cited")).withColumn("percent", F.expr("cast(try_divide(100 * n_cited, n_clauses) as int)"))
    return share, rows.where("c is null").select("clause_id")


def normalize_labels(col: Column) -> Column:
    """The room label of the first keyword that a text contains, else null."""
    out = F.lit(None).cast("string")
    for key, label in reversed(ROOM_LABELS):
        out = F.when(F.lower(col).contains(key), label).otherwise(out)
    return out


def _clean_label(col: Column) -> Column:
    return F.btrim(F.regexp_replace(F.btrim(F.upper(col), F.lit(" \t\n\r\f\u000b")), r"\s+", " "), F.lit(" ."))


def room_kind(col: Column) -> Column:
    """The kind of room that a text names exactly, else null."""
    label = _clean_label(col)
    named = F.element_at(F.create_map(*[F.lit(x) for pair in ROOM_ALIASES.items() for x in pair]), label)
    return F.when(label.rlike(NUMBERED_ROOM), "bedroom").otherwise(named)


def opening_size(col: Column) -> Column:
    """A text that is the size code of an opening, cleaned, else null."""
    label = _clean_label(col)
    return F.when(label.rlike(OPENING_SIZE), label)


def major_dimension(col: Column) -> Column:
    """A text that is a length of at least four feet, else null."""
    label = F.btrim(col, F.lit(" \t\n\r\f\u000b"))
    feet = F.regexp_extract(label, FEET, 1)
    return F.when(label.rlike(FEET) & (feet.cast("decimal(38,0)") >= LEAST_FEET), label)


def text_inventory(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Section, key, number and first place of the room kinds, opening sizes and major dimensions among texts."""
    sections = {"room_label_counts": room_kind, "door_or_opening_size_label_counts": opening_size, "major_dimension_texts": major_dimension}
    found = F.array(*[F.struct(F.lit(name).alias("section"), f(F.col("text")).alias("key")) for name, f in sections.items()])
    rows = texts.select(*keys, "text_idx", F.inline(found)).where("key is not null")
    return rows.groupBy(*keys, "section", "key").agg(F.count("*").alias("n"), F.min("text_idx").alias("first_at"))


def noise_flags(counts: DataFrame, most: int = 50) -> DataFrame:
    """counts(rooms, doors, corridors) with the signs of a noisy recognition."""
    flags = F.array_compact(F.array(F.when(F.col("rooms") > most, F.lit("many_rooms")), F.when(F.col("doors") > most, F.lit("many_doors")), F.when((F.col("rooms") > 0) & (F.col("corridors") == 0), F.lit("rooms_without_corridor"))))
    return counts.withColumn("flags", F.array_join(flags, ","))


def run_benchmark(actual: DataFrame, expected: DataFrame, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every check of expected with its outcome, and per case score and pass.

    actual(case_id, name, value, text, members, page_values) has what a run gave;
    expected(case_id, name, op, exact, least, most, wanted, wanted_all) what it should:

    - count: value (0 if missing) fits exact, least and most, as far as they are given;
    - each_count: so do the values of all pages, of which there is at least one;
    - text: text is `wanted`; contains: text contains it;
    - member: members has `wanted`; members: it has all of wanted_all.

    cases(case_id, min_score): a case passes if all checks do and its share of passed
    checks (1 without checks, to 4 places) reaches min_score (1 if null).
    """
    both = expected.join(actual, ["case_id", "name"], "left")

    def fits(x: Column) -> Column:
        return F.coalesce(x == F.col("exact"), F.lit(True)) & F.coalesce(x >= F.col("least"), F.lit(True)) & F.coalesce(x <= F.col("most"), F.lit(True))

    own = F.coalesce("members", F.array().cast("array<string>"))
    outcomes = {
        "count": fits(F.coalesce("value", F.lit(0))),
        "each_count": (F.size(F.coalesce("page_values", F.array().cast("array<bigint>"))) > 0) & F.forall("page_values", fits),
        "text": F.col("text").eqNullSafe(F.col("wanted")),
        "contains": F.coalesce("text", F.lit("")).contains(F.coalesce("wanted", F.lit(""))),
        "member": F.array_contains(own, F.col("wanted")),
        "members": F.size(F.array_except("wanted_all", own)) == 0,
    }
    ok = reduce(lambda out, item: out.when(F.col("op") == item[0], item[1]), outcomes.items(), F.when(F.lit(False), F.lit(False)))
    checks = both.withColumn("ok", F.coalesce(ok, F.lit(False)))
    sums = checks.groupBy("case_id").agg(F.count("*").alias("n_checks"), F.count_if("ok").alias("n_ok"))
    rows = cases.select("case_id", "min_score").join(sums, "case_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_checks", "n_ok")})
    score = F.coalesce(F.try_divide("n_ok", "n_checks"), F.lit(1.0))
    passed = (score >= F.coalesce("min_score", F.lit(1.0))) & (F.col("n_ok") == F.col("n_checks"))
    return checks, rows.select("case_id", "n_checks", F.round(score, 4).alias("score"), passed.alias("passed"))


def suite_rollup(cases: DataFrame, manifest: DataFrame) -> DataFrame:
    """manifest(case_id, state) by outcome; a known gap that passes counts as a failure, a case without result is pending."""
    both = manifest.join(cases.select("case_id", "passed"), "case_id", "left")
    outcome = F.when(F.col("passed").isNull(), "pending").when(F.col("state") == "known_gap", F.when(F.col("passed"), "unexpected_pass").otherwise("known_gap")).when(F.col("passed"), "pass").otherwise("fail")
    return both.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))
