"""Fuzzy line deduplication by MinHash, with DataFrame functions only.

A line's shingles are runs of up to nine characters. They begin at each of its
words, and at every further character of a word or blank run from where the last
shingle does not reach past its end, so that no character is outside all shingles
and a line without blanks has one at every character. They are hashed once; the
signature of a band is the three smallest hashes from the band's own point on,
around the circle of 64-bit values, so that two lines agree in a band about as
often as three draws from their union fall into the intersection. Lines that share
a band are compared with the smallest one in it by the exact Jaccard of their
shingle sets; linked lines are merged by distributed union-find. Then all lines
that share a band and are still in different components are compared (in crowded
bands by their rarest shingles, after central lines and some lines of the largest
component have been compared), the links of all rounds are merged, and the first
line of a component stays.

Equal lines are one node from the start, named by the 64-bit hash of the line, so
ids of documents may be any 64-bit number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planaudit.llm.common import bucketed, connected_components, free_name, materialize, merged_components

#: Blanks are listed, and a word is tried once only: the same matches as (?=(.{1,9}))(?:\S{1,8}+\s|\S{1,9}+\z|.), in less time.
SHINGLE = r"(?s)(?=(.{1,9}+))(?:[^ \t\n\x0B\f\r]{1,8}+(?:[ \t\n\x0B\f\r]|[^ \t\n\x0B\f\r]?\z)|.)"
BANDS, DEPTH = 6, 3
BLANKS = " \t\n\x0b\f\r"
LINES = 1 << 31
FEW, COUNTERS = 16, 1 << 18
#: How many lines of its largest component a rare shingle has compared with its other lines before all pairs across components.
HEADS = 4


def _buckets(spark: SparkSession) -> int:
    """As many as a shuffle has partitions, so that a join takes the buckets as they are."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _points() -> list[int]:
    """Where the bands begin: equal steps around the signed 64-bit circle."""
    return [-(1 << 63) + (2 * i + 1) * (1 << 64) // (2 * BANDS) for i in range(BANDS)]


def shingles(line: Column) -> Column:
    """Distinct hashes of a line's shingles, in ascending order."""
    return F.sort_array(F.array_distinct(F.transform(F.regexp_extract_all(F.lower(line), F.lit(SHINGLE), F.lit(1)), lambda x: F.xxhash64(x))))


def _signature(hashes: Column, places: Column, i: int) -> Column:
    """Hash of the smallest hashes from point i on, going round to the smallest of all; `places` is hashes and points in one order."""
    below = F.array_position(places, F.lit(_points()[i])).cast("int") - i
    return F.xxhash64(F.lit(i), F.slice(F.concat(hashes, F.slice(hashes, 1, DEPTH)), below, DEPTH))


def split_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line_no (from 0), line and its hash of every line that is not blank, of rows with an id."""
    lines = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line"))
    return lines.where(F.ltrim("line", F.lit(BLANKS)) != "").select("doc_id", "line_no", "line", F.xxhash64("line").alias("same"))


def _place(doc_id: Column, line_no: Column) -> Column:
    """One number in the order of doc_id and line_no; its kind keeps grouped minima in fixed memory."""
    return (doc_id.cast("decimal(20,0)") * F.lit(LINES).cast("decimal(10,0)") + line_no).cast("decimal(38,0)")


def _line_no(place: Column) -> Column:
    return F.pmod(place, F.lit(LINES).cast("decimal(38,0)")).cast("int")


def _doc_id(place: Column) -> Column:
    return ((place - _line_no(place)).cast("decimal(38,0)") / F.lit(LINES).cast("decimal(10,0)")).cast("long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets have the Jaccard."""
    looked_up = [sets.select(F.col("id").alias(c), F.col("h").alias(f"h{c}")).hint("shuffle_hash") for c in ("a", "b")]
    both = pairs.join(looked_up[0], "a").join(looked_up[1], "b")
    counted = both.select("a", "b", F.size("ha").alias("na"), F.size("hb").alias("nb"), F.size(F.array_intersect("ha", "hb")).alias("both"))
    return counted.where(f"100 * both >= {percent} * (na + nb - both)").select("a", "b")


def _crossed(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a > b) of one key and different components that may have the Jaccard.

    rows(key, id, n, of, at, low, p, big): `at` is the place of the key among the n
    values of the line, so that n - at + 1 of them can be shared at most if it is
    the first shared one; `low` says that the key may meet larger lines. `p` is all
    keys of the line: a pair comes from the first one that both have. Members of
    the component `big` of a key do not meet each other, which keeps the work to
    about the number of pairs across components.
    """
    one = rows.where("of <> big").select("key", *[F.col(c).alias(f"{c}1") for c in ("id", "n", "of", "at", "low", "p")])
    two = rows.select("key", "big", *[F.col(c).alias(f"{c}2") for c in ("id", "n", "of", "at", "low", "p")])
    once = "of1 <> of2 and (of2 = big or id1 > id2) and if(struct(n1, id1) < struct(n2, id2), low1, low2)"
    enough = f"{100 + percent} * (least(n1 - at1, n2 - at2) + 1) >= {percent} * (n1 + n2)"
    return one.join(two, "key").where(f"{once} and {enough} and key = array_intersect(p1, p2)[0]").select(F.greatest("id1", "id2").alias("a"), F.least("id1", "id2").alias("b"))


def _of_key(rows: DataFrame, key: str) -> DataFrame:
    """key, size, component with most members and number of pairs across components, of keys with such pairs."""
    by = rows.groupBy(key, "of").agg(F.count("*").cast("double").alias("k"))
    most = by.groupBy(key).agg(F.sum("k").alias("c"), F.max(F.struct("k", "of"))["of"].alias("big"), ((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))) / 2).alias("across"))
    return most.where("across > 0")


def _placed(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """rows(id, ...) with the component `of` of each line; a line without a link is its own."""
    return rows.join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("of", F.coalesce("component", "id")).drop("component")


def _prefixes(many: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """key, id, n, at, low, p and alone: the rarest shingles of the lines of crowded bands.

    In any order that is one for all sets, two sets with the Jaccard share one of the
    first n - ceil(percent * n / 100) + 1 of the larger and the first n -
    ceil(2 * percent * n / (100 + percent)) + 1 of the smaller (`low`). The order is by
    counters, each of which sums the lines that have a shingle of its class; there are
    COUNTERS of them, which every task reads. So what a whole family of lines shares
    comes last, and no shingle is joined with a count. `alone` is the number of a
    line's shingles here that no other line has.
    """
    # dealt by another hash than the join's, so that the lines of one group do not stay with the files they came from
    values = many.join(sets, "id").repartition(F.xxhash64("id")).select(F.explode("h").alias("key"))
    counts = values.groupBy(F.pmod("key", F.lit(COUNTERS)).alias("id")).agg(F.count("*").alias("df"))
    dense = values.sparkSession.range(COUNTERS).join(counts, "id", "left").select("id", F.coalesce("df", F.lit(0)).alias("df"))
    sketch = dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "df"))), lambda x: x["df"]).alias("counts"))
    # one row of COUNTERS numbers
    ranked = many.join(sets, "id").join(F.broadcast(sketch), F.lit(True))
    order = F.array_sort(F.transform("h", lambda x: F.struct(F.get("counts", F.pmod(x, F.lit(COUNTERS)).cast("int")).alias("df"), x.alias("key"))))
    first = ranked.select("id", "n", F.slice(order, F.lit(1), (F.col("n") + F.floor(F.lit(-percent) * F.col("n") / 100) + 1).cast("int")).alias("v"))
    rows = first.select("id", "n", F.size(F.filter("v", lambda x: x["df"] == 1)).alias("alone"), F.transform(F.filter("v", lambda x: x["df"] > 1), lambda x: x["key"]).alias("p"), F.posexplode("v").alias("at", "v")).where("v.df > 1")
    low = f"at < n + floor(-{2 * percent} * n / {100 + percent}) + 1"
    return materialize(rows.select(F.col("v.key").alias("key"), "id", "n", "alone", "p", (F.col("at") + 1).alias("at"), F.expr(low).alias("low")))


def _central_pairs(prefix: DataFrame, percent: int) -> DataFrame:
    """Of each rare shingle, all lines with the one that has the fewest shingles alone, as it is nearest to the others."""
    centre = prefix.groupBy("key").agg(F.min(F.struct("alone", F.col("id").alias("b"), F.col("n").alias("m"))).alias("x")).select("key", "x.b", "x.m")
    near = prefix.join(centre, "key").where(f"id <> b and 100 * least(n, m) >= {percent} * greatest(n, m)")
    return near.select(F.greatest("id", "b").alias("a"), F.least("id", "b").alias("b")).distinct()


def _head_pairs(rare: DataFrame, percent: int) -> DataFrame:
    """Of each rare shingle, the lines outside its largest component with the HEADS most central lines of it.

    A line that is linked to one of them is then in the component and meets no
    other line of it.
    """
    rows = rare.join(_of_key(rare, "key").select("key", "big"), "key")
    central = Window.partitionBy("key").orderBy("alone", "id")
    heads = rows.where("of = big").withColumn("rank", F.row_number().over(central)).where(f"rank <= {HEADS}").select("key", F.col("id").alias("b"), F.col("n").alias("m"))
    near = rows.where("of <> big").select("key", "id", "n").join(heads, "key").where(f"100 * least(n, m) >= {percent} * greatest(n, m)")
    return near.select(F.greatest("id", "b").alias("a"), F.least("id", "b").alias("b")).distinct()


def _linked(hits: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """node and component of the lines that share a band with a line they are like.

    First every line of a band is compared with the smallest one, and in bands that
    still hold many pairs across components with central lines and then with lines of
    the largest component; then every pair across components that may have the
    Jaccard.
    """
    tested: list[DataFrame] = []
    parts = None

    def compare(pairs: DataFrame, parts: DataFrame | None) -> DataFrame | None:
        fresh = materialize(pairs.join(reduce(DataFrame.unionByName, tested), ["a", "b"], "left_anti") if tested else pairs)
        if parts is not None and fresh.isEmpty():
            return parts
        tested.append(fresh)
        links = materialize(_verified(fresh, sets, percent))
        if parts is None:
            return connected_components(links)
        return parts if links.isEmpty() else merged_components(parts, links)

    sizes = hits.where("id = first").select("first", F.col("n").alias("m")).distinct()
    stars = hits.where("id <> first").select("id", "n", "first").distinct().join(sizes, "first")
    parts = compare(stars.where(f"100 * least(n, m) >= {percent} * greatest(n, m)").select(F.greatest("id", "first").alias("a"), F.least("id", "first").alias("b")), parts)
    placed = _placed(hits.select("band", "id", "n"), parts)
    mixed = materialize(placed.join(_of_key(placed, "band"), "band"))
    open_pairs = _crossed(mixed.where(f"across <= {FEW} * c").select(F.col("band").alias("key"), "id", "n", "of", F.lit(1).alias("at"), F.lit(True).alias("low"), F.array("band").alias("p"), "big"), percent)
    many = materialize(mixed.where(f"across > {FEW} * c").select("id", "n").distinct())
    if not many.isEmpty():
        prefix = _prefixes(many, sets, percent)
        parts = compare(_central_pairs(prefix, percent), parts)
        parts = compare(_head_pairs(_placed(prefix.drop("p"), parts), percent), parts)
        rare = _placed(prefix.drop("alone"), parts)
        open_pairs = open_pairs.unionByName(_crossed(rare.join(_of_key(rare, "key").select("key", "big"), "key"), percent))
    return compare(open_pairs.distinct(), parts)


def line_components(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line_no, same, keeper_doc_id, keeper_line_no and kept of every line that is not blank.

    Lines are parts between newlines. Equal lines always share a component; other
    lines do if 100 * |intersection| >= percent * |union| of their shingles (case
    ignored) and they share a band: six bands of three have 98.6 % of the pairs at
    0.8 and over 99.9 % at 0.9, and no pair in a band is left out. The line of the
    smallest doc_id, and in it the first, is kept. Blank lines are not lines here; a
    null or empty text has none. Rows with a null id are left out. Rows with an
    equal id come back one by one; an equal line at the same place in two of them is
    one line. Ids and numbers of lines may be any 64-bit and 31-bit integers. Long
    lines are hashed whole. Other columns are ignored, whatever their names. An
    empty table gives an empty result.
    """
    lines = split_lines(docs, id_col, text_col)
    placed = lines.select(F.col("same").alias("id"), "line", _place(F.col("doc_id"), F.col("line_no")).alias("place"))
    # each line is moved once, to the bucket of its hash; what is read by that hash later needs no other shuffle
    apart = placed.repartition(_buckets(docs.sparkSession), "id").groupBy("id", "line").agg(F.min("place").alias("place"), F.count("*").alias("c"))
    hashed = apart.withColumn("h", shingles(F.col("line")))
    # sort_array sorts numbers as such; array_sort would compare them one by one through an expression
    ordered = hashed.withColumn("places", F.sort_array(F.concat("h", F.array(*[F.lit(p) for p in _points()]))))
    classes = bucketed(ordered.select("id", "line", "place", "c", F.size("h").alias("n"), *[_signature(F.col("h"), F.col("places"), i).alias(f"b{i}") for i in range(BANDS)]), "id", _buckets(docs.sparkSession))
    # two lines alone in a band need no look at their sets if their sizes exclude the Jaccard; the join reads the same shuffle as the sizes
    members = classes.select("id", "n", F.explode(F.array(*[f"b{i}" for i in range(BANDS)])).alias("band")).repartition("band")
    shared = members.groupBy("band").agg(F.min("id").alias("first"), F.count("n").alias("c"), F.min("n").alias("low"), F.max("n").alias("high")).where(f"c > 2 or c = 2 and 100 * low >= {percent} * high").select("band", "first")
    # what is looked up has each key once, so it is hashed and the many rows need not be sorted
    hits = materialize(members.join(shared.hint("shuffle_hash"), "band").select("band", "id", "n", "first"))
    wanted = classes.select("id", "line").join(hits.select("id").distinct().hint("shuffle_hash"), "id", "left_semi")
    sets = materialize(wanted.select("id", shingles(F.col("line")).alias("h")))
    parts = _linked(hits, sets, percent)
    grouped = classes.select("id", "place").join(parts.withColumnRenamed("node", "id"), "id")
    first = grouped.groupBy("component").agg(F.min("place").alias("keeper"))
    merged = parts.join(first, "component").select(F.col("node").alias("same"), "keeper")
    repeated = classes.where("c > 1").join(parts, F.col("id") == F.col("node"), "left_anti").select(F.col("id").alias("same"), F.col("place").alias("keeper"))
    keepers = merged.unionByName(repeated).select("same", _doc_id(F.col("keeper")).alias("keeper_doc_id"), _line_no(F.col("keeper")).alias("keeper_line_no"))
    # lines that are alone in their component need no partner here
    placed = lines.drop("line").join(keepers.hint("shuffle_hash"), "same", "left")
    named = placed.withColumns({"keeper_doc_id": F.coalesce("keeper_doc_id", "doc_id"), "keeper_line_no": F.coalesce("keeper_line_no", "line_no")})
    return named.select("doc_id", "line_no", "same", "keeper_doc_id", "keeper_line_no", ((F.col("doc_id") == F.col("keeper_doc_id")) & (F.col("line_no") == F.col("keeper_line_no"))).alias("kept"))


def drop_repeated_lines(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every line removed that is not the kept one of its component.

    All rows and columns stay; a text of which no line is kept becomes empty, or
    keeps its blank lines. A null text and the text of a row with a null id stay
    as they are. Of rows with an equal id each loses its own lines.
    """
    place, lost, left = (free_name(docs, c) for c in ("_id", "_gone", "_left"))
    gone = line_components(docs, percent, id_col, text_col).where("not kept").groupBy(F.col("doc_id").alias(place)).agg(F.collect_set(F.struct("line_no", "same")).alias(lost))
    both = docs.join(gone, docs[id_col] == F.col(place), "left")
    text = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda x, i: ~F.array_contains(lost, F.struct(i.alias("line_no"), F.xxhash64(x).alias("same")))), "\n")
    both = both.withColumn(left, F.when(F.col(lost).isNull(), F.col(text_col)).otherwise(text))
    return both.select(*[F.col(left).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
