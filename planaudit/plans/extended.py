"""Registered queries of corridors, openings, drafts, diagnostics and packages, each with its oracle in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planaudit.operators import corridors, drafting, openings, packages, text
from planaudit.operators import geometry as geo
from planaudit.plans.harness import oracle, table, view

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(name: str, sql: str, *views: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[name] = f
        _oracles[name] = oracle(sql, *views) if views else sql
        return f

    return add


def _ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])


# corridors

_FLAT = "(SELECT l_linenumber AS page_index, floor(l_extendedprice % 500) * 8.0E0 AS a, floor(l_extendedprice % 500) * 8.0E0 + l_quantity * 8 AS b, l_suppkey * 2.0E0 AS yc FROM lineitem)"
_CHORDS = f"""RECURSIVE h AS {_FLAT}, ys AS (SELECT DISTINCT page_index, yc FROM h),
    lv AS (SELECT page_index, min(yc) AS y FROM ys GROUP BY 1 UNION ALL SELECT lv.page_index, min(ys.yc) FROM lv JOIN ys ON ys.page_index = lv.page_index AND ys.yc > lv.y + 3 GROUP BY lv.page_index, lv.y),
    flat AS (SELECT ys.page_index, yc, max(y) AS y FROM ys JOIN lv ON lv.page_index = ys.page_index AND lv.y <= ys.yc GROUP BY 1, 2),
    i AS (SELECT page_index, y, a, b, CASE WHEN a <= max(b) OVER (PARTITION BY page_index, y ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM h JOIN flat USING (page_index, yc)),
    n AS (SELECT *, sum(fresh) OVER (PARTITION BY page_index, y ORDER BY a, b) AS island FROM i),
    m AS (SELECT page_index, y, island, min(a) AS a, max(b) AS b FROM n GROUP BY 1, 2, 3),
    chord AS (SELECT page_index, y, min(a) AS x_min, max(b) AS x_max, max(b) - min(a) AS span FROM m GROUP BY 1, 2 HAVING max(b) - min(a) >= 2000 AND sum(b - a) >= 0.5 * (max(b) - min(a)))"""
_BANDS = """room AS (SELECT p_partkey AS space_id, p_partkey % 7 + 1 AS page_index, (p_partkey % 37) * 100.0E0 AS x0, (p_partkey % 23) * 9.0E0 AS y0, (p_partkey % 37) * 100.0E0 + p_size * 40.0E0 AS x1, (p_partkey % 23) * 9.0E0 + (p_partkey % 9 + 1) * 10.0E0 AS y1 FROM part),
    pair AS (SELECT l.page_index, greatest(l.x_min, u.x_min) AS x0, least(l.x_max, u.x_max) AS x1, l.y AS y_lo, u.y AS y_hi FROM chord l JOIN chord u ON u.page_index = l.page_index AND u.y - l.y BETWEEN 8 AND 12
      WHERE least(l.x_max, u.x_max) - greatest(l.x_min, u.x_min) > 0 AND least(l.x_max, u.x_max) - greatest(l.x_min, u.x_min) >= 0.5 * greatest(l.span, u.span)),
    host AS (SELECT p.*, r.space_id, r.y0, r.y1, row_number() OVER (PARTITION BY p.page_index, p.x0, p.x1, p.y_lo, p.y_hi ORDER BY r.space_id) AS nth FROM pair p
      JOIN room r ON r.page_index = p.page_index AND (p.x0 + p.x1) / 2 > r.x0 AND (p.x0 + p.x1) / 2 < r.x1 AND (p.y_lo + p.y_hi) / 2 > r.y0 AND (p.y_lo + p.y_hi) / 2 < r.y1),
    band AS (SELECT page_index, x0, x1, y_lo, y_hi, space_id AS host_id FROM host WHERE nth = 1 AND y_lo - y0 >= 5 AND y1 - y_hi >= 5)"""
_WALL = "wall AS (SELECT l_linenumber AS page_index, l_suppkey * 40.0E0 AS wx, floor(l_extendedprice % 200) AS w0, floor(l_extendedprice % 200) + l_quantity / 10.0E0 AS w1 FROM lineitem)"
_UNCROSSED = "SELECT * FROM band WHERE NOT EXISTS (SELECT 1 FROM wall WHERE wall.page_index = band.page_index AND wx > x0 + 20 AND wx < x1 - 20 AND least(w1, y_hi) - greatest(w0, y_lo) >= 0.6 * (y_hi - y_lo))"


def _flat(s: SparkSession, d: str) -> DataFrame:
    a, y = F.floor(F.col("l_extendedprice") % 500) * 8.0, F.col("l_suppkey") * 2.0
    return table(s, d, "lineitem").select(F.col("l_linenumber").alias("page_index"), a.alias("x0"), y.alias("y0"), (a + F.col("l_quantity") * 8).cast("double").alias("x1"), y.alias("y1"))


def _chords(s: SparkSession, d: str) -> DataFrame:
    extents = table(s, d, "lineitem").select(F.col("l_linenumber").alias("page_index"), F.lit(0.0).alias("lo"), F.lit(4000.0).alias("hi")).distinct()
    return corridors.chords(_flat(s, d), extents, ["page_index"])


def _bands(s: SparkSession, d: str) -> DataFrame:
    x0, y0 = (F.col("p_partkey") % 37) * 100.0, (F.col("p_partkey") % 23) * 9.0
    rooms = table(s, d, "part").select((F.col("p_partkey") % 7 + 1).alias("page_index"), F.col("p_partkey").alias("space_id"), F.col("p_partkey").alias("space_idx"), _ring(x0, y0, x0 + F.col("p_size") * 40.0, y0 + (F.col("p_partkey") % 9 + 1) * 10.0).alias("polygon"))
    return corridors.band_candidates(_chords(s, d), rooms, ["page_index"], (8.0, 12.0), 5.0)


def _open_bands(s: SparkSession, d: str) -> DataFrame:
    x, y = F.col("l_suppkey") * 40.0, F.floor(F.col("l_extendedprice") % 200)
    walls = table(s, d, "lineitem").select(F.col("l_linenumber").alias("page_index"), x.alias("x0"), y.alias("y0"), x.alias("x1"), (y + F.col("l_quantity") / 10.0).alias("y1"), F.lit("v").alias("axis"))
    return corridors.exclude_crossed(_bands(s, d), walls, ["page_index"])


query("g5_chords", f"WITH {_CHORDS} SELECT * FROM chord")(_chords)
query("g6_bands", f"WITH {_CHORDS}, {_BANDS} SELECT * FROM band")(_bands)
query("g7_uncrossed", f"WITH {_CHORDS}, {_BANDS}, {_WALL} {_UNCROSSED}")(_open_bands)
query("g7_corridor_bands", f"WITH {_CHORDS}, {_BANDS}, {_WALL}, u AS ({_UNCROSSED}) SELECT page_index, host_id, x0, x1, y_lo, y_hi FROM (SELECT *, row_number() OVER (PARTITION BY page_index, host_id ORDER BY y_lo, y_hi, x0, x1) AS nth FROM u) WHERE nth = 1")(
    lambda s, d: corridors.corridor_bands(_open_bands(s, d), ["page_index"])
)

# openings

_SIDES = """, bridge AS (SELECT space_id AS bridge_id, page_index, x0 + (x1 - x0) / 3 AS bx0, x1 - (x1 - x0) / 3 AS bx1, y1 AS c FROM v_box),
    probe AS (SELECT *, unnest([-1, 1]) AS side FROM bridge),
    seen AS (SELECT p.page_index, p.bridge_id, p.side, b.space_id, CASE WHEN b.space_id % 5 = 0 THEN 2 WHEN b.space_id % 5 = 1 THEN 1 ELSE 0 END AS rank,
      CASE WHEN c IN (b.y0, b.y1) THEN greatest(least(bx1, b.x1 + 0.5) - greatest(bx0, b.x0 - 0.5), 0)
           ELSE greatest(least(bx1, b.x0 + 0.5) - greatest(bx0, b.x0 - 0.5), 0) + greatest(least(bx1, b.x1 + 0.5) - greatest(bx0, b.x1 - 0.5), 0) END AS shared, bx1 - bx0 AS len
      FROM probe p JOIN v_box b ON b.page_index = p.page_index AND (bx0 + bx1) / 2 BETWEEN b.x0 AND b.x1 AND c + side * 0.5 BETWEEN b.y0 AND b.y1),
    best AS (SELECT *, row_number() OVER (PARTITION BY page_index, bridge_id, side ORDER BY rank, space_id) AS nth FROM seen WHERE shared >= 0.5 * len),
    sided AS (SELECT p.page_index, p.bridge_id, p.side, CASE WHEN rank IS NULL THEN 'exterior' WHEN rank = 2 THEN 'filtered' ELSE 'surviving' END AS kind, CASE WHEN rank < 2 THEN space_id END AS space_id
      FROM probe p LEFT JOIN best b ON b.nth = 1 AND b.page_index = p.page_index AND b.bridge_id = p.bridge_id AND b.side = p.side)"""


def _bridges(s: SparkSession, d: str) -> DataFrame:
    third = (F.col("x1") - F.col("x0")) / 3
    return view(s, d, "v_box").select("page_index", F.col("space_id").alias("bridge_id"), (F.col("x0") + third).alias("x0"), F.col("y1").alias("y0"), (F.col("x1") - third).alias("x1"), "y1")


def _sides(s: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("space_id") % 5 == 0, "filtered").when(F.col("space_id") % 5 == 1, "corridor").otherwise("room")
    spaces = view(s, d, "v_box").select("page_index", "space_id", F.col("space_id").alias("space_idx"), kind.alias("kind"), _ring(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]).alias("polygon"))
    return openings.classify_sides(_bridges(s, d), spaces, ["page_index"])


def _turned(points: list[tuple[Column, Column]]) -> Column:
    """Points of a plan that stands at an angle to its sheet."""
    return F.array(*[F.struct((0.6 * x - 0.8 * y).alias("x"), (0.8 * x + 0.6 * y).alias("y")) for x, y in points])


@query(
    "g11_oblique",
    """WITH r AS (SELECT p_partkey AS k, p_partkey % 20 AS page_index, p_partkey // 20 % 10 AS col, p_partkey % 3 = 0 AS ell, p_size FROM part),
    b AS (SELECT page_index, k * 2 AS bridge_id, unnest([-1, 1]) AS side, k, k + 20 AS beyond, p_size % 3 < 2 AS beside, col FROM r),
    t AS (SELECT page_index, k * 2 + 1 AS bridge_id, unnest([-1, 1]) AS side, k, NOT ell OR p_size % 30 + 2.3 <= 24 AS beside FROM r),
    s AS (SELECT b.page_index, bridge_id, side, CASE WHEN beside AND side = 1 THEN b.k WHEN beside AND b.col < 9 THEN n.k END AS held FROM b LEFT JOIN r n ON n.k = beyond
    UNION ALL SELECT page_index, bridge_id, side, CASE WHEN beside AND side = -1 THEN k END FROM t)
    SELECT page_index, bridge_id, side, CASE WHEN held IS NULL THEN 'exterior' WHEN held % 5 = 0 THEN 'filtered' ELSE 'surviving' END AS kind, CASE WHEN held % 5 <> 0 THEN held END AS space_id FROM s""",
)
def oblique(s: SparkSession, d: str) -> DataFrame:
    """Rooms of 40 by 30, every third L-shaped, in rows that stand at an angle; a gap in the wall to the right and one in the top wall of each."""
    key, size = F.col("p_partkey"), F.col("p_size")
    place = F.floor(key / 20)
    x, y = place % 10 * 40.0, F.floor(place / 10) * 40.0
    rows = table(s, d, "part").select((key % 20).alias("page_index"), key.alias("k"), x.alias("x"), y.alias("y"), "p_size")
    x, y = F.col("x"), F.col("y")
    full = _turned([(x, y), (x + 40, y), (x + 40, y + 30), (x, y + 30)])
    ell = _turned([(x, y), (x + 40, y), (x + 40, y + 15), (x + 22, y + 15), (x + 22, y + 30), (x, y + 30)])
    kind = F.when(F.col("k") % 5 == 0, "filtered").when(F.col("k") % 5 == 1, "corridor").otherwise("room")
    spaces = rows.select("page_index", F.col("k").alias("space_id"), F.col("k").alias("space_idx"), kind.alias("kind"), F.when(F.col("k") % 3 == 0, ell).otherwise(full).alias("polygon"))
    wall = x + 40 + F.element_at(F.lit([0.0, 0.3, 0.7]), (size % 3 + 1).cast("int"))
    gaps = [(F.col("k") * 2, _turned([(wall, y + 4), (wall, y + 10 + size % 5 * 2)])), (F.col("k") * 2 + 1, _turned([(x + 10, y + 30), (x + 12.3 + size % 30, y + 30)]))]
    parts = [rows.select("page_index", at.alias("bridge_id"), *[ends[i][c].alias(f"{c}{i}") for i in (0, 1) for c in ("x", "y")]) for at, ends in gaps]
    return openings.classify_sides(parts[0].unionByName(parts[1]), spaces, ["page_index"])


query("g11_sides", _SIDES + " SELECT * FROM sided", "v_box")(_sides)
query(
    "g12_openings",
    _SIDES
    + """, two AS (SELECT page_index, bridge_id, max(kind) FILTER (WHERE side = -1) AS ak, max(kind) FILTER (WHERE side = 1) AS bk, max(space_id) FILTER (WHERE side = -1) AS a, max(space_id) FILTER (WHERE side = 1) AS b FROM sided GROUP BY 1, 2)
    SELECT page_index, bridge_id, round((bx1 - bx0) / 50, 6) AS width_m, round(c - (bx1 - bx0) / 2, 6) AS y0, a, b, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 0.85E0 ELSE 0.5E0 END AS confidence
    FROM two JOIN bridge USING (page_index, bridge_id) WHERE 'filtered' NOT IN (ak, bk) AND 'surviving' IN (ak, bk)""",
    "v_box",
)(lambda s, d: openings.assemble_openings(_bridges(s, d), _sides(s, d), ["page_index"], 1.0).select("page_index", "bridge_id", F.round("width_m", 6).alias("width_m"), F.round("bbox.y0", 6).alias("y0"), "connects.a", "connects.b", "confidence"))


@query(
    "g13_bind_dimensions",
    """WITH t AS (SELECT event_id AS text_idx, event_id % 20 AS page, event_id % 3 AS k, CASE WHEN event_id % 300 >= 100 THEN (event_id % 300) / 1000.0E0 ELSE (event_id % 300) * 1.0E0 END AS v, event_id % 997 AS x, event_id % 499 AS y FROM events),
    p AS (SELECT p_partkey AS target_id, p_partkey % 20 AS page, CASE WHEN p_size % 2 = 0 THEN 'corridor' ELSE 'door' END AS kind, p_partkey % 97 * 10 AS tx, p_partkey % 53 * 9 AS ty FROM part),
    n AS (SELECT t.*, p.*, row_number() OVER (PARTITION BY text_idx ORDER BY (x - tx) * (x - tx) + (y - ty) * (y - ty), kind, target_id) AS nth FROM t JOIN p ON p.page = t.page
      WHERE (x - tx) * (x - tx) + (y - ty) * (y - ty) < 400 AND CASE WHEN kind = 'corridor' THEN k <> 0 ELSE k <> 1 END)
    SELECT CAST(page AS BIGINT) AS page_index, kind, target_id, arg_max(v, text_idx) AS value_m, count(*) AS n_texts FROM n WHERE nth = 1 GROUP BY 1, 2, 3""",
)
def bind(s: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 3
    said = F.concat(F.when(k == 0, "Door ").when(k == 1, "corridor ").otherwise("w "), (F.col("event_id") % 300).cast("string"))
    texts = table(s, d, "events").select((F.col("event_id") % 20).alias("page_index"), F.col("event_id").alias("text_idx"), said.alias("text"), (F.col("event_id") % 997).cast("double").alias("x"), (F.col("event_id") % 499).cast("double").alias("y"))
    targets = table(s, d, "part").select((F.col("p_partkey") % 20).alias("page_index"), F.when(F.col("p_size") % 2 == 0, "corridor").otherwise("door").alias("kind"), F.col("p_partkey").alias("target_id"), (F.col("p_partkey") % 97 * 10.0).alias("x"), (F.col("p_partkey") % 53 * 9.0).alias("y"))
    return geo.bind_dimensions(texts, targets, ["page_index"], 20.0)


@query(
    "g15_snap_endpoints",
    f"""WITH h AS {_FLAT}, g AS (SELECT DISTINCT page_index, a, b, yc FROM h), v AS (SELECT o_orderkey % 7 + 1 AS page_index, o_orderkey % 300 * 17.0E0 AS vx, o_custkey % 100 * 1.0E0 AS v0, o_custkey % 100 + 50.0E0 AS v1 FROM orders),
    m AS (SELECT g.page_index, a, b, yc, arg_min(vx, abs(vx - a) * 100000 + vx) FILTER (WHERE abs(vx - a) <= 4) AS l, arg_min(vx, abs(vx - b) * 100000 + vx) FILTER (WHERE abs(vx - b) <= 4) AS r
      FROM g JOIN v ON v.page_index = g.page_index AND yc BETWEEN v0 AND v1 AND (abs(vx - a) <= 4 OR abs(vx - b) <= 4) GROUP BY 1, 2, 3, 4)
    SELECT h.page_index, h.yc AS coord, coalesce(l, h.a) AS lo, coalesce(r, h.b) AS hi FROM h LEFT JOIN m USING (page_index, a, b, yc)""",
)
def snap(s: SparkSession, d: str) -> DataFrame:
    x, y = F.col("o_orderkey") % 300 * 17.0, (F.col("o_custkey") % 100).cast("double")
    v = table(s, d, "orders").select((F.col("o_orderkey") % 7 + 1).cast("int").alias("page_index"), x.alias("x0"), y.alias("y0"), x.alias("x1"), (y + 50.0).alias("y1"), F.lit("v").alias("axis"))
    h = _flat(s, d).select(F.col("page_index").cast("int").alias("page_index"), "x0", "y0", "x1", "y1", F.lit("h").alias("axis"))
    return geo.snap_endpoints(h.unionByName(v), ["page_index"], 4.0).select("page_index", "coord", "lo", "hi")


_SPOTS = """WITH t AS (SELECT o_custkey AS page, o_orderkey AS text_idx, substr(o_orderpriority, 1, 1) AS p, o_orderkey % 900 AS x0, o_orderkey % 700 AS y0 FROM orders),
    l AS (SELECT l_orderkey % 1500 + 1 AS page, floor(l_extendedprice % 900) AS x0, floor(l_extendedprice % 900) + l_quantity AS x1, l_suppkey * 7.0E0 AS y0, l_suppkey * 7.0E0 + l_linenumber * 10 AS y1 FROM lineitem),
    s AS (SELECT c_custkey AS page, count(*) FILTER (WHERE x0 + 30 >= 680) AS nr, count(*) FILTER (WHERE x0 + 30 >= 680 AND p = '1') AS nt, min(x0) FILTER (WHERE x0 + 30 >= 680) AS tx0, min(y0) FILTER (WHERE x0 + 30 >= 680) AS ty0, max(x0 + 60) FILTER (WHERE x0 + 30 >= 680) AS tx1, max(y0 + 12) FILTER (WHERE x0 + 30 >= 680) AS ty1 FROM customer LEFT JOIN t ON page = c_custkey GROUP BY 1),
    e AS (SELECT *, greatest(680, coalesce(tx0 - 30, 680)) AS edge FROM s),
    r AS (SELECT e.page, any_value(nr) AS nr, any_value(nt) AS nt, any_value(tx0) AS tx0, any_value(tx1) AS tx1, any_value(ty0) AS ty0, any_value(ty1) AS ty1, count(l.page) AS nl, count(*) FILTER (WHERE l.x1 - l.x0 >= l.y1 - l.y0) AS nf, min(l.x0) AS lx0, max(l.x1) AS lx1, min(l.y0) AS ly0, max(l.y1) AS ly1
      FROM e LEFT JOIN l ON l.page = e.page AND (l.x0 + l.x1) / 2 >= edge GROUP BY 1),
    d AS (SELECT *, NOT (nt < 2 AND (nr < 4 OR least(nf, nl - nf) < 3)) AS titled, greatest(0, coalesce(least(tx0, lx0), tx0, lx0) - 12) AS left_x FROM r)"""


def _sheet(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pages = table(s, d, "customer").select(F.col("c_custkey").alias("page"), F.lit(1000.0).alias("width_pt"), F.lit(800.0).alias("height_pt"))
    p, x, y = F.substring("o_orderpriority", 1, 1), (F.col("o_orderkey") % 900).cast("double"), (F.col("o_orderkey") % 700).cast("double")
    said = F.when(p == "1", "Sheet A1").when(p == "2", "Door Schedule").when(p == "3", "LEGEND").otherwise("wall")
    texts = table(s, d, "orders").select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("text_idx"), said.alias("text"), F.struct(x.alias("x0"), y.alias("y0"), (x + 60).alias("x1"), (y + 12).alias("y1")).alias("bbox"))
    lx, ly = F.floor(F.col("l_extendedprice") % 900).cast("double"), F.col("l_suppkey") * 7.0
    lines = table(s, d, "lineitem").select((F.col("l_orderkey") % 1500 + 1).alias("page"), lx.alias("x0"), ly.alias("y0"), (lx + F.col("l_quantity")).alias("x1"), (ly + F.col("l_linenumber") * 10).alias("y1"))
    return drafting.region_candidates(pages, texts, lines, ["page"])


query(
    "g17_regions",
    _SPOTS
    + """, k AS (SELECT page, CASE p WHEN '2' THEN 'schedule' ELSE 'legend' END AS kind, count(*) AS n, min(x0) AS x0, min(y0) AS y0, max(x0 + 60) AS x1, max(y0 + 12) AS y1 FROM t JOIN d USING (page) WHERE p IN ('2', '3') GROUP BY 1, 2)
    SELECT page, 'design_region' AS kind, 0.0E0 AS x0, 0.0E0 AS y0, CASE WHEN titled THEN greatest(0, left_x - 8) ELSE 1000 END + 0.0E0 AS x1, 800.0E0 AS y1, CASE WHEN titled THEN 0.82E0 ELSE 0.45E0 END AS confidence FROM d
    UNION ALL SELECT page, 'title_block', left_x + 0.0E0, greatest(0, least(ty0, ly0) - 12) + 0.0E0, least(1000, greatest(tx1, lx1) + 12) + 0.0E0, least(800, greatest(ty1, ly1) + 12) + 0.0E0,
      round(least(0.95E0, 0.42E0 + 0.08E0 * nt + 0.015E0 * nl + 0.03E0 * least(nf, nl - nf, 6)), 6) FROM d WHERE titled
    UNION ALL SELECT page, kind, greatest(0, x0 - 10) + 0.0E0, greatest(0, y0 - 10) + 0.0E0, least(1000, x1 + 10) + 0.0E0, least(800, y1 + 10) + 0.0E0, round(least(0.9E0, 0.58E0 + 0.06E0 * n), 6) FROM k""",
)(lambda s, d: _sheet(s, d)[0].withColumn("confidence", F.round("confidence", 6)))
query("g17_excluded_texts", _SPOTS + " SELECT page, text_idx, nth FROM (SELECT page, text_idx, row_number() OVER (PARTITION BY page ORDER BY text_idx) AS nth FROM t JOIN d USING (page) WHERE titled AND t.x0 + 30 > greatest(0, left_x - 8)) WHERE nth <= 20")(lambda s, d: _sheet(s, d)[1])


_LAYOUT = """, e AS (SELECT *, page_index AS run_id, space_id % 7 AS page, (space_id % 3 = 0 AND page_index % 2 = 0) AS sheet, space_id % 5 AS k FROM v_box),
    u AS (SELECT e.*, k = 2 AND space_id % 4 = 0 AS measured FROM e JOIN (SELECT run_id, bool_or(sheet) AS sheets FROM e GROUP BY 1) USING (run_id) WHERE sheet = sheets),
    w AS (SELECT run_id, page, concat(space_id, '-', g.i) AS id, least(g.a, g.c) AS x0, least(g.b, g.d) AS y0, greatest(g.a, g.c) AS x1, greatest(g.b, g.d) AS y1 FROM (
      SELECT *, unnest([{'i': 0, 'a': x0, 'b': y0, 'c': x1, 'd': y0}, {'i': 1, 'a': x1, 'b': y0, 'c': x1, 'd': y1}, {'i': 2, 'a': x1, 'b': y1, 'c': x0, 'd': y1}, {'i': 3, 'a': x0, 'b': y1, 'c': x0, 'd': y0}]) AS g FROM u WHERE k < 2)),
    o AS (SELECT run_id, page, CAST(space_id AS VARCHAR) AS id, CASE k WHEN 0 THEN 'room_volume' WHEN 1 THEN 'corridor_volume' WHEN 2 THEN CASE WHEN space_id % 2 = 0 THEN 'window_opening' ELSE 'door_opening' END WHEN 3 THEN 'stair_placeholder' ELSE 'dimension_anchor' END AS kind,
      x0, y0, x1, y1, 0.0E0 AS z, CASE k WHEN 2 THEN CASE WHEN measured THEN 1.5E0 ELSE 2.1E0 END WHEN 3 THEN 3.0E0 WHEN 4 THEN 0.1E0 ELSE 2.8E0 END AS height,
      CASE k WHEN 2 THEN concat(CASE WHEN measured THEN '' WHEN space_id % 2 = 0 THEN 'A-WINDOW-OPENING-HEIGHT,' ELSE 'A-DOOR-OPENING-HEIGHT,' END, 'A-WALL-THICKNESS') WHEN 3 THEN 'A-STAIR-PLACEHOLDER-HEIGHT' WHEN 4 THEN '' ELSE 'A-ROOM-VOLUME-HEIGHT' END AS assumed FROM u
    UNION ALL SELECT run_id, page, id, 'wall', x0, y0, x1, y1, 0.0E0, 2.8E0, 'A-WALL-HEIGHT,A-WALL-THICKNESS' FROM w
    UNION ALL SELECT run_id, page, 'slab', 'floor_slab', min(x0), min(y0), max(x1), max(y1), -0.12E0, 0.12E0, 'A-FLOOR-SLAB-THICKNESS' FROM u GROUP BY 1, 2)
    """


@query(
    "g22_layout",
    _LAYOUT + "SELECT run_id, concat('page-', page, '-', replace(kind, '_', '-'), '-', id) AS object_id, kind AS object_type, x0 / 50 AS x0, y0 / 50 AS y0, x1 / 50 AS x1, y1 / 50 AS y1, z AS z_base_m, height AS height_m, assumed FROM o",
    "v_box",
)
def layout(s: SparkSession, d: str) -> DataFrame:
    k = F.col("space_id") % 5
    kind = F.when(k == 0, "Room").when(k == 1, "Corridor").when(k == 2, "Door").when(k == 3, "Stair").otherwise("Dimension")
    sheet = (F.col("space_id") % 3 == 0) & (F.col("page_index") % 2 == 0)
    rows = view(s, d, "v_box").select(F.col("page_index").alias("run_id"), F.when(sheet, "sheet").otherwise("primary").alias("source"), (F.col("space_id") % 7).alias("page_index"), kind.alias("entity_type"), F.col("space_id").cast("string").alias("entity_id"), F.struct("x0", "y0", "x1", "y1").alias("bbox"), _ring(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]).alias("polygon"), F.when(F.col("space_id") % 4 == 0, 1.5).alias("height_m"), (F.col("space_id") % 2 == 0).alias("is_window"))
    return openings.layout_objects(rows)[0].withColumn("assumed", F.array_join("assumption_ids", ",")).drop("assumption_ids", "page_index")


# texts

_SIZES = "SELECT p_partkey, p_size * 1.0E0 AS n, p_size % 7 / 8.0E0 AS q, p_size % 7 * 1.0E0 AS num, p_partkey % 5 * 1.0E0 AS k FROM part"


def _numbers(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    body = F.concat(F.lit("GB 50096-2011, 表 3.2: 2．宽 at least "), F.col("p_size"), F.lit(" mm, "), F.col("p_size") % 7, F.lit("/8 of {x9} 三层 on "), k, F.lit(" cm"))
    texts = {"clause": body, "template": body, "expression": F.concat(F.lit("w_2 >= "), F.col("p_size"), F.lit(" and h3 < "), k, F.lit(".5 or s == 'x 7'"))}
    found = F.array(*[F.struct(F.lit(mode).alias("mode"), text.numbers(t, mode).alias("v")) for mode, t in texts.items()])
    return table(s, d, "part").select("p_partkey", F.inline(found)).select("p_partkey", "mode", F.explode("v").alias("number"))


query(
    "t7_numbers",
    f"""SELECT p_partkey, 'clause' AS mode, unnest(list_distinct([q, n, 9.0E0, k, n / 1000.0E0, k / 100.0E0, 3.0E0])) AS number FROM ({_SIZES})
    UNION ALL SELECT p_partkey, 'template', unnest(list_distinct([2.0E0, n, num, 8.0E0, k, n / 1000.0E0, k / 100.0E0])) FROM ({_SIZES}) UNION ALL SELECT p_partkey, 'expression', unnest(list_distinct([n, k + 0.5E0])) FROM ({_SIZES})""",
)(_numbers)


@query(
    "t9_source_coverage",
    """WITH c AS (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i, p_size + 100 AS s1, p_size * 3 + 200 AS s2, p_size + 100 + CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END AS said FROM part)
    SELECT concat('STD', p_partkey, '-7.2.', i) AS clause_id,
    array_to_string(list_transform(list_sort(list_filter([7.2::DOUBLE, s1, s2], lambda x: x <> said)), lambda x: CAST(x AS VARCHAR)), ',') AS source_only,
    CASE WHEN said NOT IN (s1, s2) THEN CAST(CAST(said AS DOUBLE) AS VARCHAR) ELSE '' END AS text_only FROM c""",
)
def coverage(s: SparkSession, d: str) -> DataFrame:
    """A source for each brand, two pages for each of its clauses: the heading and a number, then another number and, on every tenth, a reference that ends the body."""
    part = table(s, d, "part")
    i = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    rows = part.select("p_partkey", "p_brand", "p_size", i.alias("i"))
    head = F.concat(F.lit("before it\n 7.2."), "i", F.lit(" needs "), F.col("p_size") + 100, F.lit(" of it"))
    more = F.concat(F.lit(" and then "), F.col("p_size") * 3 + 200, F.lit(" of it"), F.when(F.col("i") % 10 == 0, F.concat(F.lit(", see 7.2."), F.col("i") + 1, F.lit(" with 555"))).otherwise(""))
    said = F.concat(F.lit("at least "), F.col("p_size") + 100 + F.when(F.col("p_partkey") % 3 == 0, 0).otherwise(1))
    clauses = rows.select(F.concat(F.lit("STD"), "p_partkey", F.lit("-7.2."), "i").alias("clause_id"), F.col("p_brand").alias("source"), said.alias("clause_text"), F.lit(True).alias("paraphrase"))
    pages = [rows.select(F.col("p_brand").alias("source"), (F.col("i") * 2 + k).cast("int").alias("page_index"), t.alias("text")) for k, t in ((0, head), (1, more))]
    found = drafting.source_coverage(clauses, pages[0].unionByName(pages[1]))
    return found.select("clause_id", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("source_only", "text_only")])


_CLAUSES = ["走廊净宽", "门宽", "楼梯扶手", "楼梯宽度", "踏步", "净高", "卧室", "电梯", "窗台", "其他"]


_DRAFTED = "['min_width_m', 'width_m', 'handrail_height_m', 'flight_width_m', '', 'net_height_m', 'area_m2', 'floors', 'height_m', ''][p_size % 10 + 1]"
_OP = "['>=', '<', '>'][p_partkey % 4 + 1]"


@query(
    "t11_drafts",
    f"""SELECT p_partkey AS clause_id, ['Corridor', 'Door', 'Stair', 'Stair', 'Stair', 'Room', 'Room', 'Project', 'Dimension', NULL][p_size % 10 + 1] AS applies_to,
    CASE WHEN p_size % 10 = 7 THEN 'floors,height_m' ELSE {_DRAFTED} END AS inputs,
    CASE WHEN p_partkey % 4 < 3 AND p_size % 10 NOT IN (4, 9) THEN concat({_DRAFTED}, ' ', {_OP}, ' ', p_size) END AS logic_expression,
    CASE WHEN p_partkey % 4 = 3 OR p_size % 10 IN (4, 9) THEN NULL ELSE concat('edge ', p_size, ' ', p_partkey % 4 = 0, ',', CASE WHEN p_partkey % 4 = 1 THEN 'above ' ELSE 'below ' END,
        CAST(round(p_size * CASE WHEN p_partkey % 4 = 1 THEN 110 ELSE 90 END) AS INT), ' false') END AS cases,
    concat_ws(',', CASE WHEN p_size % 10 IN (4, 9) THEN 'entity_input_mapping' END, CASE WHEN p_partkey % 4 = 3 THEN 'machine_readable_threshold' END,
        CASE WHEN p_partkey % 3 = 0 THEN 'rule_split_or_branching' END) AS missing FROM part""",
)
def drafts(s: SparkSession, d: str) -> DataFrame:
    words = F.element_at(F.lit(_CLAUSES), (F.col("p_size") % 10 + 1).cast("int"))
    said = F.concat(words, F.lit(" 1.2 m"), F.when(F.col("p_partkey") % 3 == 0, " 900 mm").otherwise(""))
    op = F.try_element_at(F.lit([">=", "<", ">"]), (F.col("p_partkey") % 4 + 1).cast("int"))
    clauses = table(s, d, "part").select(F.col("p_partkey").alias("clause_id"), said.alias("clause_text"), op.alias("threshold_op"), F.col("p_size").cast("double").alias("threshold_value"))

    def case(c: Column) -> Column:
        # the threshold itself in whole numbers, what lies beyond it in hundredths
        value = F.when(c["name"] == "edge", c["value"]).otherwise(F.round(c["value"] * 100))
        return F.concat_ws(" ", c["name"], value.cast("int"), c["expect_pass"])

    listed = [F.array_join("inputs", ",").alias("inputs"), "logic_expression", F.array_join(F.transform("test_cases", case), ",").alias("cases"), F.array_join("missing", ",").alias("missing")]
    return drafting.draft_rules(clauses).select("clause_id", "applies_to", *listed)


_LABELS = ["Master BEDROOM", "厨房 2", "卫生间", "Living area", "garage", " bedroom  #12. ", "Bedroom#x", "wic", "SLD3068", "2868 .", "12'-06\"", "3'-11\"", "a=12'-0\"", "mech", "walk-in", "12345"]
_NAMED = "(VALUES " + ", ".join(f"({i}, {a}, {b}, {c}, {e})" for i, (a, b, c, e) in enumerate([("'bedroom'", "NULL", "NULL", "NULL"), ("'kitchen'", "NULL", "NULL", "NULL"), ("'bathroom'", "'bath'", "NULL", "NULL"), ("'living'", "NULL", "NULL", "NULL"), ("NULL",) * 4, ("'bedroom'", "'bedroom'", "NULL", "NULL"), ("'bedroom'", "NULL", "NULL", "NULL"), ("NULL", "'walk_in'", "NULL", "NULL"), ("NULL", "NULL", "'SLD3068'", "NULL"), ("NULL", "NULL", "'2868'", "NULL"), ("NULL", "NULL", "NULL", "'12''-06\"'"), ("NULL",) * 4, ("NULL",) * 4, ("NULL", "'mech'", "NULL", "NULL"), ("NULL", "'walk_in'", "NULL", "NULL"), ("NULL",) * 4])) + ") v(i, label, kind, size, dimension)"


def _label(i: Column) -> Column:
    return F.element_at(F.lit(_LABELS), (i % len(_LABELS) + 1).cast("int"))


query("t12_labels", f"SELECT p_partkey, label, kind, size, dimension FROM part JOIN {_NAMED} ON i = p_partkey % {len(_LABELS)}")(
    lambda s, d: table(s, d, "part").withColumn("t", _label(F.col("p_partkey"))).select("p_partkey", text.normalize_labels(F.col("t")).alias("label"), text.room_kind(F.col("t")).alias("kind"), text.opening_size(F.col("t")).alias("size"), text.major_dimension(F.col("t")).alias("dimension"))
)
query(
    "t13_text_inventory",
    f"""SELECT run_id, section, key, count(*) AS n, min(event_id) AS first_at FROM (SELECT user_id AS run_id, event_id, unnest([{{'section': 'room_label_counts', 'key': kind}}, {{'section': 'door_or_opening_size_label_counts', 'key': size}}, {{'section': 'major_dimension_texts', 'key': dimension}}], recursive := true)
    FROM events JOIN {_NAMED} ON i = event_id % {len(_LABELS)}) WHERE key IS NOT NULL GROUP BY 1, 2, 3""",
)(lambda s, d: text.text_inventory(table(s, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("text_idx"), _label(F.col("event_id")).alias("text")), ["run_id"]))


_SAID = """, t AS (SELECT event_id AS text_idx, event_id % 20 AS page_index, event_id % 500 AS x, event_id % 230 AS y, (event_id % 10) / 10.0E0 AS c, CASE event_type WHEN 'view' THEN 'bedroom' WHEN 'click' THEN 'kitchen' END AS label,
    CASE event_type WHEN 'view' THEN 'Bedroom' WHEN 'click' THEN 'kitchen' WHEN 'purchase' THEN 'DOOR 0.9' WHEN 'error' THEN '走廊 1.2' ELSE 'wall' END AS said FROM events),
    r AS (SELECT t.*, space_id, CASE WHEN space_id % 3 = 0 THEN 'bedroom' WHEN space_id % 3 = 1 THEN '' END AS room_label, row_number() OVER (PARTITION BY text_idx ORDER BY space_id) AS nth FROM t LEFT JOIN v_box b ON b.page_index = t.page_index AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1)"""


def _texts(s: SparkSession, d: str) -> DataFrame:
    said = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for x in ("view", "Bedroom", "click", "kitchen", "purchase", "DOOR 0.9", "error", "走廊 1.2")]), F.col("event_type")), F.lit("wall"))
    return table(s, d, "events").select((F.col("event_id") % 20).alias("page_index"), F.col("event_id").alias("text_idx"), said.alias("text"), ((F.col("event_id") % 10) / 10.0).alias("confidence"), (F.col("event_id") % 500).cast("double").alias("x"), (F.col("event_id") % 230).cast("double").alias("y"))


def _diagnosed(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rooms = view(s, d, "v_box").select("page_index", "space_id", F.col("space_id").alias("space_idx"), _ring(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]).alias("polygon"), F.when(F.col("space_id") % 3 == 0, "bedroom").when(F.col("space_id") % 3 == 1, "").alias("label"))
    return drafting.ocr_diagnostics(_texts(s, d), rooms, ["page_index"])


query(
    "t14_diagnostics",
    f"""{_SAID} SELECT page_index, count(*) AS texts, count(space_id) AS bound_texts, count(*) FILTER (WHERE c < 0.7) AS low_confidence_texts, count(*) FILTER (WHERE label <> room_label AND room_label <> '') AS label_conflict,
    count(*) FILTER (WHERE label IS NOT NULL AND space_id IS NULL AND c >= 0.85) AS unbound_high_confidence_label, count(*) FILTER (WHERE label IS NOT NULL AND c < 0.7) AS low_confidence_label FROM r WHERE nth = 1 GROUP BY 1""",
    "v_box",
)(lambda s, d: _diagnosed(s, d)[1])
query(
    "t14_texts",
    f"""{_SAID} SELECT page_index, text_idx, label, space_id, c < 0.7 AS low_confidence, space_id IS NOT NULL AS bound, concat_ws(',', CASE WHEN label <> room_label AND room_label <> '' THEN 'label_conflict' END,
    CASE WHEN label IS NOT NULL AND space_id IS NULL AND c >= 0.85 THEN 'unbound_high_confidence_label' END, CASE WHEN label IS NOT NULL AND c < 0.7 THEN 'low_confidence_label' END) AS reasons FROM r WHERE nth = 1""",
    "v_box",
)(lambda s, d: _diagnosed(s, d)[0].withColumn("reasons", F.array_join("reasons", ",")))
query(
    "t14_targets",
    f"""{_SAID}, g AS (SELECT page_index, space_id, CASE WHEN space_id % 2 = 0 THEN 'corridor' ELSE 'door' END AS kind, (x0 + x1) / 2 AS tx, (y0 + y1) / 2 AS ty, x1 - x0 AS value_m FROM v_box),
    n AS (SELECT t.page_index, text_idx, kind, space_id AS target_id, value_m, sqrt((x - tx) * (x - tx) + (y - ty) * (y - ty)) AS dist FROM t JOIN g ON g.page_index = t.page_index AND (said NOT IN ('DOOR 0.9', '走廊 1.2') OR said = 'DOOR 0.9' AND kind = 'door' OR said = '走廊 1.2' AND kind = 'corridor'))
    SELECT * FROM n WHERE dist < 15 QUALIFY row_number() OVER (PARTITION BY text_idx ORDER BY dist, kind, target_id) = 1""",
    "v_box",
)(
    lambda s, d: drafting.dimension_targets(_texts(s, d), view(s, d, "v_box").select("page_index", F.when(F.col("space_id") % 2 == 0, "corridor").otherwise("door").alias("kind"), F.col("space_id").alias("target_idx"), F.col("space_id").alias("target_id"), ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"), (F.col("x1") - F.col("x0")).alias("value_m")), ["page_index"], 15.0)
)


@query(
    "t16_profile",
    """, c AS (SELECT run_id, count(*) FILTER (WHERE entity_type = 'Room') AS r, count(*) FILTER (WHERE entity_type = 'Door') AS d, count(*) FILTER (WHERE entity_type = 'Corridor') AS h, count(*) FILTER (WHERE mark = 'F' AND slope > 0.05) AS m, count(*) FILTER (WHERE entity_type = 'Room' AND width_m IS NULL) AS u FROM v_entity GROUP BY 1)
    SELECT run_id, 'floor_plan' AS drawing_type, CASE WHEN r > u THEN 'residential_plan' ELSE 'floor_plan' END AS likely_design, CASE WHEN r > 0 AND d > 0 AND m > 0 THEN 'layout_with_dimensions' ELSE 'component_inventory' END AS level,
    concat_ws(',', CASE WHEN r > 0 THEN 'spatial_layout' END, CASE WHEN r > u THEN 'residential_room_labels' END, CASE WHEN d > 0 THEN 'openings' END, CASE WHEN h > 0 THEN 'horizontal_circulation' END, CASE WHEN m > 0 THEN 'dimension_evidence' END) AS signals,
    concat_ws(',', CASE WHEN u > 0 THEN 'unlabeled_rooms' END, CASE WHEN r > 0 AND d = 0 THEN 'rooms_without_openings' END, CASE WHEN r > 0 AND h = 0 THEN 'rooms_without_corridor' END, CASE WHEN m = 0 THEN 'no_dimension_evidence' END) AS doubts FROM c""",
    "v_entity",
)
def profile(s: SparkSession, d: str) -> DataFrame:
    room, none = F.col("entity_type") == "Room", F.lit(0)
    counts = view(s, d, "v_entity").groupBy("run_id").agg(F.count_if(room).alias("rooms"), F.count_if(F.col("entity_type") == "Door").alias("doors"), F.count_if(F.col("entity_type") == "Corridor").alias("corridors"), F.count_if((F.col("mark") == "F") & (F.col("slope") > 0.05)).alias("dimensions"), F.count_if(room & F.col("width_m").isNull()).alias("unlabeled_rooms"), F.count_if(room & F.col("width_m").isNotNull()).alias("residential_rooms"))
    counts = counts.withColumns({c: none for c in ("stairs", "dimension_texts", "texts", "lines", "uncertain_stairs", "review_texts")})
    return drafting.drawing_profile(counts).withColumns({c: F.array_join(c, ",") for c in ("signals", "doubts")})


# packages


@query(
    "l11_package_quality",
    """SELECT c_custkey AS package, CAST(CASE WHEN c_nationkey % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN c_nationkey % 3 = 0 THEN 1 ELSE 0 END + coalesce(lost, 0) + CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS INT) AS n_blockers FROM customer
    LEFT JOIN (SELECT o_custkey, count(*) AS lost FROM orders WHERE o_orderstatus = 'F' AND o_totalprice < 100000 GROUP BY 1) ON o_custkey = c_custkey""",
)
def quality(s: SparkSession, d: str) -> DataFrame:
    orders = table(s, d, "orders").select(F.col("o_custkey").alias("package"), F.col("o_orderkey").cast("string").alias("path"), "o_orderstatus", "o_totalprice")
    held = orders.groupBy("package").agg(F.collect_list(F.struct(F.col("path").alias("artifact"), F.when(F.col("o_orderstatus") == "F", "available").otherwise("missing").alias("status"), "path")).alias("artifacts"))
    said = F.array(F.lit("Candidate only, preview, review-state"), F.when(F.col("c_acctbal") < 0, "missing input").otherwise("missing input evidence_ready"))
    rows = table(s, d, "customer").select(F.col("c_custkey").alias("package"), F.when(F.col("c_nationkey") % 5 == 0, "v0").otherwise("v1").alias("schema_version"), (F.col("c_nationkey") % 3 != 0).alias("read_only"), F.lit("copy").alias("mutation_policy"), F.array().cast("array<string>").alias("missing_required"), said.alias("boundary_warnings"))
    found = packages.package_quality(rows.join(held, "package", "left"), orders.where("o_totalprice >= 100000"), "v1", "copy")
    return found.select("package", F.size("blockers").alias("n_blockers"))


_STATES = """(SELECT c_custkey AS package, CASE WHEN c_nationkey = 3 THEN 'v0' ELSE 'v1' END AS v, c_nationkey = 4 AS lacks, CASE WHEN c_custkey % 11 = 0 THEN 'not_run' WHEN c_custkey % 13 = 0 THEN 'not_ready' ELSE 'handoff_ready' END AS q,
    CASE WHEN c_custkey % 7 = 0 THEN 'needs_info' ELSE 'ready' END AS s, CASE WHEN c_custkey % 5 = 0 THEN 'missing' ELSE 'checklist_complete' END AS k, CASE WHEN c_custkey % 4 = 0 THEN 'manager_blocked' ELSE 'manager_ready' END AS m FROM customer)"""


def _packages(s: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(s, d, "customer").select(
        key.alias("package"), F.when(F.col("c_nationkey") == 3, "v0").otherwise("v1").alias("schema_version"), F.when(F.col("c_nationkey") == 4, F.array(F.lit("plan"))).alias("missing_required"),
        F.when(key % 11 == 0, None).when(key % 13 == 0, "not_ready").otherwise("handoff_ready").alias("quality_status"), F.when(key % 7 == 0, "needs_info").otherwise("ready").alias("signoff_status"), F.when(key % 5 != 0, "checklist_complete").alias("checklist_status"),
        F.when(key % 4 == 0, "manager_blocked").otherwise("manager_ready").alias("manager_status"), F.lit("archive_manifest_ready").alias("archive_status"), F.lit("archive_verified").alias("archive_verification_status"),
    )


query(
    "l12_next_action",
    f"""SELECT package, CASE WHEN v <> 'v1' OR lacks OR q = 'not_ready' OR m = 'manager_blocked' THEN 'package_blocked' WHEN q = 'not_run' OR s = 'needs_info' THEN 'package_needs_info' ELSE 'package_ready' END AS status,
    CASE WHEN v <> 'v1' THEN 'restore_manifest' WHEN lacks THEN 'restore_required_artifacts' WHEN q <> 'handoff_ready' THEN 'run_handoff_quality' WHEN s <> 'ready' THEN 'record_reviewer_signoff' WHEN k = 'missing' THEN 'close_checklist' WHEN m <> 'manager_ready' THEN 'run_manager_checklist' ELSE 'ready' END AS action_id,
    concat_ws(',', CASE WHEN v <> 'v1' THEN 'manifest' END, CASE WHEN lacks THEN 'required: plan' END, CASE WHEN q <> 'handoff_ready' THEN 'quality_status: ' || q END, CASE WHEN s <> 'ready' THEN 'signoff_status: ' || s END,
      CASE WHEN m <> 'manager_ready' THEN 'manager_status: ' || m END) AS open_items FROM {_STATES}""",
)(lambda s, d: packages.package_next_action(_packages(s, d), "v1").select("package", "status", "action_id", F.array_join("open_items", ",").alias("open_items")))


@query(
    "l15_triage",
    """SELECT c_custkey AS package, 'required_next_action' AS category, CASE WHEN c_mktsegment = 'BUILDING' THEN 'blocker' ELSE 'needs_info' END AS severity, 0 AS place FROM customer WHERE c_nationkey % 4 <> 0
    UNION ALL SELECT c_custkey, 'opening_provenance', 'guidance', 0 FROM customer WHERE c_acctbal < 1000 UNION ALL SELECT c_custkey, 'optional_guidance', 'guidance', 0 FROM customer WHERE c_acctbal > 5000
    UNION ALL SELECT c_custkey, 'optional_guidance_note', CASE WHEN c_custkey % 6 IN (1, 3) THEN 'blocker' ELSE 'needs_info' END, CAST(c_custkey % 6 + 1 AS INT) FROM customer WHERE c_custkey % 6 < 4""",
)
def triage(s: SparkSession, d: str) -> DataFrame:
    note = F.try_element_at(F.lit(packages.NOTE_ORDER), (F.col("c_custkey") % 6 + 1).cast("int"))
    rows = table(s, d, "customer").select(
        F.col("c_custkey").alias("package"), F.when(F.col("c_nationkey") % 4 == 0, "done").otherwise("reviewer").alias("actor"), F.lit("check").alias("action_id"), F.when(F.col("c_mktsegment") == "BUILDING", "archive DRIFT").otherwise("open").alias("reason"),
        F.lit(True).alias("provenance_available"), (F.col("c_acctbal") < 1000).alias("provenance_weak"), F.lit(0).alias("semantic_count"), F.lit(1).alias("measurement_count"), F.lit(0).alias("host_count"), (F.col("c_acctbal") > 5000).alias("guidance_available"), F.lit("look").alias("guidance_reason"), note.alias("note_status"),
    )
    return packages.triage_digest(rows).drop("reason")


_COUNTS = {
    "understanding": ("v_entity", "project_id", {"rooms": "entity_type = 'Room'", "doors": "entity_type = 'Door'", "corridors": "entity_type = 'Corridor'"}),
    "readiness": ("orders", "o_custkey", {"ready_rules": "o_orderpriority = '1-URGENT'", "blocked_rules": "o_orderpriority IN ('2-HIGH', '3-MEDIUM')"}),
    "classification": ("lineitem", "l_suppkey", {"plan_sheet_count": "l_returnflag = 'A'"}),
    "routing": ("supplier", "s_suppkey", {}),
    "sheet_graphs": ("lineitem", "l_partkey", {"sheet_graph_count": "l_linenumber = 1"}),
    "sheet_issues": ("v_issue", "run_id", {"sheet_issue_count": "status = 'candidate'"}),
    "queue": ("events", "user_id", {"sheet_issue_queue_count": "event_type = 'error'"}),
    "regions": ("customer", "c_custkey", {"region_count": "c_acctbal > 0"}),
    "layout": ("v_drawing", "drawing_id", {"layout_object_count": "page_count > 40"}),
    "review_state": ("v_issue", "run_id + 1", {"candidate_review_states": "status = 'candidate'"}),
    "issues": ("v_issue", "run_id", {"issue_count": "true", "issue_error_count": "severity = '1-URGENT'", "issue_warning_count": "severity = '2-HIGH'"}),
}
_TEXTS = {"understanding": {"drawing_type": ("mark", "unknown")}, "routing": {"routing_mode": ("CASE WHEN s_nationkey % 2 = 0 THEN 'single' ELSE '' END", "missing")}, "layout": {"layout_status": ("CASE WHEN page_count > 20 THEN source_path END", "missing")}}


def _workbench_sql() -> str:
    own = {a: [f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in counts.items()] + [f"max({c}) AS {n}" for n, (c, _) in _TEXTS.get(a, {}).items()] for a, (_, _, counts) in _COUNTS.items()}
    parts = ", ".join(f"{a} AS (SELECT {', '.join([f'{key} AS run', 'true AS there', *own[a]])} FROM {t} GROUP BY {key})" for a, (t, key, _) in _COUNTS.items())
    names = [f"coalesce({n}, 0) AS {n}" for _, _, counts in _COUNTS.values() for n in counts] + [f"coalesce(nullif({n}, ''), '{m}') AS {n}" for own in _TEXTS.values() for n, (_, m) in own.items()]
    absent = "concat_ws(',', " + ", ".join(f"CASE WHEN {a}.there IS NULL THEN '{a}' END" for a in _COUNTS) + ")"
    joins = " ".join(f"LEFT JOIN {a} ON {a}.run = r.run_id" for a in _COUNTS)
    warn = f"concat_ws(',', CASE WHEN {absent} <> '' THEN 'missing_artifacts' END, CASE WHEN blocked_rules > 0 THEN 'blocked_rules' END, CASE WHEN sheet_graph_count > 1 THEN 'several_sheet_graphs' END, CASE WHEN issue_count > 0 AND candidate_review_states > 0 THEN 'unreviewed_candidates' END)"
    return f", {parts} SELECT r.run_id, {', '.join(names)}, {absent} AS missing, {warn} AS warnings FROM v_run r {joins}"


@query("l18_workbench", _workbench_sql(), "v_entity", "v_issue", "v_drawing", "v_run")
def bench(s: SparkSession, d: str) -> DataFrame:
    tables = {a: ((view if t.startswith("v_") else table)(s, d, t).withColumn("run_id", F.expr(key)), {n: F.expr(c) for n, c in counts.items()}) for a, (t, key, counts) in _COUNTS.items()}
    return packages.workbench(view(s, d, "v_run"), tables, {a: {n: (F.expr(c), m) for n, (c, m) in own.items()} for a, own in _TEXTS.items()})


@query(
    "l20_promote",
    """SELECT concat('R-', o_orderpriority) AS rule_id, concat('confirmed-', o_orderkey) AS name, CASE WHEN o_orderkey % 3 = 0 THEN c_acctbal ELSE s_acctbal END AS width_m, CAST(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE s_nationkey END AS DOUBLE) AS mark FROM orders
    LEFT JOIN supplier ON s_suppkey = o_custkey LEFT JOIN customer ON c_custkey = o_custkey AND c_nationkey > 5 WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderkey % 10 <> 1 AND (o_orderkey % 3 <> 0 OR c_custkey IS NOT NULL)""",
)
def promote(s: SparkSession, d: str) -> DataFrame:
    key = F.col("o_custkey").cast("string")
    issues = table(s, d, "orders").select(F.lit(1).alias("run_id"), F.col("o_orderkey").alias("issue_id"), F.concat(F.lit("R-"), "o_orderpriority").alias("rule_id"), F.array(F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("project:"), key)).otherwise(key)).alias("entity_ids"), F.when(F.col("o_orderstatus") == "F", "confirmed").otherwise("open").alias("status"), F.col("o_custkey").alias("project_id"))
    known = table(s, d, "orders").where("o_orderkey % 10 = 1").select(F.concat(F.lit("R-"), "o_orderpriority").alias("rule_id"), F.concat(F.lit("confirmed-"), "o_orderkey").alias("name"))
    rules = [{"rule_id": f"R-{p}", "inputs": ["width_m", "mark"]} for p in ("1-URGENT", "2-HIGH")]
    entities = table(s, d, "supplier").select(F.lit(1).alias("run_id"), F.col("s_suppkey").cast("string").alias("entity_id"), F.parse_json(F.to_json(F.struct(F.col("s_acctbal").alias("width_m"), F.col("s_nationkey").alias("mark")))).alias("properties"))
    projects = table(s, d, "customer").where("c_nationkey > 5").select(F.col("c_custkey").alias("project_id"), F.col("c_acctbal").alias("width_m"))
    return packages.promote_cases(issues, entities, projects, rules, known).select("rule_id", "name", *[F.get_json_object("inputs", f"$.{c}").cast("double").alias(c) for c in ("width_m", "mark")])


@query(
    "l21_failures",
    """SELECT o_orderkey AS report_id, l_linenumber AS specification_no, o_orderpriority AS requirement, CASE WHEN l_returnflag = 'A' THEN concat('Door:', l_partkey) WHEN l_returnflag = 'N' THEN CAST(l_partkey AS VARCHAR) END AS entity,
    CASE WHEN l_returnflag = 'A' THEN CAST(l_suppkey AS VARCHAR) ELSE l_linestatus END AS actual, CASE WHEN l_linenumber % 2 = 0 THEN concat('least ', l_suppkey) END AS expected, CASE WHEN l_linenumber % 3 = 0 THEN concat('bad ', l_partkey) END AS message,
    row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ordinal FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linestatus = 'F'""",
)
def failures(s: SparkSession, d: str) -> DataFrame:
    both = table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    part = F.col("l_partkey").cast("string")
    entity = F.when(F.col("l_returnflag") == "A", F.to_json(F.struct(F.lit("Door").alias("type"), part.alias("GlobalId"), F.col("l_suppkey").cast("string").alias("actual")))).when(F.col("l_returnflag") == "N", F.concat(F.lit('"'), part, F.lit('"')))
    # what a requirement says itself, where its entities say nothing
    also = F.concat(
        F.lit('","actual_value":"'), "l_linestatus",
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit('","expected":"least '), "l_suppkey")).otherwise(""),
        F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit('","reason":"bad '), part)).otherwise(""),
    )
    need = F.concat(F.lit('{"status":'), F.when(F.col("l_linestatus") == "F", '"Failed"').otherwise("true"), F.lit(',"label":"'), F.col("o_orderpriority"), F.lit('","value_of":"x'), also, F.coalesce(F.concat(F.lit('","failures":['), entity, F.lit("]}")), F.lit('"}')))
    spec = F.concat(F.lit('{"name":"'), F.col("l_linenumber").cast("string"), F.lit('","facets":'), need, F.lit("}"))
    bodies = both.groupBy("o_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", spec.alias("v")))), lambda x: x["v"]).alias("specs"))
    reports = bodies.select(F.col("o_orderkey").alias("report_id"), F.parse_json(F.concat(F.lit('{"specifications":['), F.array_join("specs", ","), F.lit("]}"))).alias("body"))
    return packages.flatten_failures(reports).select("report_id", F.col("specification").cast("int").alias("specification_no"), "requirement", "entity", "actual", "expected", "message", "ordinal")


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
