"""Door openings from wall gaps (G11, G12) and the 2.5D object table."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planaudit.operators import tiles
from planaudit.operators.geometry import boxed, polygon_edges

# Distance and share of an adjacent boundary, step off a bridge, confidences, default sizes in metres.
NEAR, COVER, STEP = 0.5, 0.5, 0.5
SURE, UNSURE, UNCERTAIN_BELOW = 0.85, 0.5, 0.6
HEIGHTS = {"floor_slab": 0.12, "room_volume": 2.8, "corridor_volume": 2.8, "wall": 2.8, "door_opening": 2.1, "window_opening": 2.1, "stair_placeholder": 3.0, "dimension_anchor": 0.1}
ASSUMED = {
    "floor_slab": ["A-FLOOR-SLAB-THICKNESS"],
    "room_volume": ["A-ROOM-VOLUME-HEIGHT"],
    "corridor_volume": ["A-ROOM-VOLUME-HEIGHT"],
    "wall": ["A-WALL-HEIGHT", "A-WALL-THICKNESS"],
    "door_opening": ["A-DOOR-OPENING-HEIGHT", "A-WALL-THICKNESS"],
    "window_opening": ["A-WINDOW-OPENING-HEIGHT", "A-WALL-THICKNESS"],
    "stair_placeholder": ["A-STAIR-PLACEHOLDER-HEIGHT"],
    "dimension_anchor": [],
}
OBJECT_TYPES = {"Room": "room_volume", "Corridor": "corridor_volume", "Door": "door_opening", "Stair": "stair_placeholder", "Dimension": "dimension_anchor"}


def _hull(low: np.ndarray, high: np.ndarray, root: np.ndarray, middle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Widen [low, high] by middle -/+ sqrt(root) where there is a root."""
    half = np.sqrt(np.maximum(root, 0))
    return np.where(root >= 0, np.minimum(low, middle - half), low), np.where(root >= 0, np.maximum(high, middle + half), high)


def _band(at: np.ndarray, slope: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The t with least <= at + slope * t <= most."""
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = (least - at) / slope, (most - at) / slope
    inside = (at >= least) & (at <= most)
    low, high = np.where(slope == 0, np.where(inside, -np.inf, np.inf), np.minimum(a, b)), np.where(slope == 0, np.where(inside, np.inf, -np.inf), np.maximum(a, b))
    return low, high


def length_beside(rings: list[np.ndarray], x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, near: float = NEAR) -> np.ndarray:
    """How much of each segment lies within `near` of the edges of its ring (points of shape (n, 2)), at whatever angle.

    What lies near one edge is an interval, as an edge is convex: it is the hull of what lies beside the edge and of what
    lies around its two ends. The length is that of the union of the intervals.
    """
    size = np.array([len(r) for r in rings], np.int64)
    rows = np.repeat(np.arange(len(rings)), size)
    length = np.hypot(x1 - x0, y1 - y0)
    if not len(rows):
        return np.zeros(len(rings))
    a = np.concatenate(rings)
    after = np.arange(len(rows)) + 1
    after[np.cumsum(size)[size > 0] - 1] -= size[size > 0]
    b = a[after]
    safe = np.where(length > 0, length, 1)
    u = np.stack([(x1 - x0) / safe, (y1 - y0) / safe], axis=1)[rows]
    start = np.stack([x0, y0], axis=1)[rows]
    low, high = np.full(len(rows), np.inf), np.full(len(rows), -np.inf)
    for end in (a, b):
        w = start - end
        along = (w * u).sum(axis=1)
        low, high = _hull(low, high, along**2 - (w * w).sum(axis=1) + near**2, -along)
    edge = b - a
    span = np.hypot(edge[:, 0], edge[:, 1])
    v = edge / np.where(span > 0, span, 1)[:, None]
    w = start - a
    s, t = _band(w[:, 0] * v[:, 1] - w[:, 1] * v[:, 0], u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0], np.full(len(rows), -near), np.full(len(rows), near))
    p, q = _band((w * v).sum(axis=1), (u * v).sum(axis=1), np.zeros(len(rows)), span)
    s, t = np.maximum(s, p), np.minimum(t, q)
    beside = (span > 0) & (s <= t)
    low, high = np.where(beside, np.minimum(low, s), low), np.where(beside, np.maximum(high, t), high)
    low, high = np.maximum(low, 0), np.minimum(high, length[rows])
    kept = high > low
    low, high, rows = low[kept], high[kept], rows[kept]
    order = np.lexsort((low, rows))
    low, high, rows = low[order], high[order], rows[order]
    # one running maximum of row and rank serves all rows, and a row's length does not depend on the others
    ends = np.sort(high)
    top = np.maximum.accumulate(rows * max(len(rows), 1) + np.searchsorted(ends, high))[:-1]
    before = np.full(len(rows), -np.inf)
    before[1:] = np.where(top // max(len(rows), 1) == rows[1:], ends[top % max(len(rows), 1)], -np.inf)
    return np.bincount(rows, np.maximum(high - np.maximum(low, before), 0), len(rings))


def _beside(probes: pa.Table, spaces: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Places of probes and of the first space that counts for each.

    Across a box, an axis-parallel bridge meets its two ends only, 2 * NEAR each; a longer one has an edge of the box
    beside it, so it meets two thin boxes around those edges.
    """
    order = tiles.in_order(spaces, ["rank", "space_idx", "space_id"])
    page, space_page, held, rings = tiles.column(probes, "_page"), tiles.column(spaces, "_page")[order], tiles.boxes(spaces)[:, order], tiles.rings(spaces)
    rings = [rings[k] for k in order]
    shaped = np.array([r is not None for r in rings])
    corners = held[[0, 1, 2, 1, 2, 3, 0, 3]].T.reshape(-1, 4, 2)
    rings = [r if r is not None else corners[k] for k, r in enumerate(rings)]
    x0, y0, x1, y1, length = (tiles.column(probes, c) for c in ("x0", "y0", "x1", "y1", "len"))
    px, py = tiles.boxes(probes)[:2]
    found = np.full(len(page), -1)
    long = COVER * length > 4 * NEAR
    flat, upright = (y0 == y1) & long, (x0 == x1) & long
    for use, axis in ((flat, 1), (upright, 0), (~(flat | upright), None)):
        rows = np.flatnonzero(use)
        if not len(rows):
            continue
        at, item, copies = np.stack([px, py, px, py])[:, rows], held, 1
        if axis is not None:
            # the bridge's own place across, and boxes a little wider than NEAR; the check is exact
            at[[axis, axis + 2]] = (y0 if axis else x0)[rows]
            copies, item = 2, np.repeat(held, 2, axis=1)
            for k in (0, 1):
                edge = held[axis + 2 * k]
                item[axis, k::2] = np.where(shaped, held[axis] - 2 * NEAR if k == 0 else np.inf, edge - 1.01 * NEAR)
                item[axis + 2, k::2] = np.where(shaped, held[axis + 2] + 2 * NEAR if k == 0 else -np.inf, edge + 1.01 * NEAR)

        def check(q: np.ndarray, i: np.ndarray, rows: np.ndarray = rows, axis: int | None = axis, copies: int = copies) -> np.ndarray:
            q, i = rows[q], i // copies
            ok = (px[q] >= held[0, i]) & (px[q] <= held[2, i]) & (py[q] >= held[1, i]) & (py[q] <= held[3, i])
            if axis is not None:
                c = (y0 if axis else x0)[q]
                ok &= shaped[i] | (np.minimum(np.abs(c - held[axis, i]), np.abs(c - held[axis + 2, i])) <= NEAR)
            some = np.flatnonzero(ok & shaped[i])
            ok[some] = tiles.inside([rings[k] for k in i[some]], px[q[some]], py[q[some]])
            some = np.flatnonzero(ok)
            q, i = q[some], i[some]
            ok[some] = length_beside([rings[k] for k in i], x0[q], y0[q], x1[q], y1[q]) >= COVER * length[q]
            return ok

        best = tiles.first_over(at, page[rows], item, np.repeat(space_page, copies), check)
        found[rows] = np.where(best >= 0, best // copies, -1)
    hit = np.flatnonzero(found >= 0)
    return hit, order[found[hit]]


def classify_sides(bridges: DataFrame, spaces: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, bridge_id, side (-1 or 1), kind (surviving, filtered or exterior) and space_id of what lies beside a bridge.

    bridges: keys, bridge_id, x0, y0, x1, y1; spaces: keys, space_id, space_idx, kind (room, corridor or filtered),
    polygon. A space counts if its boundary, at whatever angle, runs along half of the bridge and it holds a point just
    off the middle. Rooms come before corridors before filtered spaces, then the smaller space_idx.
    """
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    rows = bridges.select(*keys, "bridge_id", "x0", "y0", "x1", "y1", F.hypot(dx, dy).alias("len"), F.explode(F.array(F.lit(-1), F.lit(1))).alias("side"))
    off = {c: F.try_divide(d, F.col("len")) * F.col("side") * STEP for c, d in (("px", -dy), ("py", dx))}
    rows = rows.withColumn("px", (F.col("x0") + F.col("x1")) / 2 + off["px"]).withColumn("py", (F.col("y0") + F.col("y1")) / 2 + off["py"])
    rank = F.when(F.col("kind") == "room", 0).when(F.col("kind") == "corridor", 1).otherwise(2)
    held = boxed(spaces.select(*keys, "space_id", rank.alias("rank"), "space_idx", "polygon"))
    probes = rows.select(*keys, "bridge_id", "side", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1", "len")], *[c.alias(n) for n, c in tiles.point("px", "py").items()]).where("len is not null")
    near = tiles.meet(probes, held, keys, _beside, ["rank", "space_idx", "space_id"])
    best = near.groupBy(*keys, "bridge_id", "side").agg(F.min(F.struct("rank", "space_idx", "space_id")).alias("b"))
    both = rows.select(*keys, "bridge_id", "side").join(best, [*keys, "bridge_id", "side"], "left")
    kind = F.when(F.col("b").isNull(), "exterior").when(F.col("b.rank") == 2, "filtered").otherwise("surviving")
    return both.select(*keys, "bridge_id", "side", kind.alias("kind"), F.when(kind == "surviving", F.col("b.space_id")).alias("space_id"))


def assemble_openings(bridges: DataFrame, sides: DataFrame, keys: list[str], floor: float = 0.0, ppm: float = 50.0) -> DataFrame:
    """One opening per bridge with its width, its box widened to the width on the thin axis, what it connects and confidence.

    With a floor area, bridges beside a filtered space or beside no surviving one are left out.
    """
    on = [*keys, "bridge_id"]
    pick = [F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{n}_{c}") for n, s in (("a", -1), ("b", 1)) for c in ("kind", "space_id")]
    rows = bridges.withColumn("width", F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).join(sides.groupBy(*on).agg(*pick), on)
    if floor > 0:
        kinds = F.array("a_kind", "b_kind")
        rows = rows.where(~F.array_contains(kinds, "filtered") & F.array_contains(kinds, "surviving"))

    def ends(c: str) -> tuple[Column, Column]:
        lo, hi, half = F.least(f"{c}0", f"{c}1"), F.greatest(f"{c}0", f"{c}1"), F.col("width") / 2
        thin, mid = hi - lo < F.col("width"), (lo + hi) / 2
        return F.when(thin, mid - half).otherwise(lo), F.when(thin, mid + half).otherwise(hi)

    (x0, x1), (y0, y1) = ends("x"), ends("y")
    sure = F.col("a_space_id").isNotNull() & F.col("b_space_id").isNotNull()
    confidence = F.when(sure, SURE).otherwise(UNSURE)
    box = F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")).alias("bbox")
    return rows.select(*on, (F.col("width") / ppm).alias("width_m"), box, F.struct(F.col("a_space_id").alias("a"), F.col("b_space_id").alias("b")).alias("connects"), confidence.alias("confidence"), (confidence < UNCERTAIN_BELOW).alias("uncertain"))


def layout_objects(entities: DataFrame, ppm: float = 50.0) -> tuple[DataFrame, DataFrame]:
    """Objects with base, height and assumption ids, and per assumption the number of objects and its runs.

    entities: run_id, source (sheet or primary), page_index, entity_type, entity_id, bbox, polygon, height_m, is_window.
    A run with rows of sheets uses only those. Each page has one slab under all its boxes; rooms and corridors also give
    a wall per edge. A measured height takes the place of the default one of an opening, without its assumption.
    """
    sheets = entities.where("source = 'sheet'").select("run_id").distinct()
    rows = entities.where("source = 'sheet'").unionByName(entities.where("source <> 'sheet'").join(sheets, "run_id", "left_anti"))
    page = ["run_id", "page_index"]
    kind = F.when((F.col("entity_type") == "Door") & F.coalesce("is_window", F.lit(False)), "window_opening")
    for entity, name in OBJECT_TYPES.items():
        kind = kind.when(F.col("entity_type") == entity, name)
    box = [(F.col(f"bbox.{c}") / ppm).alias(c) for c in ("x0", "y0", "x1", "y1")]
    known = rows.withColumn("object_type", kind).where("object_type is not null").select(*page, "entity_id", "object_type", *box, "polygon", F.when(F.col("object_type").endswith("opening") & (F.col("height_m") > 0), F.col("height_m")).alias("measured"))
    slab = known.groupBy(*page).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).select(*page, F.lit("slab").alias("entity_id"), F.lit("floor_slab").alias("object_type"), "x0", "y0", "x1", "y1")
    walls = polygon_edges(known.where(F.col("object_type").endswith("volume")), [*page, "entity_id"])
    walls = walls.select(*page, F.concat_ws("-", "entity_id", "edge").alias("entity_id"), F.lit("wall").alias("object_type"), *[(f(f"{a}0", f"{a}1") / ppm).alias(f"{a}{i}") for i, f in ((0, F.least), (1, F.greatest)) for a in ("x", "y")])
    objects = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [known.drop("polygon"), slab, walls])
    default, assumed = F.create_map(*[F.lit(v) for kv in HEIGHTS.items() for v in kv]), F.lit(None).cast("array<string>")
    for name, ids in ASSUMED.items():
        assumed = F.when(F.col("object_type") == name, F.array(*[F.lit(v) for v in ids]).cast("array<string>")).otherwise(assumed)
    assumed = F.when(F.col("measured").isNotNull(), F.filter(assumed, lambda v: ~v.endswith("OPENING-HEIGHT"))).otherwise(assumed)
    objects = objects.select(
        *page,
        F.concat(F.lit("page-"), F.col("page_index").cast("string"), F.lit("-"), F.replace("object_type", F.lit("_"), F.lit("-")), F.lit("-"), F.col("entity_id").cast("string")).alias("object_id"),
        "object_type", "x0", "y0", "x1", "y1",
        F.when(F.col("object_type") == "floor_slab", -HEIGHTS["floor_slab"]).otherwise(0.0).alias("z_base_m"),
        F.coalesce("measured", F.element_at(default, F.col("object_type"))).alias("height_m"),
        assumed.alias("assumption_ids"),
    )
    used = objects.select("run_id", F.explode("assumption_ids").alias("assumption_id")).groupBy("run_id", "assumption_id").agg(F.count("*").alias("n_objects"))
    return objects, used
