"""Corridor bands between long wall chords.

Segments: page keys, x0, y0, x1, y1 and axis, as normalize_segments gives them. All sizes are in points.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planaudit.operators import tiles
from planaudit.operators.geometry import boxed, merge_intervals

# Tolerance of a level, shares of span, fill and overlap, crossing share and edge margin.
Y_TOL = 3.0
SPAN_FRAC, FILL_FRAC, OVERLAP_FRAC = 0.5, 0.5, 0.5
CROSS_FRAC, CROSS_MARGIN = 0.6, 20.0
#: Width of the columns in which bands and segments meet.
CROSS_CELL = 128.0


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The level (y) of each height of rows (group, yc, ...) in order of group and height.

    A height further than the tolerance above its group's last level opens one. Rows stream through; what is carried
    from one batch to the next is the group and its last level.
    """
    group, level = None, 0.0
    for batch in batches:
        groups, heights = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
        levels = np.empty(len(heights))
        at = 0
        while at < len(heights):
            stop = bisect.bisect_right(groups, groups[at], at)
            if groups[at] != group:
                group, level = groups[at], heights[at]
            while at < stop:
                ahead = at + int(np.searchsorted(heights[at:stop] - level, Y_TOL, "right"))
                levels[at:ahead] = level
                at = ahead
                if at < stop:
                    level = heights[at]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(levels)], names=[*batch.schema.names[1:], "y"])


def chords(segments: DataFrame, extents: DataFrame, keys: list[str], ids: list[str] | None = None, span_frac: float = SPAN_FRAC, fill_frac: float = FILL_FRAC, clip: bool = False) -> DataFrame:
    """Keys, ids, y, x_min, x_max and span of the levels of horizontal segments that are long and mostly covered.

    extents(keys, ids, lo, hi) gives the widths that the shares refer to: pages, or with clip host rooms, whose range
    then also cuts the segments. The distinct heights of a page or host stream through one task in order.
    """
    by = [*keys, *(ids or [])]
    rows = segments.where(F.abs(F.col("y0") - F.col("y1")) <= Y_TOL).select(*keys, ((F.col("y0") + F.col("y1")) / 2).alias("yc"), F.least("x0", "x1").alias("a"), F.greatest("x0", "x1").alias("b"))
    rows = rows.join(extents.select(*by, F.col("lo").alias("e0"), F.col("hi").alias("e1")), keys)
    if clip:
        rows = rows.withColumn("a", F.greatest("a", "e0")).withColumn("b", F.least("b", "e1")).where("b > a")
    heights = rows.select(F.to_json(F.struct(*by)).alias("_group"), "yc", *by).distinct().repartition("_group").sortWithinPartitions("_group", "yc")
    columns = [f"`{c}` {heights.schema[c].dataType.simpleString()}" for c in heights.columns[1:]]
    heights = heights.mapInArrow(_levels, ", ".join([*columns, "y double"]))
    merged = merge_intervals(rows.join(heights, [*by, "yc"]).select(*by, "y", "e0", "e1", "a", "b"), [*by, "y", "e0", "e1"], "a", "b")
    sums = merged.groupBy(*by, "y", "e0", "e1").agg(F.min("a").alias("x_min"), F.max("b").alias("x_max"), F.sum(F.col("b") - F.col("a")).alias("covered")).withColumn("span", F.col("x_max") - F.col("x_min"))
    long = (F.col("span") > 0) & (F.col("span") >= span_frac * (F.col("e1") - F.col("e0"))) & (F.col("covered") >= fill_frac * F.col("span"))
    return sums.where(long).select(*by, "y", "x_min", "x_max", "span")


def _hosts(middles: pa.Table, rooms: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Places of points and of the first room that each lies strictly in."""
    order = tiles.in_order(rooms, ["space_idx", "space_id"])
    at, held, rings = tiles.boxes(middles), tiles.boxes(rooms)[:, order], tiles.rings(rooms)
    rings = [rings[k] for k in order]
    shaped = np.array([r is not None for r in rings])

    def check(q: np.ndarray, i: np.ndarray) -> np.ndarray:
        x, y = at[0, q], at[1, q]
        ok = (x > held[0, i]) & (x < held[2, i]) & (y > held[1, i]) & (y < held[3, i])
        some = np.flatnonzero(ok & shaped[i])
        ok[some] = tiles.inside([rings[k] for k in i[some]], x[some], y[some], edge=False)
        return ok

    found = tiles.first_over(at, tiles.column(middles, "_page"), held, tiles.column(rooms, "_page")[order], check)
    hit = np.flatnonzero(found >= 0)
    return hit, order[found[hit]]


def band_candidates(chord: DataFrame, rooms: DataFrame, keys: list[str], width: tuple[float, float], remnant: float) -> DataFrame:
    """Bands between two chords a corridor's width apart whose middle lies strictly inside a room with space on both sides.

    rooms: keys, space_id, space_idx, polygon; the room with the smallest space_idx is the host. Chords meet through
    cells as high as the largest width.
    """
    lo, hi = width
    cell = F.floor(F.col("y") / hi)
    low = chord.select(*keys, F.explode(F.array(cell, cell + 1)).alias("c"), F.col("y").alias("y_lo"), F.col("x_min").alias("l0"), F.col("x_max").alias("l1"), F.col("span").alias("ls"))
    high = chord.select(*keys, cell.alias("c"), F.col("y").alias("y_hi"), F.col("x_min").alias("h0"), F.col("x_max").alias("h1"), F.col("span").alias("hs"))
    pairs = low.join(high, [*keys, "c"]).where((F.col("y_hi") - F.col("y_lo")).between(lo, hi))
    pairs = pairs.withColumn("x0", F.greatest("l0", "h0")).withColumn("x1", F.least("l1", "h1"))
    pairs = pairs.where((F.col("x1") > F.col("x0")) & (F.col("x1") - F.col("x0") >= OVERLAP_FRAC * F.greatest("ls", "hs")))
    pairs = pairs.withColumn("cx", (F.col("x0") + F.col("x1")) / 2).withColumn("cy", (F.col("y_lo") + F.col("y_hi")) / 2)
    band = [*keys, "x0", "x1", "y_lo", "y_hi"]
    middles = pairs.select(*band, *[c.alias(n) for n, c in tiles.point("cx", "cy").items()]).distinct()
    inside = tiles.meet(middles, boxed(rooms.select(*keys, "space_id", "space_idx", "polygon")), keys, _hosts, ["space_idx", "space_id", "_y0", "_y1"])
    found = inside.groupBy(*band).agg(F.min(F.struct("space_idx", "space_id", "_y0", "_y1")).alias("h"))
    roomy = (F.col("y_lo") - F.col("h._y0") >= remnant) & (F.col("h._y1") - F.col("y_hi") >= remnant)
    return found.where(roomy).select(*band, F.col("h.space_id").alias("host_id"))


def exclude_crossed(bands: DataFrame, segments: DataFrame, keys: list[str], margin: float = CROSS_MARGIN) -> DataFrame:
    """Bands that no vertical segment away from their ends covers for 60 % of the height.

    Bands and segments meet in columns of a page, CROSS_CELL wide.
    """
    band = [*keys, "x0", "x1", "y_lo", "y_hi"]
    walls = segments.where("axis = 'v'").select(*keys, ((F.col("x0") + F.col("x1")) / 2).alias("wx"), F.least("y0", "y1").alias("w0"), F.greatest("y0", "y1").alias("w1"))
    walls = walls.withColumn("c", F.floor(F.col("wx") / CROSS_CELL))
    left, right = F.col("x0") + margin, F.col("x1") - margin
    spread = bands.select(*band).distinct().where(right > left).withColumn("c", F.explode(F.sequence(F.floor(left / CROSS_CELL), F.floor(right / CROSS_CELL))))
    inner = (F.col("wx") > left) & (F.col("wx") < right)
    tall = F.least("w1", "y_hi") - F.greatest("w0", "y_lo") >= CROSS_FRAC * (F.col("y_hi") - F.col("y_lo"))
    crossed = spread.join(walls, [*keys, "c"]).where(inner & tall).select(*band).distinct()
    return bands.join(crossed, band, "left_anti")


def corridor_bands(bands: DataFrame, keys: list[str]) -> DataFrame:
    """The first band of each host by lower, then upper chord; a carved host takes no second one."""
    first = F.min(F.struct("y_lo", "y_hi", "x0", "x1")).alias("b")
    return bands.groupBy(*keys, "host_id").agg(first).select(*keys, "host_id", "b.*")
