"""Nearest line without a search radius: a descent through a grid of cell summaries.

Segments belong to the cell of their midpoint.  A cell knows the box around its segments and
one point on them: the box bounds the distance of all of them from below, the point that of
the nearest from above.  Every point starts at the whole grid and goes down one level at a
time, keeping the cells whose lower bound does not exceed its best upper bound.  Rows are
points times the few cells that survive; no point meets the segments of other cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAN = 4  # children of a cell by side
DEPTH = 12  # levels at most: 4^12 cells by side
CROWD = 64  # segments of a cell that points are compared with one by one
BROADCAST_LEVELS = 4  # a level has at most FAN^(2 * level) rows: 65,536 here
PIECES = 256  # longer segments than this part of the grid are cut for the summaries


def segments_of(lines: DataFrame, line_id: str, path: str) -> DataFrame:
    """(line_id, ax, ay, bx, by): the segments of paths given as ``array<struct<x, y>>``.

    A path of one vertex is a segment without length; null and empty paths have none.
    """
    whole = F.col(path)
    later = F.when(F.size(whole) > 1, F.slice(whole, 2, F.size(whole) - 1)).otherwise(whole)
    pairs = F.arrays_zip(F.slice(whole, 1, F.size(later)).alias("a"), later.alias("b"))
    known = lines.filter(F.size(whole) > 0).select(F.col(line_id).alias("line_id"), F.explode(pairs).alias("s"))
    return known.select(
        "line_id", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"),
        F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"))


def segment_distance(x: Column, y: Column) -> Column:
    """Distance from a point to the segment (ax, ay)-(bx, by) of the row."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    along = F.try_divide((x - F.col("ax")) * dx + (y - F.col("ay")) * dy, dx * dx + dy * dy)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(along, F.lit(0.0))))
    ex, ey = x - (F.col("ax") + t * dx), y - (F.col("ay") + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def _length(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def _gap(x: Column, y: Column, x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """Distance from a point to a box."""
    zero = F.lit(0.0)
    return _length(F.greatest(zero, x0 - x, x - x1), F.greatest(zero, y0 - y, y - y1))


def _pieces(segments: DataFrame, side: float) -> DataFrame:
    """Long segments once per piece: (px0, py0)-(px1, py1) beside the whole segment."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    n = F.greatest(F.lit(1), F.ceil(F.sqrt(dx * dx + dy * dy) * PIECES / F.lit(side)).cast("int"))
    cut = segments.withColumn("_n", n).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    at = lambda a, d, k: F.col(a) + d * k / F.col("_n")
    return cut.select(
        *segments.columns, at("ax", dx, F.col("_k")).alias("px0"), at("ay", dy, F.col("_k")).alias("py0"),
        at("ax", dx, F.col("_k") + 1).alias("px1"), at("ay", dy, F.col("_k") + 1).alias("py1"))


def _up(levels: int) -> list[Column]:
    """The cell ``levels`` above (cx, cy)."""
    by = F.lit(FAN**levels)
    return [F.floor(F.col(c) / by).cast("bigint").alias(c) for c in ("cx", "cy")]


def _depth(celled: DataFrame, crowd: int) -> int:
    """The first level on which no cell holds more than ``crowd`` pieces, in one pass."""
    levels = F.explode(F.sequence(F.lit(1), F.lit(DEPTH))).alias("level")
    by = F.pow(F.lit(float(FAN)), DEPTH - F.col("level"))
    per_cell = celled.select("cx", "cy", levels).groupBy(
        "level", F.floor(F.col("cx") / by).alias("x"), F.floor(F.col("cy") / by).alias("y")).count()
    most = {r["level"]: r["most"] for r in per_cell.groupBy("level").agg(F.max("count").alias("most")).collect()}
    return next((level for level in range(1, DEPTH) if most.get(level, 0) <= crowd), DEPTH)


def nearest_line(
    points: DataFrame, segments: DataFrame, point_id: str = "permit_id", x: str = "x", y: str = "y",
    line_id: str = "line_id", crowd: int = CROWD,
) -> DataFrame:
    """``points`` with ``line_id`` and ``line_distance_m`` of the nearest segment.

    ``segments`` has (line_id, ax, ay, bx, by) in the points' planar unit; of equally near
    lines the lowest id counts.  Points without a location, and all points where there is no
    segment, keep nulls; segments with a null coordinate are left out.  ``point_id`` names a point.
    """
    known = segments.select(F.col(line_id).alias("_line"), "ax", "ay", "bx", "by").dropna(
        subset=["ax", "ay", "bx", "by"]).distinct()
    box = known.agg(
        F.min(F.least("ax", "bx")).alias("x0"), F.min(F.least("ay", "by")).alias("y0"),
        F.max(F.greatest("ax", "bx")).alias("x1"), F.max(F.greatest("ay", "by")).alias("y1")).first()
    if box["x0"] is None:
        kind = segments.schema[line_id].dataType
        return points.withColumns({"line_id": F.lit(None).cast(kind), "line_distance_m": F.lit(None).cast("double")})
    side = max(box["x1"] - box["x0"], box["y1"] - box["y0"], 1e-9)
    last = FAN**DEPTH - 1
    index = lambda a, b, low: F.least(F.lit(last), F.floor(
        ((F.col(a) + F.col(b)) / 2 - F.lit(low)) / F.lit(side) * (last + 1)).cast("bigint"))
    celled = _pieces(known, side).withColumns(
        {"cx": index("px0", "px1", box["x0"]), "cy": index("py0", "py1", box["y0"])})
    depth = _depth(celled, crowd)
    celled = celled.select("_line", "ax", "ay", "bx", "by", "px0", "py0", "px1", "py1", *_up(DEPTH - depth))

    px, py = F.col("_x"), F.col("_y")
    summary = celled.groupBy("cx", "cy").agg(
        F.min(F.least("px0", "px1")).alias("x0"), F.min(F.least("py0", "py1")).alias("y0"),
        F.max(F.greatest("px0", "px1")).alias("x1"), F.max(F.greatest("py0", "py1")).alias("y1"),
        F.min(F.struct("px0", "py0")).alias("on"))

    def cells(level: int) -> DataFrame:
        return summary.groupBy(*_up(depth - level)).agg(
            *(F.min(c).alias(c) for c in ("x0", "y0")), *(F.max(c).alias(c) for c in ("x1", "y1")), F.min("on").alias("on"))

    tops = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in (
        ("cx", r["cx"]), ("cy", r["cy"]), ("x0", r["x0"]), ("y0", r["y0"]), ("x1", r["x1"]), ("y1", r["y1"]),
        ("ox", r["on"]["px0"]), ("oy", r["on"]["py0"])))) for r in cells(1).collect()))  # FAN^2 rows at most
    slack = lambda best: best * (1 + 1e-9) + 1e-9
    spots = points.select(F.col(x).alias("_x"), F.col(y).alias("_y")).dropna().distinct()
    rated = spots.withColumn("_tops", F.transform(tops, lambda c: F.struct(
        c["cx"].alias("cx"), c["cy"].alias("cy"), _gap(px, py, c["x0"], c["x1"], c["y0"], c["y1"]).alias("low"),
        _length(px - c["ox"], py - c["oy"]).alias("high"))))
    best = F.array_min(F.transform("_tops", lambda c: c["high"]))
    near = rated.select("_x", "_y", F.explode(F.filter("_tops", lambda c: c["low"] <= slack(best))).alias("c")).select(
        "_x", "_y", "c.cx", "c.cy")
    own = Window.partitionBy("_x", "_y")
    for level in range(2, depth + 1):
        children = cells(level).withColumnsRenamed({"cx": "kx", "cy": "ky"}).withColumns({
            "cx": F.floor(F.col("kx") / FAN).cast("bigint"), "cy": F.floor(F.col("ky") / FAN).cast("bigint")})
        if level <= BROADCAST_LEVELS:
            children = F.broadcast(children)
        met = near.join(children, ["cx", "cy"]).select(
            "_x", "_y", "kx", "ky", _gap(px, py, F.col("x0"), F.col("x1"), F.col("y0"), F.col("y1")).alias("low"),
            _length(px - F.col("on.px0"), py - F.col("on.py0")).alias("high"))
        kept = met.withColumn("best", F.min("high").over(own)).filter(F.col("low") <= slack(F.col("best")))
        near = kept.select("_x", "_y", F.col("kx").alias("cx"), F.col("ky").alias("cy"))
    compared = near.join(celled.select("_line", "ax", "ay", "bx", "by", "cx", "cy").distinct(), ["cx", "cy"])
    best = compared.groupBy("_x", "_y").agg(
        F.min(F.struct(segment_distance(px, py).alias("d"), F.col("_line").alias("l"))).alias("_best"))
    out = points.join(best, (points[x] == best["_x"]) & (points[y] == best["_y"]), "left")
    return out.select(*points.columns, F.col("_best.l").alias("line_id"), F.col("_best.d").alias("line_distance_m"))
