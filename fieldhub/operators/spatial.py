"""Spatial joins on grid-cell keys: point in box, nearest within a radius, close pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldhub.functions import geo
from fieldhub.session import Scratch


def cell(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(float(size))).cast("bigint")


def covered(low: Column, high: Column, size: float) -> Column:
    """All cell numbers that an interval touches."""
    return F.sequence(cell(low, size), cell(high, size))


def points_in_boxes(points: DataFrame, boxes: DataFrame, x: str, y: str, cell: float) -> DataFrame:
    """Pairs of a point and a box (west, south, east, north) that holds it, edges included.

    Boxes are spread over the cells they touch and points sit in one cell, so the join is
    an equi-join; with ``cell`` near the box size, few non-matching pairs are looked at.
    """
    size = cell
    key = lambda v: F.floor(v / F.lit(float(size))).cast("bigint")
    b = boxes.withColumn("_cx", F.explode(covered(F.col("west"), F.col("east"), size)))
    b = b.withColumn("_cy", F.explode(covered(F.col("south"), F.col("north"), size)))
    p = points.withColumns({"_cx": key(F.col(x)), "_cy": key(F.col(y))})
    return (
        p.join(b, ["_cx", "_cy"])
        .filter(F.col(x).between(F.col("west"), F.col("east")))
        .filter(F.col(y).between(F.col("south"), F.col("north")))
        .drop("_cx", "_cy")
    )


# --- nearest -------------------------------------------------------------------
FAN = 16  # each refinement splits a cell into FAN x FAN children
MAX_LEVELS = 4
REACHES = (1 / 16, 1 / 4, 1)  # parts of the radius that are looked through one after the other
SLACK = 1e-9  # part of the reach by which bounds of distances may differ from distances, by rounding
MOST_SPOTS = 500_000  # distinct locations that are broadcast (some 50 MB), more are joined


def _ring_extent(polys: DataFrame, ring: str) -> DataFrame:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return polys.withColumns({
        "_x0": F.array_min(xs), "_x1": F.array_max(xs),
        "_y0": F.array_min(ys), "_y1": F.array_max(ys),
        "_vx": F.element_at(xs, 1), "_vy": F.element_at(ys, 1),
    })


def _crowding(sites: DataFrame, size: float) -> int:
    """Largest number of distinct sites in one cell."""
    per_cell = sites.groupBy(cell(F.col("_px"), size), cell(F.col("_py"), size)).count()
    return per_cell.agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]


def _levels(sites: DataFrame, size: float, limit: int) -> int:
    """How often the grid is refined until no cell holds more than ``limit`` sites."""
    level = 0
    while level < MAX_LEVELS and _crowding(sites, size / FAN**level) > limit:
        level += 1
    return level


def _candidates(polys: DataFrame, sites: DataFrame, size: float, reach: float, levels: int, few: bool) -> DataFrame:
    """(polygon columns, site columns) pairs that include every nearest site within ``reach``.

    Sparse data joins on cells of ``size``.  Where cells are crowded the grid is refined
    ``levels`` times: a polygon meets the occupied child cells (at most FAN² per parent,
    however crowded they are), and keeps only those whose lower distance bound does not
    exceed its best upper bound.  Only the sites of the surviving smallest cells are then
    paired up, so a crowded spot never yields all its pairs.  ``few`` sites are broadcast:
    then no pair leaves its task.  Bounds have room for rounding: a pair exactly ``reach`` apart, or exactly
    as near as another, is among the pairs, and the measured distance decides.
    """
    slack = float(reach) * SLACK
    reach = F.lit(float(reach) + slack)
    gap = lambda lo, hi, s0, s1: F.greatest(
        F.lit(0.0), F.col(s0) - F.col(hi), F.col(lo) - F.col(s1)
    )
    near = (
        polys.withColumn("_cx", F.explode(covered(F.col("_x0") - reach, F.col("_x1") + reach, size)))
        .withColumn("_cy", F.explode(covered(F.col("_y0") - reach, F.col("_y1") + reach, size)))
    )
    if levels:  # the edges are long rows, they meet the surviving cells
        near = near.drop("_edges")
    size = float(size)
    for _ in range(levels):
        child = size / FAN
        children = sites.groupBy(
            cell(F.col("_px"), child).alias("_kx"), cell(F.col("_py"), child).alias("_ky")
        ).agg(
            F.min("_px").alias("_sx0"), F.max("_px").alias("_sx1"),
            F.min("_py").alias("_sy0"), F.max("_py").alias("_sy1"),
        ).withColumns({
            # children of a cell by integer division keep both grids aligned
            "_cx": F.floor(F.col("_kx") / FAN).cast("bigint"),
            "_cy": F.floor(F.col("_ky") / FAN).cast("bigint"),
        })
        gx, gy = gap("_x0", "_x1", "_sx0", "_sx1"), gap("_y0", "_y1", "_sy0", "_sy1")
        far = lambda v, s0, s1: F.greatest(F.abs(v - F.col(s0)), F.abs(v - F.col(s1)))
        fx, fy = far(F.col("_vx"), "_sx0", "_sx1"), far(F.col("_vy"), "_sy0", "_sy1")
        best = Window.partitionBy("_pid")
        near = (
            near.join(children, ["_cx", "_cy"])
            .withColumns({"_lb": F.sqrt(gx * gx + gy * gy), "_ub": F.sqrt(fx * fx + fy * fy)})
            .withColumn("_cap", F.least(F.min("_ub").over(best) + F.lit(slack), reach))
            .filter(F.col("_lb") <= F.col("_cap"))
            .withColumns({"_cx": F.col("_kx"), "_cy": F.col("_ky")})
            .drop("_kx", "_ky", "_sx0", "_sx1", "_sy0", "_sy1", "_lb", "_ub", "_cap")
        )
        size = child
    # Cell numbers of level L are floor(floor(v/child)/FAN), so derive them the same way here.
    keyed = sites.withColumns({"_cx": cell(F.col("_px"), size), "_cy": cell(F.col("_py"), size)})
    gx, gy = gap("_x0", "_x1", "_px", "_px"), gap("_y0", "_y1", "_py", "_py")
    met = near.join(F.broadcast(keyed) if few else keyed, ["_cx", "_cy"]).filter(gx * gx + gy * gy <= reach * reach)
    return met.join(polys.select("_pid", "_edges"), "_pid") if levels else met


def nearest_within(
    polys: DataFrame,
    points: DataFrame,
    radius: float,
    poly_id: str = "polygon_id",
    ring: str | Column = "ring",
    x: str = "x",
    y: str = "y",
    tie_break: str = "permit_id",
    ties: bool = False,
    crowd_limit: int = 2048,
) -> DataFrame:
    """Left join of each polygon to its nearest point within ``radius`` (planar metres).

    ``ring`` names the planar ring column or is an expression for it.

    Adds the point's columns and ``join_distance_m``; a polygon without a point in reach
    keeps nulls.  Of equally near points the one with the smallest ``tie_break`` is taken and
    ``join_ties`` says how many there are, so the result has one row per polygon.  With
    ``ties`` every one of them is a row: on a crowded spot that is polygons times points.
    Distances are measured to distinct locations only, so any number of points on one spot
    costs one comparison.
    """
    scratch = Scratch(polys.sparkSession, "nearest", keep=3 * len(REACHES))
    located = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    rest = [c for c in points.columns if c not in (x, y, tie_break)]
    spots = scratch.cut(
        located.groupBy(F.col(x).alias("_px"), F.col(y).alias("_py"))
        .agg(F.min(F.struct(tie_break, *rest)).alias("_first"), F.count(F.lit(1)).alias("_same"))
        .withColumn("_no", F.monotonically_increasing_id())
    )
    sites = spots.select("_no", "_px", "_py", F.col(f"_first.{tie_break}").alias("_tie"), "_same")
    few, levels = spots.count() <= MOST_SPOTS, _levels(sites, radius, crowd_limit)
    # Partitioning on the id up front lets a polygon's pairs meet without another shuffle and
    # spreads the geometry work, however few files the input has.
    ring = F.col(ring) if isinstance(ring, str) else ring
    shapes = _ring_extent(
        polys.select(F.col(poly_id).alias("_pid"), ring.alias("_ring")).repartition("_pid"), "_ring"
    ).withColumn("_edges", geo.measured_edges(F.col("_ring"))).drop("_ring")
    # What lies within a short reach of a polygon decides it, and only what finds nothing looks
    # farther: where points are dense a polygon meets few of all those within the radius.
    hits, todo = None, None
    for part in REACHES:
        reach = radius * part
        open_ = shapes if todo is None else shapes.join(todo, "_pid", "left_semi")
        pairs = _candidates(open_, sites, radius, reach, levels, few).select(
            "_pid", "_no", "_tie", "_same",
            geo.edges_point_distance(F.col("_edges"), F.col("_px"), F.col("_py")).alias("_d"),
        )
        if ties:
            best = pairs.withColumn("_best", F.min("_d").over(Window.partitionBy("_pid")))
            best = best.filter("_d = _best").select("_pid", "_d", "_no")
        else:  # sums and minima of plain numbers: a polygon's pairs are never sorted
            best = (
                pairs.groupBy("_pid", "_d").agg(
                    F.sum("_same").alias("join_ties"), F.min("_tie").alias("_tie"),
                    F.coalesce(F.min_by("_no", "_tie"), F.min("_no")).alias("_no"),
                )
                .groupBy("_pid").agg(
                    F.min("_d").alias("_d"), F.min_by("_no", "_d").alias("_no"),
                    F.min_by("join_ties", "_d").alias("join_ties"),
                )
            )
        found = scratch.cut(best.filter(F.col("_d") <= reach))
        hits = found if hits is None else hits.unionByName(found)
        if part != REACHES[-1]:
            ids = polys.select(F.col(poly_id).alias("_pid")) if todo is None else todo
            todo = scratch.cut(ids.join(found, "_pid", "left_anti").distinct())
            if todo.isEmpty():
                break
    hits = hits.withColumnRenamed("_d", "join_distance_m")
    place = [F.col("_px").alias(x), F.col("_py").alias(y)]
    if ties:
        named = spots.select("_no", *place).join(located, [x, y]).select("_no", *points.columns)
    else:
        named = spots.select("_no", *place, "_first.*")
        hits = hits.join(named, "_no").drop("_no")
    matched = polys.join(hits, F.col(poly_id) == F.col("_pid"), "left").drop("_pid")
    if ties:
        return matched.join(named, "_no", "left").drop("_no")
    counted = F.coalesce("join_ties", F.lit(0)).cast("bigint")
    return matched.select(
        *polys.columns, "join_distance_m", x, y, tie_break, *rest, counted.alias("join_ties"))


# --- close pairs of boxes on one tile -----------------------------------------------
def box_centers(dets: DataFrame, tile: str = "tile") -> DataFrame:
    """Distinct centres per tile in half pixels (exact integers) with their box count."""
    b = F.col("bbox_px")
    return dets.groupBy(
        F.col(tile), (b["x1"] + b["x2"]).alias("hx"), (b["y1"] + b["y2"]).alias("hy")
    ).agg(F.count(F.lit(1)).alias("n"))


def close_centers(centers: DataFrame, threshold_px: int, tile: str = "tile") -> DataFrame:
    """Pairs of distinct centres closer than the threshold, each pair once.

    Boxes that share a centre are one entry with a count, and a cell can hold only
    (2·threshold)² distinct half-pixel centres, so a crowded tile cannot explode.
    """
    band = 2 * threshold_px
    key = lambda v: F.floor(v / band).cast("int")
    side = centers.withColumns({"_cx": key(F.col("hx")), "_cy": key(F.col("hy"))})
    a = side.select(
        tile, F.col("hx").alias("ax"), F.col("hy").alias("ay"), F.col("n").alias("n_a"),
        F.explode(F.sequence(F.col("_cx"), F.col("_cx") + 1)).alias("_cx"), "_cy",
    ).select(
        "*", F.explode(F.sequence(F.col("_cy") - 1, F.col("_cy") + 1)).alias("_ny")
    ).drop("_cy").withColumnRenamed("_ny", "_cy")
    b = side.select(
        tile, F.col("hx").alias("bx"), F.col("hy").alias("by"), F.col("n").alias("n_b"),
        "_cx", "_cy",
    )
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    ordered = (dx > 0) | ((dx == 0) & (dy > 0))
    return (
        a.join(b, [tile, "_cx", "_cy"])
        .filter(ordered & (dx * dx + dy * dy < band * band))
        .drop("_cx", "_cy")
    )
