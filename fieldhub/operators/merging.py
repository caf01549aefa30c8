"""Merge boxes whose centres lie close together, transitively."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldhub import constants as K
from fieldhub.operators import components
from fieldhub.session import Scratch


def merge_boxes(
    dets: DataFrame, threshold_px: int = K.MERGE_DISTANCE_PX, tile: str = "tile"
) -> DataFrame:
    """One row per group of boxes linked by centre distances below the threshold.

    Centres in one cell of side threshold/√2 are always linked, so a whole cell is one graph
    node and only pairs of neighbouring cells are compared: a crowded spot adds nodes, not
    pairs.  Of two cells side by side only the facing edges matter, the last centre of each
    line of the one and the first of each line of the other, so a cell carries four short
    arrays of numbers however many centres it holds.
    """
    band = 2 * threshold_px  # half pixels
    # Largest whole side whose diagonal stays below the threshold.
    side = 1
    while 2 * side * side < band * band:
        side += 1
    side -= 1
    span = -(-band // side)  # cells that a link can bridge
    b = F.col("bbox_px")
    key = lambda v: F.floor(v / side).cast("bigint")
    hx, hy = b["x1"] + b["x2"], b["y1"] + b["y2"]
    boxes = dets.select(
        tile, "det_id", *[b[c].alias(c) for c in ("x1", "y1", "x2", "y2")],
        key(hx).alias("cx"), key(hy).alias("cy"),
        F.pmod(hx, F.lit(side)).alias("col"), F.pmod(hy, F.lit(side)).alias("row"),
    )
    line = lambda across, c, at: F.struct(F.lit(across).alias("across"), F.col(c).alias("line"), F.col(at).alias("at"))
    lines = (
        boxes.withColumn("l", F.explode(F.array(line(True, "row", "col"), line(False, "col", "row"))))
        .groupBy(tile, "cx", "cy", "l.across", "l.line").agg(
            F.min("l.at").alias("lo"), F.max("l.at").alias("hi"),
            F.min("det_id").alias("node"), F.count(F.lit(1)).alias("boxes"),
            F.sum((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("area_px"),
            F.min("x1").alias("x1"), F.min("y1").alias("y1"),
            F.max("x2").alias("x2"), F.max("y2").alias("y2"),
        )
    )
    # line and place in one number; at most ``side`` of them fit a cell
    edge = lambda end, across: F.collect_list(
        F.when(F.col("across") == across, F.col("line") * side + F.col(end)).cast("int"))
    total = lambda c: F.sum(F.when(F.col("across"), F.col(c)))
    per_cell = Scratch(dets.sparkSession, "cells").cut(lines.groupBy(tile, "cx", "cy").agg(
        F.min("node").alias("node"), total("boxes").alias("boxes"), total("area_px").alias("area_px"),
        F.min("x1").alias("x1"), F.min("y1").alias("y1"),
        F.max("x2").alias("x2"), F.max("y2").alias("y2"),
        edge("hi", True).alias("right"), edge("hi", False).alias("top"),
        edge("lo", True).alias("left"), edge("lo", False).alias("bottom"),
    ))
    least = lambda i: max(0, (abs(i) - 1) * side + 1)  # half pixels between cells i apart
    reach = F.array(*[
        F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy"))
        for i in range(0, span + 1)
        for j in range(-span, span + 1)
        if (i, j) > (0, 0) and least(i) ** 2 + least(j) ** 2 < band * band
    ])
    beside = F.col("dx") > 0
    left = per_cell.select(
        tile, F.col("node").alias("a"), "right", "top", "cx", "cy", F.inline(reach),
    ).select(
        tile, "a", F.when(beside, F.col("right")).otherwise(F.col("top")).alias("near"), "dx", "dy",
        (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"),
    )
    right = per_cell.select(tile, "cx", "cy", F.col("node").alias("b"), "left", "bottom")
    ahead = side * F.when(beside, F.col("dx")).otherwise(F.col("dy"))
    aside = side * F.when(beside, F.col("dy")).otherwise(F.lit(0))

    def close(p, q):
        gap = F.col("_ahead") + F.pmod(q, F.lit(side)) - F.pmod(p, F.lit(side))
        shift = F.col("_aside") + F.floor(q / side) - F.floor(p / side)
        return gap * gap + shift * shift < band * band

    # Arrays of repeated numbers are small in files and large in memory: never broadcast.
    links = (
        left.join(right.hint("merge"), [tile, "cx", "cy"])
        .select(
            "a", "b", "near", F.when(beside, F.col("left")).otherwise(F.col("bottom")).alias("far"),
            ahead.alias("_ahead"), aside.alias("_aside"),
        )
        .filter(F.exists("near", lambda p: F.exists("far", lambda q: close(p, q))))
        .select("a", "b")
    )
    return (
        components.label(per_cell, links, "node")
        .groupBy(F.col("component").alias("merged_id"))
        .agg(
            F.min(tile).alias(tile), F.sum("boxes").alias("boxes"),
            F.sum("area_px").alias("area_px"),
            F.min("x1").alias("x1"), F.min("y1").alias("y1"),
            F.max("x2").alias("x2"), F.max("y2").alias("y2"),
        )
    )
