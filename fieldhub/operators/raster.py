"""Raster work on pixel tables: demand, polygon masks, morphology, regions.

Masks travel as 64-pixel words: one row per (tile_id, row, block) holds the bits of 64
columns, so masks shuffle one row per 64 pixels and every overlap is a bitwise OR.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldhub import constants as K
from fieldhub.operators import components
from fieldhub.session import Scratch

WORD = 64
KEYS = ["tile_id", "row", "block"]


# --- demand --------------------------------------------------------------------
def _demand(position: int) -> Column:
    pairs = [F.lit(v) for code, *rates in K.CROP_DEMAND.values() for v in (code, rates[position])]
    return F.create_map(*pairs)


def crop_demand(code: Column) -> tuple[Column, Column]:
    """N and P2O5 demand (lbs/acre) of a land-cover code; 0 for other codes."""
    look = lambda i: F.coalesce(F.try_element_at(_demand(i), code), F.lit(0.0)).cast("float")
    return look(0), look(1)


def with_demand(pixels: DataFrame) -> DataFrame:
    n, p = crop_demand(F.col("code"))
    return pixels.withColumns({"n_demand": n, "p_demand": p})


def block_demand(blocks: DataFrame) -> DataFrame:
    """The same lookup on block rows (tile_id, row, col0, codes): arrays in, arrays out."""
    return blocks.withColumns({
        "n_demand": F.transform("codes", lambda c: crop_demand(c)[0]),
        "p_demand": F.transform("codes", lambda c: crop_demand(c)[1]),
    })


def to_blocks(pixels: DataFrame, width: int = WORD) -> DataFrame:
    """Pixel rows to block rows of at most ``width`` columns; a missing pixel is a null code."""
    col0 = (F.floor(F.col("col") / width) * width).cast("int")
    at = F.struct((F.col("col") - col0).alias("i"), F.col("code").alias("code"))
    grouped = pixels.groupBy("tile_id", "row", col0.alias("col0")).agg(
        F.map_from_entries(F.collect_list(at)).alias("_m"), F.max(F.col("col") - col0).alias("_n")
    )
    codes = F.transform(F.sequence(F.lit(0), F.col("_n")), lambda i: F.try_element_at(F.col("_m"), i))
    return grouped.select("tile_id", "row", "col0", codes.alias("codes"))


def profile(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("tile_id").agg(
        F.count(F.lit(1)).alias("pixels"),
        (F.max("row") + 1).alias("rows"),
        (F.max("col") + 1).alias("cols"),
        F.countDistinct("code").alias("codes"),
    )


def crop_acreage(pixels: DataFrame, west, south, east, north, grid, pixel_m2: float) -> DataFrame:
    """Acres per code among the pixels whose centre lies in a geographic box."""
    lon, lat = grid.lon(F.col("col")), grid.lat(F.col("row"))
    return (
        pixels.filter(lon.between(west, east) & lat.between(south, north))
        .groupBy("code")
        .agg(F.count(F.lit(1)).alias("pixels"))
        .withColumn("acres", F.round(F.col("pixels") * F.lit(pixel_m2 / K.SQ_M_PER_ACRE), 6))
    )


# --- polygon mask ----------------------------------------------------------------
def polygon_runs(polygons: DataFrame, rows: int, cols: int) -> DataFrame:
    """Scanline fill: (tile_id, polygon_id, row, col_start, col_end) of covered centres.

    Each edge goes to the rows whose centre line it crosses (half-open, so a shared vertex
    counts once); crossings pair up left to right.  Holes follow from even-odd pairing.
    ``rows``/``cols`` clip to the tile.
    """
    edges = polygons.select(
        "tile_id", "polygon_id", F.explode("rings").alias("ring")
    ).select(
        "tile_id", "polygon_id",
        F.explode(
            F.zip_with(
                F.slice("ring", F.lit(1), F.size("ring") - 1),
                F.slice("ring", F.lit(2), F.size("ring") - 1),
                lambda p, q: F.struct(
                    p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by")
                ),
            )
        ).alias("e"),
    ).select("tile_id", "polygon_id", "e.*")
    low = F.ceil(F.least("ay", "by") - 0.5)
    high = F.ceil(F.greatest("ay", "by") - 0.5) - 1
    spans = edges.withColumns({
        "_r0": F.greatest(low, F.lit(0)), "_r1": F.least(high, F.lit(rows - 1)),
    }).filter("_r1 >= _r0")
    crossed = spans.withColumn(
        "row", F.explode(F.sequence(F.col("_r0").cast("int"), F.col("_r1").cast("int")))
    )
    yc = F.col("row") + F.lit(0.5)
    at = F.col("ax") + (yc - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))
    line = Window.partitionBy("tile_id", "polygon_id", "row").orderBy("_x")
    paired = crossed.withColumn("_x", at).withColumns({
        "_i": F.row_number().over(line), "_next": F.lead("_x").over(line),
    }).filter(F.col("_i") % 2 == 1)
    return (
        paired.select(
            "tile_id", "polygon_id", "row",
            F.greatest(F.ceil(F.col("_x") - 0.5), F.lit(0)).cast("int").alias("col_start"),
            F.least(F.ceil(F.col("_next") - 0.5) - 1, F.lit(cols - 1)).cast("int").alias("col_end"),
        ).filter("col_end >= col_start")
    )


def _bits(start: Column, end: Column) -> Column:
    """Word with bits start..end (0..63) set."""
    n = end - start + 1
    ones = F.when(n == WORD, F.lit(-1).cast("bigint")).otherwise(
        F.call_function("shiftleft", F.lit(1).cast("bigint"), n) - 1
    )
    return F.call_function("shiftleft", ones, start)


def run_words(runs: DataFrame) -> DataFrame:
    """Runs to words: overlaps of any number of polygons merge into one OR per word."""
    first, last = F.floor(F.col("col_start") / WORD), F.floor(F.col("col_end") / WORD)
    cut = runs.withColumn("block", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    base = F.col("block") * WORD
    return (
        cut.withColumn(
            "_w",
            _bits(
                F.greatest(F.col("col_start") - base, F.lit(0)),
                F.least(F.col("col_end") - base, F.lit(WORD - 1)),
            ),
        )
        .groupBy(*KEYS)
        .agg(F.bit_or("_w").alias("mask"))
    )


def _block(col: Column) -> Column:
    return F.floor(col / WORD).cast("int")


def bit_at(word: Column, col: Column) -> Column:
    return F.getbit(word, (col % WORD).cast("int")) == 1


def with_setback(pixels: DataFrame, polygons: DataFrame, rows: int, cols: int) -> DataFrame:
    """Add ``masked``: is the pixel centre inside any polygon of its tile?

    One equi-join on (tile, row, block); a pixel meets at most one mask row.
    """
    words = run_words(polygon_runs(polygons, rows, cols))
    return (
        pixels.withColumn("block", _block(F.col("col")))
        .join(words, KEYS, "left")
        .withColumn("masked", F.coalesce(bit_at(F.col("mask"), F.col("col")), F.lit(False)))
        .drop("block", "mask")
    )


def demand_map(pixels: DataFrame, polygons: DataFrame | None, rows: int, cols: int) -> DataFrame:
    """Demand per pixel with demand 0 inside setbacks."""
    out = with_demand(pixels)
    if polygons is None:
        return out.withColumn("masked", F.lit(False))
    out = with_setback(out, polygons, rows, cols)
    zeroed = lambda c: F.when(F.col("masked"), F.lit(0.0).cast("float")).otherwise(F.col(c))
    return out.withColumns({"n_demand": zeroed("n_demand"), "p_demand": zeroed("p_demand")})


def block_demand_map(blocks: DataFrame, polygons: DataFrame, rows: int, cols: int) -> DataFrame:
    """The demand map on 64-column block rows.

    Large rasters are best stored this way: the join with the masks then moves two bytes per
    pixel instead of a whole row.
    """
    words = run_words(polygon_runs(polygons, rows, cols))
    met = blocks.withColumn("block", _block(F.col("col0"))).join(words, KEYS, "left")
    mask = F.coalesce("mask", F.lit(0).cast("bigint"))
    zero = F.lit(0.0).cast("float")
    kept = lambda which: F.transform(
        F.col("codes"),
        lambda c, i: F.when(F.getbit(F.col("_m"), i) == 1, zero).otherwise(crop_demand(c)[which]),
    )
    return met.withColumn("_m", mask).select(
        "tile_id", "row", "col0", "codes",
        kept(0).alias("n_demand"), kept(1).alias("p_demand"),
    )


def demand_stats(demand: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return demand.groupBy("tile_id").agg(
        n.alias("pixels"),
        F.min("n_demand").cast("double").alias("n_min"),
        F.max("n_demand").cast("double").alias("n_max"),
        F.min("p_demand").cast("double").alias("p_min"),
        F.max("p_demand").cast("double").alias("p_max"),
        F.count_if(F.col("n_demand") > 0).alias("n_positive"),
        F.count_if(F.col("p_demand") > 0).alias("p_positive"),
        F.count_if("masked").alias("masked_pixels"),
        F.round(F.count_if("masked") * 100.0 / n, 6).alias("masked_pct"),
    )


# --- colour predicates ---------------------------------------------------------------
def value_of(r: Column, g: Column, b: Column) -> Column:
    return F.greatest(r, g, b)


def saturation_of(r: Column, g: Column, b: Column) -> Column:
    """8-bit HSV saturation, rounded half up; 0 for black."""
    v = value_of(r, g, b)
    return F.when(v == 0, 0).otherwise(F.round((v - F.least(r, g, b)) * 255.0 / v).cast("int"))


def is_roof(r: Column, g: Column, b: Column) -> Column:
    return (value_of(r, g, b) > 140) & (saturation_of(r, g, b) < 60)


def is_water(r: Column, g: Column, b: Column) -> Column:
    v = value_of(r, g, b)
    return (g - r > 24) & (b - r > 18) & (v > 80) & (v < 235)


# --- morphology ------------------------------------------------------------------------
def pack(pixels: DataFrame, predicate: Column) -> DataFrame:
    """Pixels to words: ``mask`` holds the predicate, ``valid`` the pixels that exist."""
    bit = F.call_function(
        "shiftleft", F.lit(1).cast("bigint"), (F.col("col") % WORD).cast("int")
    )
    return pixels.groupBy("tile_id", "row", _block(F.col("col")).alias("block")).agg(
        F.bit_or(F.when(predicate, bit).otherwise(F.lit(0).cast("bigint"))).alias("mask"),
        F.bit_or(bit).alias("valid"),
    )


def unpack(words: DataFrame) -> DataFrame:
    """Words back to one row (tile_id, row, col) per set pixel."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.getbit(F.col("mask"), i) == 1)
    return words.filter("mask <> 0").select(
        "tile_id", "row", "block", F.explode(bits).alias("bit")
    ).select("tile_id", "row", (F.col("block") * WORD + F.col("bit")).alias("col"))


def _spread(m: Column, radius: int) -> tuple[Column, Column, Column]:
    """Horizontal dilation of a word: what lands in the left, own and right block."""
    own, left, right = m, F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    for s in range(1, radius + 1):
        own = own.bitwiseOR(F.shiftleft(m, s)).bitwiseOR(F.shiftrightunsigned(m, s))
        right = right.bitwiseOR(F.shiftrightunsigned(m, WORD - s))
        left = left.bitwiseOR(F.shiftleft(m, WORD - s))
    return left, own, right


def dilate(words: DataFrame, size: int, source: Column | None = None) -> DataFrame:
    """Square dilation; one aggregation, since all overlaps are ORs."""
    radius = size // 2
    left, own, right = _spread(F.col("mask") if source is None else source, radius)
    zero = F.lit(0).cast("bigint")
    out = [
        F.struct(
            F.lit(dr).alias("dr"), F.lit(db).alias("db"), bits.alias("bits"),
            (F.col("valid") if dr == 0 and db == 0 else zero).alias("valid"),
        )
        for dr in range(-radius, radius + 1)
        for db, bits in ((-1, left), (0, own), (1, right))
    ]
    sent = words.select("tile_id", "row", "block", F.explode(F.array(*out)).alias("c")).filter(
        "c.bits <> 0 or c.valid <> 0"
    )
    merged = sent.groupBy(
        "tile_id", (F.col("row") + F.col("c.dr")).alias("row"),
        (F.col("block") + F.col("c.db")).alias("block"),
    ).agg(F.bit_or("c.bits").alias("mask"), F.bit_or("c.valid").alias("valid"))
    return merged.filter("valid <> 0").select(
        *KEYS, F.col("mask").bitwiseAND(F.col("valid")).alias("mask"), "valid"
    )


def erode(words: DataFrame, size: int) -> DataFrame:
    """Square erosion; pixels beyond the tile edge do not erode."""
    gaps = F.bitwise_not(F.col("mask")).bitwiseAND(F.col("valid"))
    grown = dilate(words, size, source=gaps)
    return grown.withColumn("mask", F.bitwise_not(F.col("mask")).bitwiseAND(F.col("valid")))


def close_mask(words: DataFrame, size: int) -> DataFrame:
    return erode(dilate(words, size), size)


def open_mask(words: DataFrame, size: int) -> DataFrame:
    return dilate(erode(words, size), size)


# --- regions ---------------------------------------------------------------------------
BAND_ROWS = 64  # rows of a tile whose runs are joined up in one window


def mask_runs(words: DataFrame, band_rows: int = BAND_ROWS) -> DataFrame:
    """Maximal horizontal runs of set pixels; ``run`` is (tile, row, first column).

    Runs are read off each word (at most 32) and joined up where they meet at a word edge,
    so the window sees runs, never single pixels.
    """
    m = F.col("mask")
    starts = m.bitwiseAND(F.bitwise_not(F.shiftleft(m, 1)))
    ends = m.bitwiseAND(F.bitwise_not(F.shiftrightunsigned(m, 1)))
    bits = lambda w: F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.getbit(w, i) == 1)
    pieces = words.filter("mask <> 0").select(
        "tile_id", "row", "block",
        F.explode(F.arrays_zip(bits(starts).alias("s"), bits(ends).alias("e"))).alias("p"),
    ).select(
        "tile_id", F.floor(F.col("row") / band_rows).cast("int").alias("band"), "row",
        (F.col("block") * WORD + F.col("p.s")).alias("col_start"),
        (F.col("block") * WORD + F.col("p.e")).alias("col_end"),
    )
    line = Window.partitionBy("tile_id", "band").orderBy("row", "col_start")
    before = lambda c: F.lag(c).over(line)
    joined = (F.col("row") == before("row")) & (F.col("col_start") == before("col_end") + 1)
    runs = (
        pieces.withColumn("_new", F.when(joined, 0).otherwise(1))
        .withColumn("_i", F.sum("_new").over(line))
        .groupBy("tile_id", "band", "row", "_i")
        .agg(F.min("col_start").alias("col_start"), F.max("col_end").alias("col_end"))
        .drop("_i")
    )
    return runs.withColumn("run", F.struct("tile_id", "row", "col_start"))


def _touching_runs(runs: DataFrame) -> DataFrame:
    """Runs of neighbouring rows that touch, diagonals included.

    Runs are spread over 64-column blocks first; a block row has at most 32 runs, which
    bounds the pairs looked at on any one key.
    """
    blocks = lambda lo, hi: F.explode(F.sequence(F.floor(lo / WORD), F.floor(hi / WORD)))
    up = runs.select(
        "tile_id", (F.col("row") + 1).alias("row"), F.col("run").alias("a"),
        F.col("col_start").alias("a0"), F.col("col_end").alias("a1"),
        blocks(F.col("col_start") - 1, F.col("col_end") + 1).alias("block"),
    )
    low = runs.select(
        "tile_id", "row", F.col("run").alias("b"), F.col("col_start").alias("b0"),
        F.col("col_end").alias("b1"), blocks(F.col("col_start"), F.col("col_end")).alias("block"),
    )
    return up.join(low, KEYS).filter("a0 <= b1 + 1 and b0 <= a1 + 1").select("a", "b")


def regions(words: DataFrame, band_rows: int = BAND_ROWS) -> DataFrame:
    """8-connected regions of a mask: first pixel, area and extent.

    Runs that touch are linked, and components joins them; a run is named by its place, so
    tiles, rows and columns may be any numbers.
    """
    runs = Scratch(words.sparkSession, "runs").cut(mask_runs(words, band_rows))
    labelled = components.label(runs, _touching_runs(runs), "run")
    return labelled.groupBy(F.col("component").alias("region")).agg(
        F.min("row").alias("row_min"), F.max("row").alias("row_max"),
        F.min("col_start").alias("col_min"), F.max("col_end").alias("col_max"),
        F.sum(F.col("col_end") - F.col("col_start") + 1).alias("area_px"),
    ).select(
        "region.tile_id", F.col("region.row").alias("first_row"), F.col("region.col_start").alias("first_col"),
        "row_min", "row_max", "col_min", "col_max", "area_px",
    )


def extents(pixels: DataFrame, *key: str) -> DataFrame:
    """Pixel count and bounding box per mask."""
    return pixels.groupBy(*key).agg(
        F.count(F.lit(1)).alias("area_px"),
        F.min("row").alias("row_min"), F.max("row").alias("row_max"),
        F.min("col").alias("col_min"), F.max("col").alias("col_max"),
    )


def large_masks(masks: DataFrame, min_px: int = K.MIN_MASK_PX) -> DataFrame:
    return masks.filter(F.col("area_px") >= min_px)
