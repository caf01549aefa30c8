"""Domain tables derived from the driver's parquet tables (see FIXTURES.md).

Every function takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the whole
source table; ``views.py`` holds the same definitions as SQL text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldhub.functions import geo

COUNTIES = [
    "Worcester", "Wicomico", "Caroline", "Somerset", "Queen Anne's", "Dorchester",
    "Cecil", "Kent", "Talbot", "Carroll",
]
STATUSES = [
    "Registered", "Pending", "Notice of Preliminary Approval", "Issued",
    "Administratively Extended", "Closed",
]
DESIGNATIONS = [" cafo ", "Mafo", "MAFO "]
RASTER_CODES = [1, 5, 24, 21, 4, 36, 37, 42, 0, 111]
PIXEL = 0.0003
WEST, NORTH, TILE_STEP = -76.5, 39.0, 0.03
TILE_PX = 1000
SCENARIOS = [8, 10, 12, 15]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def _headcount() -> Column:
    cents = F.round(F.col("c_acctbal") * 100).cast("bigint")
    return F.greatest(F.lit(0).cast("bigint"), F.floor(cents * 2 / 5).cast("bigint"))


def _lon(k: Column, mult: int) -> Column:
    return F.lit(-76.50) + (k * mult % 1460) / F.lit(1000.0)


def _lat(k: Column, mult: int) -> Column:
    return F.lit(37.91) + (k * mult % 1810) / F.lit(1000.0)


def permit(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    animal = (
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", "Broiler Chicken")
        .when(F.col("c_mktsegment") == "BUILDING", "  TURKEY ")
        .when(F.col("c_mktsegment") == "FURNITURE", "dairy")
        .when(F.col("c_mktsegment") == "HOUSEHOLD", "hog")
        .when(F.col("c_mktsegment") == "MACHINERY", "chickens_not_laying_hens")
    )
    return read(spark, sf_dir, "customer").select(
        k.alias("permit_id"),
        F.concat(F.lit("  "), F.col("c_name"), F.lit(" ")).alias("farm_name"),
        pick(DESIGNATIONS, k % 3).alias("designation"),
        animal.alias("animal_type"),
        _headcount().alias("headcount"),
        pick(STATUSES, k % 6).alias("status"),
        pick(COUNTIES, F.col("c_nationkey") % 10).alias("county"),
        F.concat(
            F.lit("City"), (k % 40).cast("string"), F.lit(", MD "),
            (k % 90 + 21600).cast("string"),
        ).alias("city_state_zip"),
        F.when(k % 11 == 0, "").when(k % 13 == 0, "unknown")
        .otherwise(F.concat(k.cast("string"), F.lit(" Main St"))).alias("address"),
        F.when(k % 5 == 0, None).when(k % 97 == 0, -75.80).otherwise(_lon(k, 7919))
        .alias("longitude"),
        F.when(k % 5 == 0, None).when(k % 97 == 0, 38.80).otherwise(_lat(k, 104729))
        .alias("latitude"),
    )


def raw_registry(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    """The permit table as an all-text download, before any cleaning.

    ``wide`` gives the variant with one count column per animal and no headcount column.
    """
    p = permit(spark, sf_dir)
    k, h = F.col("permit_id"), F.col("headcount")
    text = lambda c: c.cast("string")
    columns = [
        text(k).alias("Permit ID"),
        F.col("farm_name").alias("Farm Name"),
        F.col("designation").alias("Farm Designation"),
        F.concat(F.lit(" "), F.col("status"), F.lit(" ")).alias("Status"),
        F.col("county").alias("Farm County"),
        F.col("city_state_zip").alias("City State Zip"),
        F.col("address").alias("Address"),
        text(F.col("longitude")).alias("Longitude"),
        text(F.col("latitude")).alias("Latitude"),
    ]
    if wide:
        columns += [
            text(h % 1000).alias("Laying Hens"),
            text(F.floor(h / 7) % 1000).alias("Dairy Cattle"),
            text(F.floor(h / 13) % 1000).alias("Ducks"),
            text(k).alias("Cattle Building Acres"),
        ]
    else:
        columns += [
            F.col("animal_type").alias("Primary Animal Type"),
            F.when(k % 17 == 0, "n/a").when(k % 19 == 0, None)
            .when(k % 23 == 0, F.concat(text(h), F.lit(".75"))).otherwise(text(h))
            .alias("Number of Animals"),
        ]
    return p.select(*columns)


def candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(
        k.alias("site_id"),
        _lon(k, 6151).alias("longitude"),
        _lat(k, 15487).alias("latitude"),
    )


def waterway(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line of three vertices (degrees) per supplier; every eleventh stays on one spot."""
    k = F.col("s_suppkey")
    lon, lat = _lon(k, 7393), _lat(k, 19919)
    step = F.when(k % 11 == 0, 0.0).otherwise(1.0)
    east, north = step * (k % 7 - 3) / 100.0, step * (k % 5 - 2) / 125.0
    return read(spark, sf_dir, "supplier").select(
        k.alias("line_id"),
        F.array(geo.point(lon, lat), geo.point(lon + east, lat + north), geo.point(lon + 2 * east, lat + 0.5 * north)).alias("path"),
    )


def _grid_keys() -> list[Column]:
    k = F.col("o_orderkey")
    return [
        F.floor(k / 10000).cast("int").alias("tile_id"),
        F.floor(k % 10000 / 100).cast("int").alias("row"),
        (k % 100).cast("int").alias("col"),
    ]


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = read(spark, sf_dir, "orders").select("o_orderkey", *_grid_keys())
    idx = (F.floor(F.col("row") / 4) + F.floor(F.col("col") / 6) + F.col("tile_id")) % 10
    return g.select("tile_id", "row", "col", pick(RASTER_CODES, idx).alias("code"))


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = read(spark, sf_dir, "orders").select("o_orderkey", *_grid_keys())
    k = F.col("o_orderkey")
    j = (F.floor(F.col("row") / 6) * 7 + F.floor(F.col("col") / 9) * 11) % 3
    band = lambda roof, water, field: (
        F.when(j == 0, roof).when(j == 1, water).otherwise(F.lit(field)).cast("smallint")
    )
    return g.select(
        "tile_id", "row", "col",
        band(200 + k % 20, F.lit(40), 120).alias("r"),
        band(200 + k % 20, 90 + k % 30, 140).alias("g"),
        band(198 + k % 20, 80 + k % 30, 60).alias("b"),
    )


def tile_grid_of(tile: Column) -> geo.Grid:
    return geo.Grid(
        west=F.lit(WEST) + F.lit(TILE_STEP) * tile, north=F.lit(NORTH), a=PIXEL, e=-PIXEL
    )


# Setback polygons of tile 0, in pixel space (x = column, y = row): fixed values.
SETBACK_RINGS = {
    1: [[(5.0, 5.0), (35.0, 8.0), (20.0, 15.0), (33.0, 30.0), (8.0, 28.0), (5.0, 5.0)]],
    2: [
        [(45.0, 40.0), (80.0, 42.0), (78.0, 75.0), (44.0, 70.0), (45.0, 40.0)],
        [(55.0, 50.0), (68.0, 50.0), (68.0, 62.0), (55.0, 62.0), (55.0, 50.0)],
    ],
    3: [[(10.0, 60.0), (30.0, 55.0), (28.0, 80.0), (12.0, 85.0), (10.0, 60.0)]],
    4: [[(20.0, 70.0), (40.0, 65.0), (42.0, 90.0), (18.0, 92.0), (20.0, 70.0)]],
    5: [[(90.0, 10.0), (104.0, 12.0), (103.0, 33.0), (88.0, 25.0), (90.0, 10.0)]],
}


def setback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five polygons repeated over every tile that the raster has."""
    shapes = F.array(*[
        F.struct(
            F.lit(pid).alias("shape"),
            F.array(*[
                F.array(*[geo.point(F.lit(x), F.lit(y)) for x, y in ring]) for ring in rings
            ]).alias("rings"),
        )
        for pid, rings in SETBACK_RINGS.items()
    ])
    tiles = raster(spark, sf_dir).select("tile_id").distinct()
    return tiles.select("tile_id", F.explode(shapes).alias("s")).select(
        "tile_id",
        (F.col("tile_id") * 100 + F.col("s.shape")).cast("bigint").alias("polygon_id"),
        F.col("s.rings").alias("rings"),
    )


def detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, u = F.col("event_id"), F.col("user_id")
    n = F.get_json_object("props", "$.k").cast("int")
    e = read(spark, sf_dir, "events").select(
        k.alias("det_id"),
        (k % 20).cast("int").alias("tile"),
        (u * 7 % 980).cast("int").alias("x1"),
        (k * 13 % 980).cast("int").alias("y1"),
        n.alias("n"),
        F.least(F.col("value") / 500.0, F.lit(1.0)).alias("confidence"),
    )
    e = e.select(F.inline(F.array(F.struct(*e.columns))))  # a row of its own: what uses these columns reads them, not their formulas
    return e.select(
        "det_id",
        "tile",
        F.concat(F.lit("/tiles/naip_"), F.format_string("%02d", "tile"), F.lit(".tif"))
        .alias("tile_path"),
        F.struct(
            "x1", "y1",
            (F.col("x1") + 20 + F.col("n") % 60).alias("x2"),
            (F.col("y1") + 12 + F.col("n") % 40).alias("y2"),
        ).alias("bbox_px"),
        (F.col("n") % 7).alias("class_id"),
        "confidence",
    )


def embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.when(F.col("vec_id") % 50 != 7, F.col("embedding")).alias("vector"),
        "label",
    )


def geocode_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geocoder reply columns as text, one row per permit (matched unless k % 3 = 0)."""
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(
        k.cast("string").alias("id"),
        F.concat(k.cast("string"), F.lit(" Main St, City, MD")).alias("address"),
        F.when(k % 3 == 0, "No_Match").otherwise("Match").alias("match_flag"),
        F.lit("Exact").alias("match_type"),
        F.lit("MAIN ST, CITY, MD").alias("matched_address"),
        F.when(k % 3 == 0, F.lit(""))
        .when(k % 41 == 1, F.lit("bad,pair"))
        .otherwise(
            F.concat(
                (_lon(k, 7919) + 0.001).cast("string"), F.lit(","),
                (_lat(k, 104729) + 0.001).cast("string"),
            )
        ).alias("lon_lat"),
    )
