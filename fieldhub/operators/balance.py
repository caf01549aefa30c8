"""Nutrient balance per grid cell, candidate grids, demand at sites and runoff risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldhub import constants as K
from fieldhub.functions import geo


def cell_key(lon: Column, lat: Column, degrees: float) -> list[Column]:
    index = lambda v: F.floor(v / F.lit(degrees)).cast("int")
    return [index(lon).alias("cell_x"), index(lat).alias("cell_y")]


def nutrient_balance(
    supply: DataFrame, demand: DataFrame, grid: geo.Grid, pixel_acres: float, degrees: float = 0.1
) -> DataFrame:
    """Supply minus demand in pounds per cell; both sides shrink to cells before they meet.

    ``supply`` has longitude, latitude, annual_n_lbs, annual_p2o5_lbs; ``demand`` has row,
    col, n_demand, p_demand in pounds per acre.
    """
    s = supply.filter("longitude is not null and latitude is not null").groupBy(
        *cell_key(F.col("longitude"), F.col("latitude"), degrees)
    ).agg(F.sum("annual_n_lbs").alias("n_supply"), F.sum("annual_p2o5_lbs").alias("p_supply"))
    acres = F.lit(float(pixel_acres))
    d = demand.groupBy(
        *cell_key(grid.lon(F.col("col")), grid.lat(F.col("row")), degrees)
    ).agg(
        (F.sum(F.col("n_demand").cast("double")) * acres).alias("n_need"),
        (F.sum(F.col("p_demand").cast("double")) * acres).alias("p_need"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    out = s.join(d, ["cell_x", "cell_y"], "full").select(
        "cell_x", "cell_y", zero("n_supply"), zero("p_supply"), zero("n_need"), zero("p_need")
    )
    return out.withColumns({
        "n_balance": F.col("n_supply") - F.col("n_need"),
        "p_balance": F.col("p_supply") - F.col("p_need"),
    })


def candidate_grid(extent: DataFrame, degrees: float = 0.1) -> DataFrame:
    """Regular candidate sites over a one-row extent (west, south, east, north); an extent
    without width or height has none."""
    count = lambda lo, hi: F.ceil((F.col(hi) - F.col(lo)) / F.lit(degrees)).cast("int")
    known = extent.filter("west < east and south < north")
    rows = known.withColumns({"_nx": count("west", "east"), "_ny": count("south", "north")})
    lines = rows.withColumn("iy", F.explode(F.sequence(F.lit(0), F.col("_ny") - 1)))
    cells = lines.withColumn("ix", F.explode(F.sequence(F.lit(0), F.col("_nx") - 1)))
    return cells.select(
        (F.col("iy").cast("bigint") * F.col("_nx") + F.col("ix")).alias("site_id"),
        (F.col("west") + F.col("ix") * F.lit(degrees)).alias("longitude"),
        (F.col("south") + F.col("iy") * F.lit(degrees)).alias("latitude"),
    )


def demand_at_sites(
    sites: DataFrame, demand: DataFrame, tiles: DataFrame, pixel: float, rows: int, cols: int
) -> DataFrame:
    """N demand of the pixel under each site (0 outside every tile).

    ``tiles`` has (tile_id, west, north).  A site is keyed to its pixel and meets the
    raster in an equi-join; of overlapping tiles the largest demand counts.
    """
    from fieldhub.operators.spatial import points_in_boxes

    bounds = tiles.select(
        "tile_id", "west", "north", (F.col("west") + pixel * cols).alias("east"),
        (F.col("north") - pixel * rows).alias("south"),
    )
    grid = geo.Grid(west=F.col("west"), north=F.col("north"), a=pixel, e=-pixel)
    hits = points_in_boxes(
        sites.select("site_id", "longitude", "latitude"), bounds, "longitude", "latitude",
        cell=max(rows, cols) * pixel,
    ).select(
        "site_id", "tile_id", grid.row(F.col("latitude")).alias("row"),
        grid.col(F.col("longitude")).alias("col"),
    )
    found = hits.join(demand.select("tile_id", "row", "col", "n_demand"), ["tile_id", "row", "col"])
    best = found.groupBy("site_id").agg(F.max("n_demand").cast("double").alias("n_demand"))
    return sites.join(best, "site_id", "left").withColumn(
        "n_demand", F.coalesce("n_demand", F.lit(0.0))
    )


def penalised(sites: DataFrame, weight: float) -> DataFrame:
    """Penalty column for siting: demand times a weight."""
    return sites.withColumn("penalty", F.col("n_demand") * F.lit(float(weight)))


def one_row_extent(spark: SparkSession, west: float, south: float, east: float, north: float) -> DataFrame:
    return spark.range(1).select(
        *[F.lit(float(v)).alias(k) for k, v in
          (("west", west), ("south", south), ("east", east), ("north", north))]
    )


def runoff_risk(sources: DataFrame, least_metres: float = K.RUNOFF_LEAST_METRES) -> DataFrame:
    """Add ``surplus_n`` and ``runoff_risk`` to rows with annual_n_lbs, n_demand and line_distance_m.

    The risk is what the surroundings do not take up over the distance to water, which
    counts as ``least_metres`` at least.  Nulls count as no nitrogen and no demand; without
    any water the risk is 0.
    """
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    surplus = F.greatest(F.lit(0.0), zero("annual_n_lbs") - zero("n_demand"))
    near = F.greatest(F.col("line_distance_m"), F.lit(float(least_metres)))
    return sources.withColumn("surplus_n", surplus).withColumn(
        "runoff_risk", F.when(F.col("line_distance_m").isNull(), 0.0).otherwise(F.col("surplus_n") / near)
    )


def runoff_summary(risks: DataFrame, left: float = K.RUNOFF_LEFT) -> DataFrame:
    """One row: total risk today, the part ``left`` with central processing, the reduction in per cent."""
    total = risks.agg(F.coalesce(F.sum("runoff_risk"), F.lit(0.0)).alias("current_risk"))
    after = total.withColumn("hub_risk", F.col("current_risk") * F.lit(float(left)))
    return after.withColumn(
        "reduction_pct", (1 - F.try_divide(F.col("hub_risk"), F.col("current_risk"))) * 100
    )
