"""Validated polygons and permits to the nutrient supply map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldhub import constants as K
from fieldhub.functions import geo, nutrient, text
from fieldhub.operators import spatial


def supply_map(
    polygons: DataFrame,
    permits: DataFrame,
    radius_m: float = K.JOIN_RADIUS_M,
    ties: bool = False,
) -> DataFrame:
    """Each polygon with its nearest permit and yearly N and P2O5, one row per polygon.

    With ``ties`` every equally near permit is a row, and its nutrients count once per row.

    ``polygons`` has polygon_id and ring (degrees) and any attributes; ``permits`` has
    permit_id, animal_type, headcount, longitude, latitude.
    """
    x, y = geo.utm18(F.col("longitude"), F.col("latitude"))
    points = permits.filter(
        F.col("longitude").isNotNull() & F.col("latitude").isNotNull()
    ).select(
        "permit_id", F.trim("farm_name").alias("farm_name"), "animal_type", "headcount",
        x.alias("_ux"), y.alias("_uy"),
    )
    metric = geo.project_ring(F.col("ring"))
    joined = spatial.nearest_within(
        polygons, points, radius_m, ring=metric, x="_ux", y="_uy", ties=ties
    ).drop("_ux", "_uy")
    if "area_m2" not in polygons.columns:
        joined = joined.withColumn("area_m2", geo.ring_area(metric))
    animal = text.canonical_animal(F.col("animal_type"))
    heads = F.coalesce("headcount", F.lit(0)).cast("bigint")
    return joined.withColumns({"animal_type": animal, "headcount": heads}).withColumns({
        "area_acres": nutrient.acres(F.col("area_m2")),
        "annual_n_lbs": nutrient.nitrogen_lbs(F.col("animal_type"), F.col("headcount")),
        "annual_p2o5_lbs": nutrient.phosphate_lbs(F.col("animal_type"), F.col("headcount")),
    })
