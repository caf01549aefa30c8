"""Distance to water and runoff risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldhub.catalog.economics import rounded
from fieldhub.catalog.ingest import SUPPLY_CTE, with_supply
from fieldhub.catalog.planned import AT_SITES, demand_at_sites
from fieldhub.catalog.registry import query
from fieldhub.catalog.spatial import _DEMAND, _MASKED
from fieldhub.fixtures import tables as T
from fieldhub.fixtures.views import with_views
from fieldhub.functions import geo
from fieldhub.operators import balance as B
from fieldhub.operators import registry as R
from fieldhub.operators.nearest_line import nearest_line, segments_of
from fieldhub.session import Scratch, spread


def water_segments(spark, d):
    ways = T.waterway(spark, d).withColumn("path", geo.project_ring(F.col("path")))
    return segments_of(ways, "line_id", "path")


def near_water(spark, d):
    """Located permits with their nearest waterway."""
    ux, uy = geo.utm18(F.col("longitude"), F.col("latitude"))
    points = with_supply(spread(R.located(T.permit(spark, d)), "permit_id")).select(
        "permit_id", "annual_n_lbs", ux.alias("x"), uy.alias("y"))
    return nearest_line(Scratch(spark, "points").cut(points), water_segments(spark, d))


#: every permit against every segment
_NEAR_WATER = """
, part AS (SELECT permit_id, line_id, ux - ax AS rx, uy - ay AS ry, bx - ax AS dx, b_y - ay AS dy FROM utm CROSS JOIN waterway)
, foot AS (SELECT permit_id, line_id, rx, ry, dx, dy,
    CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE greatest(0, least(1, (rx*dx + ry*dy) / (dx*dx + dy*dy))) END AS t FROM part)
, water AS (SELECT permit_id, min(sqrt((rx - t*dx)*(rx - t*dx) + (ry - t*dy)*(ry - t*dy))) AS m,
    arg_min(line_id, (round(sqrt((rx - t*dx)*(rx - t*dx) + (ry - t*dy)*(ry - t*dy)), 6), line_id)) AS line_id FROM foot GROUP BY permit_id)
"""


@query("nearest_water", with_views(["utm", "waterway"], _NEAR_WATER + """
SELECT permit_id, line_id, round(m, 3) AS distance_m FROM water"""))
def nearest_water(spark, d):
    return near_water(spark, d).select("permit_id", "line_id", F.round("line_distance_m", 3).alias("distance_m"))


def _risks(spark, d):
    demand = demand_at_sites(spark, d).select(F.col("site_id").alias("permit_id"), "n_demand")
    return B.runoff_risk(near_water(spark, d).join(demand, "permit_id"))


_RISK = SUPPLY_CTE + _DEMAND + _MASKED + AT_SITES + _NEAR_WATER + """
, risk AS (SELECT permit_id, m, greatest(0, annual_n_lbs::DOUBLE - coalesce(n_demand, 0)) AS surplus_n
  FROM water JOIN supply USING (permit_id) LEFT JOIN best USING (permit_id))
"""
_RISK_VIEWS = ["permit", "located", "raster", "edge", "utm", "waterway"]


@query("runoff_risk", with_views(_RISK_VIEWS, _RISK + """
SELECT permit_id, round(surplus_n, 2) AS surplus_n, round(m, 3) AS distance_m,
  round(surplus_n / greatest(m, 100), 3) AS runoff_risk FROM risk"""))
def runoff_risk(spark, d):
    return _risks(spark, d).select(
        "permit_id", F.round("surplus_n", 2).alias("surplus_n"), F.round("line_distance_m", 3).alias("distance_m"),
        F.round("runoff_risk", 3).alias("runoff_risk"),
    )


@query("runoff_summary", with_views(_RISK_VIEWS, _RISK + """
, t AS (SELECT sum(surplus_n / greatest(m, 100)) AS r FROM risk)
SELECT round(r, 3) AS current_risk, round(r * 0.1::DOUBLE, 3) AS hub_risk, round((1 - r * 0.1::DOUBLE / r) * 100, 3) AS reduction_pct FROM t"""))
def runoff_summary(spark, d):
    return rounded(B.runoff_summary(_risks(spark, d)), {"current_risk": 3, "hub_risk": 3, "reduction_pct": 3})
