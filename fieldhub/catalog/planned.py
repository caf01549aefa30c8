"""Whole plans (supply map, siting run) and the balance, grid and sampling operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldhub.catalog.economics import rounded
from fieldhub.catalog.geometry import detection_rings
from fieldhub.catalog.ingest import SUPPLY_CTE, with_supply
from fieldhub.catalog.registry import query
from fieldhub.catalog.siting import (
    _REFINED, ROUNDS, SWAP_PAIR, _dist, _fill, candidate_points, facilities,
)
from fieldhub.catalog.spatial import _DEMAND, _MASKED, NEAREST_SQL, demand
from fieldhub.fixtures import tables as T
from fieldhub.fixtures.views import with_views
from fieldhub.operators import balance as B
from fieldhub.operators import registry as R
from fieldhub.operators import siting as G
from fieldhub.plans import ingest, siting_run, supply


@query("permit_ingest", with_views(["permit", "reply"], """
SELECT p.permit_id, trim(farm_name) AS farm_name, upper(trim(designation)) AS designation,
  lower(trim(animal_type)) AS animal_type, county, coalesce(r.lat, p.latitude) AS latitude,
  coalesce(r.lon, p.longitude) AS longitude
FROM permit p LEFT JOIN reply r ON r.id = p.permit_id AND r.matched AND NOT r.malformed
  AND round(p.latitude*100) = 3880 AND round(p.longitude*100) = -7580
WHERE status <> 'Closed' AND contains(lower(county), 'c')"""))
def permit_ingest(spark, d):
    codes = R.parse_geocode_replies(T.geocode_reply(spark, d))
    out = ingest.permit_layer(
        T.raw_registry(spark, d), "permit_id", codes, county="c", assume_standard=True
    )
    return out.select(
        "permit_id", "farm_name", "designation", "animal_type", "county", "latitude", "longitude"
    )


@query("supply_map", with_views(["permit", "utm", "detection"], SUPPLY_CTE + NEAREST_SQL + """
, one AS (SELECT det_id, min(permit_id) AS permit_id, min(dm) AS dm, count(*) AS join_ties FROM near GROUP BY det_id)
SELECT d.det_id AS polygon_id, n.permit_id, coalesce(s.animal, 'unknown') AS animal_type,
  coalesce(s.headcount, 0) AS headcount, round(dm, 3) AS join_distance_m,
  coalesce(s.annual_n_lbs, 0) AS annual_n_lbs, coalesce(s.annual_p2o5_lbs, 0) AS annual_p2o5_lbs,
  coalesce(join_ties, 0) AS join_ties
FROM detection d LEFT JOIN one n ON n.det_id = d.det_id LEFT JOIN supply s ON s.permit_id = n.permit_id"""))
def supply_map(spark, d):
    polygons = detection_rings(spark, d).select(
        F.col("det_id").alias("polygon_id"), "ring", "class_name", "confidence"
    )
    out = supply.supply_map(polygons, T.permit(spark, d))
    return out.select(
        "polygon_id", "permit_id", "animal_type", "headcount",
        F.round("join_distance_m", 3).alias("join_distance_m"), "annual_n_lbs", "annual_p2o5_lbs", "join_ties",
    )


_SHORE = """
, shore AS (SELECT * FROM plane WHERE county IN ('Worcester', 'Wicomico', 'Caroline', 'Somerset',
   'Dorchester', 'Queen Anne''s', 'Kent', 'Talbot'))
"""


@query("siting_run", with_views(["plane"], _SHORE + _REFINED.replace("plane", "shore") + f"""
, t AS (SELECT sum(headcount) AS animals, sum(CASE WHEN pick >= 0 THEN headcount * {_dist()} END) AS effort
   FROM done{ROUNDS - 1})
SELECT round(effort/25000*2.5::DOUBLE*52, 2) AS annual_transport_cost, 20000000.0::DOUBLE AS total_construction_cost,
  round(effort/25000*2.5::DOUBLE*52*5 + 20000000, 2) AS total_cost_5yr,
  round(effort/25000*2.5::DOUBLE*52/animals, 6) AS cost_per_animal_per_year,
  round(effort/25000*52, 2) AS effort_trips_per_year, round(effort/animals, 6) AS avg_distance_km FROM t""",
    recursive=True))
def run_siting(spark, d):
    done = siting_run.run(T.permit(spark, d), "eastern-shore", 10, capacity=None)
    return rounded(done.totals, {
        "annual_transport_cost": 2, "total_cost_5yr": 2, "cost_per_animal_per_year": 6,
        "effort_trips_per_year": 2, "avg_distance_km": 6,
    })


# --- documented extras ---------------------------------------------------------------
_ACRES = 900.0 / 4046.8564224


@query("nutrient_balance", with_views(["permit", "raster", "edge"], SUPPLY_CTE + _DEMAND + _MASKED + f"""
, s AS (SELECT floor(longitude/0.1::DOUBLE)::INTEGER AS cell_x, floor(latitude/0.1::DOUBLE)::INTEGER AS cell_y,
   sum(annual_n_lbs) AS n_supply, sum(annual_p2o5_lbs) AS p_supply FROM supply
   WHERE longitude IS NOT NULL AND latitude IS NOT NULL GROUP BY ALL)
, q AS (SELECT floor((-76.5::DOUBLE + 0.03::DOUBLE*tile_id + 0.0003::DOUBLE*(col + 0.5::DOUBLE))/0.1::DOUBLE)::INTEGER AS cell_x,
   floor((39.0::DOUBLE + -0.0003::DOUBLE*(row + 0.5::DOUBLE))/0.1::DOUBLE)::INTEGER AS cell_y,
   sum(n_demand::DOUBLE)*{_ACRES!r}::DOUBLE AS n_need, sum(p_demand::DOUBLE)*{_ACRES!r}::DOUBLE AS p_need FROM dmap GROUP BY ALL)
SELECT cell_x, cell_y, round(coalesce(n_supply, 0) - coalesce(n_need, 0), 2) AS n_balance,
  round(coalesce(p_supply, 0) - coalesce(p_need, 0), 2) AS p_balance FROM s FULL JOIN q USING (cell_x, cell_y)"""))
def nutrient_balance(spark, d):
    out = B.nutrient_balance(
        with_supply(T.permit(spark, d)), demand(spark, d), T.tile_grid_of(F.col("tile_id")), _ACRES
    )
    return out.select(
        "cell_x", "cell_y", F.round("n_balance", 2).alias("n_balance"),
        F.round("p_balance", 2).alias("p_balance"),
    )


@query("candidate_grid", with_views(["located"], """
, ext AS (SELECT min(longitude) AS w, min(latitude) AS s, max(longitude) AS e, max(latitude) AS n FROM located)
, dims AS (SELECT *, ceil((e - w)/0.1::DOUBLE)::INTEGER AS nx, ceil((n - s)/0.1::DOUBLE)::INTEGER AS ny FROM ext)
, yy AS (SELECT *, unnest(range(ny)) AS iy FROM dims)
, xx AS (SELECT *, unnest(range(nx)) AS ix FROM yy)
SELECT (iy*nx + ix)::BIGINT AS site_id, round(w + ix*0.1::DOUBLE, 9) AS longitude, round(s + iy*0.1::DOUBLE, 9) AS latitude FROM xx"""))
def candidate_grid(spark, d):
    extent = R.located(T.permit(spark, d)).agg(
        F.min("longitude").alias("west"), F.min("latitude").alias("south"),
        F.max("longitude").alias("east"), F.max("latitude").alias("north"),
    )
    return rounded(B.candidate_grid(extent), {"longitude": 9, "latitude": 9})


#: the largest demand under each located permit
AT_SITES = """
, tiles AS (SELECT DISTINCT tile_id, -76.5::DOUBLE + 0.03::DOUBLE*tile_id AS west, 39.0::DOUBLE AS north FROM raster)
, hitp AS (SELECT permit_id, t.tile_id, floor((latitude - north)/(-0.0003::DOUBLE))::INTEGER AS row,
    floor((longitude - west)/0.0003::DOUBLE)::INTEGER AS col
  FROM located JOIN tiles t ON longitude BETWEEN west AND west + 0.0003::DOUBLE*100 AND latitude BETWEEN north - 0.0003::DOUBLE*100 AND north)
, best AS (SELECT permit_id, max(n_demand)::DOUBLE AS n_demand FROM hitp JOIN dmap USING (tile_id, row, col) GROUP BY permit_id)
"""


@query("demand_at_sites", with_views(["located", "raster", "edge"], _DEMAND + _MASKED + AT_SITES + """
SELECT l.permit_id AS site_id, coalesce(n_demand, 0) AS n_demand, coalesce(n_demand, 0)*0.5::DOUBLE AS penalty
FROM located l LEFT JOIN best USING (permit_id)"""))
def demand_at_sites(spark, d):
    pixels = demand(spark, d)
    tiles = T.raster(spark, d).select("tile_id").distinct().select(
        "tile_id", (F.lit(T.WEST) + F.lit(T.TILE_STEP) * F.col("tile_id")).alias("west"),
        F.lit(T.NORTH).alias("north"),
    )
    sites = R.located(T.permit(spark, d)).select(
        F.col("permit_id").alias("site_id"), "longitude", "latitude"
    )
    out = B.demand_at_sites(sites, pixels, tiles, T.PIXEL, 100, 100)
    return B.penalised(out, 0.5).select("site_id", "n_demand", "penalty")


@query("pmedian_capacity", with_views(["plane", "site_plane"], SWAP_PAIR + f"""
, capacity AS (SELECT ceil(sum(headcount) * 11 / (10.0 * 2))::BIGINT AS cap FROM plane)
, hub0 AS (SELECT row_number() OVER (ORDER BY site_id) - 1 AS k, site_id, px AS hx, py AS hy FROM site_plane, best
   WHERE site_id IN (s1, s2))
""" + _fill(0) + f"""
SELECT permit_id, site_id, round({_dist("d.px", "d.py", "d.hx", "d.hy")}, 6) AS dist FROM done0 d LEFT JOIN hub0 ON k = pick""",
    recursive=True))
def pmedian_capacity(spark, d):
    f = facilities(spark, d)
    sites = G.p_median(f, candidate_points(spark, d), 2).sites
    hubs = [G.Hub(k, s.x, s.y) for k, s in enumerate(sites)]
    out = G.assign_with_capacity(f, hubs, G.default_capacity(f, 2))
    ids = F.array(*[F.lit(s.site_id).cast("bigint") for s in sites])
    return out.select(
        "permit_id",
        F.when(F.col("assigned_site_idx") >= 0, F.get(ids, F.col("assigned_site_idx"))).alias("site_id"),
        F.round("distance_to_hub_km", 6).alias("dist"),
    )
