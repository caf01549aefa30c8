"""Boxes, projections, rings, tiles and detection geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldhub.catalog.registry import query
from fieldhub.fixtures import tables as T
from fieldhub.fixtures.views import plane_sql, utm_sql, with_views
from fieldhub.functions import geo, nutrient
from fieldhub.operators import detections as D
from fieldhub.operators import registry as R
from fieldhub.operators import spatial as S
from fieldhub.session import spread

_DLAT = "2.0::DOUBLE/111.0::DOUBLE"
_DLON = "2.0::DOUBLE/(111.0::DOUBLE*cos(radians(latitude)))"
_BOX = f""", box AS (SELECT permit_id, longitude - {_DLON} AS w, latitude - {_DLAT} AS s,
  longitude + {_DLON} AS e, latitude + {_DLAT} AS n FROM located)
"""


def rounded(b, digits: int = 8):
    return [F.round(b[k], digits).alias(k) for k in ("west", "south", "east", "north")]


@query("area_units", with_views(["detection"], """
SELECT det_id, round(m2/4046.8564224::DOUBLE, 8) AS acres,
  round(m2/4046.8564224::DOUBLE*4046.8564224::DOUBLE, 6) AS m2
FROM (SELECT det_id, (x2-x1)*(y2-y1)*0.36::DOUBLE AS m2 FROM detection)"""))
def area_units(spark, d):
    shapes = D.box_shape(T.detection(spark, d))
    ac = nutrient.acres(F.col("area_px") * F.lit(0.36))
    return shapes.select(
        "det_id", F.round(ac, 8).alias("acres"), F.round(nutrient.square_metres(ac), 6).alias("m2")
    )


@query("target_bbox", with_views(["located"], _BOX + """
SELECT permit_id, round(w, 8) AS west, round(s, 8) AS south, round(e, 8) AS east,
  round(n, 8) AS north FROM box"""))
def target_bbox(spark, d):
    return R.target_boxes(T.permit(spark, d)).select("permit_id", *rounded(F.col("box")))


@query("bbox_buffer", with_views(["located"], _BOX + """
, mid AS (SELECT *, 1.5::DOUBLE/111.0::DOUBLE AS dlat,
    1.5::DOUBLE/(111.0::DOUBLE*cos(radians((s + n)/2))) AS dlon FROM box)
SELECT permit_id, round(w - dlon, 8) AS west, round(s - dlat, 8) AS south,
  round(e + dlon, 8) AS east, round(n + dlat, 8) AS north FROM mid"""))
def bbox_buffer(spark, d):
    grown = R.target_boxes(T.permit(spark, d)).select(
        "permit_id", geo.grow_box(F.col("box"), 1.5).alias("box")
    )
    return grown.select("permit_id", *rounded(F.col("box")))


@query("bbox_forms", with_views(["located"], _BOX + """
, r AS (SELECT permit_id, round(w, 6) AS w, round(s, 6) AS s, round(e, 6) AS e, round(n, 6) AS n FROM box)
SELECT permit_id, round((w + e)/2, 7) AS center_x, round((s + n)/2, 7) AS center_y,
  w || ',' || s || ',' || e || ',' || n AS esri,
  printf('%.6f %.6f, %.6f %.6f, %.6f %.6f, %.6f %.6f, %.6f %.6f', w,s, e,s, e,n, w,n, w,s) AS ring
FROM r"""))
def bbox_forms(spark, d):
    b = F.col("b")
    boxes = R.target_boxes(T.permit(spark, d)).select(
        "permit_id", F.struct(*rounded(F.col("box"), 6)).alias("b")
    )
    corner = lambda p: F.format_string("%.6f %.6f", p["x"], p["y"])
    return boxes.select(
        "permit_id",
        F.round(geo.box_center(b)["x"], 7).alias("center_x"),
        F.round(geo.box_center(b)["y"], 7).alias("center_y"),
        geo.box_text(b).alias("esri"),
        F.array_join(F.transform(geo.box_ring(b), corner), ", ").alias("ring"),
    )


@query("tile_grid", with_views(["located"], _BOX + """
, step AS (SELECT *, 1024.0::DOUBLE/111000.0::DOUBLE AS dlat,
    1024.0::DOUBLE/(111000.0::DOUBLE*cos(radians((s + n)/2))) AS dlon FROM box)
, cells AS (SELECT *, unnest(range(ceil((e - w)/dlon)::BIGINT)) AS ix FROM step)
, tiles AS (SELECT *, unnest(range(ceil((n - s)/dlat)::BIGINT)) AS iy FROM cells)
SELECT permit_id, ix::INTEGER AS ix, iy::INTEGER AS iy, round(w + ix*dlon, 8) AS west,
  round(s + iy*dlat, 8) AS south, round(least(w + ix*dlon + dlon, e), 8) AS east,
  round(least(s + iy*dlat + dlat, n), 8) AS north FROM tiles"""))
def tile_grid(spark, d):
    permits = spread(R.located(T.permit(spark, d)).select("permit_id", "longitude", "latitude"), "permit_id")
    tiles = R.target_boxes(permits).select("permit_id", F.explode(geo.box_tiles(F.col("box"))).alias("t"))
    return tiles.select("permit_id", "t.ix", "t.iy", *rounded(F.col("t")))


@query("to_utm", with_views(["utm"], """
SELECT permit_id, round(ux, 3) AS x, round(uy, 3) AS y FROM utm"""))
def to_utm(spark, d):
    x, y = geo.utm18(F.col("longitude"), F.col("latitude"))
    return R.located(T.permit(spark, d)).select(
        "permit_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y")
    )


@query("to_state_plane", with_views(["plane"], """
SELECT permit_id, round(px, 3) AS x, round(py, 3) AS y FROM plane"""))
def to_state_plane(spark, d):
    x, y = geo.state_plane(F.col("longitude"), F.col("latitude"))
    return R.located(T.permit(spark, d)).select(
        "permit_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y")
    )


# --- detections ------------------------------------------------------------------
def geo_boxes(spark, d):
    """Detections with their geographic box."""
    dets = D.labelled(T.detection(spark, d))
    box = geo.pixel_box_to_geo(F.col("bbox_px"), T.tile_grid_of(F.col("tile")))
    return dets.select("*", F.inline(F.array(F.struct(box.alias("bbox_geo")))))  # worked out once a row, a ring reads it ten times


def detection_rings(spark, d):
    """Detections with the closed geographic ring of their box."""
    return geo_boxes(spark, d).withColumn("ring", geo.box_ring(F.col("bbox_geo")))


GEO_BOX = """
, corner AS (SELECT *, -76.5::DOUBLE + 0.03::DOUBLE*tile AS west0 FROM detection)
, pts AS (SELECT *, west0 + 0.0003::DOUBLE*(x1 + 0.5::DOUBLE) AS lon1,
   west0 + 0.0003::DOUBLE*(x2 + 0.5::DOUBLE) AS lon2,
   39.0::DOUBLE + -0.0003::DOUBLE*(y1 + 0.5::DOUBLE) AS lat1,
   39.0::DOUBLE + -0.0003::DOUBLE*(y2 + 0.5::DOUBLE) AS lat2 FROM corner)
, gbox AS (SELECT *, least(lon1, lon2) AS w, least(lat1, lat2) AS s, greatest(lon1, lon2) AS e,
   greatest(lat1, lat2) AS n FROM pts)
"""
CLASS_SQL = """CASE class_id WHEN 0 THEN 'poultry_house' WHEN 1 THEN 'barn' WHEN 2 THEN
 'manure_lagoon' WHEN 3 THEN 'feedlot' WHEN 4 THEN 'silo' ELSE 'class_' || class_id END"""


@query("pixel_to_geo", with_views(["detection"], GEO_BOX + """
SELECT det_id, round(w, 8) AS west, round(s, 8) AS south, round(e, 8) AS east,
  round(n, 8) AS north FROM gbox"""))
def pixel_to_geo(spark, d):
    return geo_boxes(spark, d).select("det_id", *rounded(F.col("bbox_geo")))


@query("ring_to_geo", with_views(["detection"], GEO_BOX + """
, v AS (SELECT *, unnest([1,2,3,4,5]) AS pos FROM gbox)
SELECT det_id, pos, round(CASE WHEN pos IN (1,4,5) THEN lon1 ELSE lon2 END, 8) AS lon,
  round(CASE WHEN pos IN (1,2,5) THEN lat1 ELSE lat2 END, 8) AS lat FROM v"""))
def ring_to_geo(spark, d):
    b = F.col("bbox_px")
    corners = F.array(*[
        geo.point(b[x].cast("double"), b[y].cast("double"))
        for x, y in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"))
    ])
    ring = geo.pixel_ring_to_geo(F.col("corners"), T.tile_grid_of(F.col("tile")))
    out = T.detection(spark, d).withColumn("corners", corners)
    out = out.select("det_id", F.posexplode(ring).alias("pos", "p"))
    return out.select(
        "det_id", (F.col("pos") + 1).alias("pos"),
        F.round("p.x", 8).alias("lon"), F.round("p.y", 8).alias("lat"),
    )


_RING_UTM = f"""
, ring AS (SELECT det_id, pos, CASE WHEN pos IN (1,4,5) THEN w ELSE e END AS longitude,
    CASE WHEN pos IN (1,2,5) THEN s ELSE n END AS latitude
  FROM (SELECT *, unnest([1,2,3,4,5]) AS pos FROM gbox))
, ringm AS (SELECT det_id, pos, {utm_sql("longitude", "latitude")[0]} AS x,
    {utm_sql("longitude", "latitude")[1]} AS y FROM ring)
"""


@query("polygon_area", with_views(["detection"], GEO_BOX + _RING_UTM + """
, o AS (SELECT det_id, x AS ox, y AS oy FROM ringm WHERE pos = 1)
, nxt AS (SELECT *, lead(x) OVER (PARTITION BY det_id ORDER BY pos) AS qx,
    lead(y) OVER (PARTITION BY det_id ORDER BY pos) AS qy FROM ringm)
, a AS (SELECT det_id, abs(sum((x-ox)*(qy-oy) - (qx-ox)*(y-oy)))/2 AS m2
  FROM nxt JOIN o USING (det_id) WHERE qx IS NOT NULL GROUP BY det_id)
SELECT det_id, round(m2, 0) AS area_m2, round(m2/4046.8564224::DOUBLE, 3) AS area_acres FROM a"""))
def polygon_area(spark, d):
    area = geo.ring_area(geo.project_ring(F.col("ring")))
    out = detection_rings(spark, d).select("det_id", area.alias("m2"))
    return out.select(
        "det_id",
        F.round("m2", 0).alias("area_m2"),
        F.round(nutrient.acres(F.col("m2")), 3).alias("area_acres"),
    )


@query("polygon_centroid", with_views(["detection"], GEO_BOX + """
SELECT det_id, round((w + e)/2, 7) AS lon, round((s + n)/2, 7) AS lat FROM gbox"""))
def polygon_centroid(spark, d):
    out = detection_rings(spark, d).select(
        "det_id", geo.ring_centroid(F.col("ring")).alias("c")
    )
    return out.select("det_id", F.round("c.x", 7).alias("lon"), F.round("c.y", 7).alias("lat"))


@query("detection_center", with_views(["detection"], """
SELECT det_id, ((x1 + x2)//2)::INTEGER AS cx, ((y1 + y2)//2)::INTEGER AS cy FROM detection"""))
def detection_center(spark, d):
    cx, cy = D.center(F.col("bbox_px"))
    return T.detection(spark, d).select("det_id", cx.alias("cx"), cy.alias("cy"))


@query("detections_conf", with_views(["detection"], """
SELECT det_id, tile_path, confidence FROM detection WHERE confidence >= 0.25"""))
def detections_conf(spark, d):
    return D.confident(T.detection(spark, d)).select("det_id", "tile_path", "confidence")


_SHAPE = """
, shape AS (SELECT det_id, (x2-x1)*(y2-y1) AS area_px, greatest(x2-x1, y2-y1) AS long_side,
   least(x2-x1, y2-y1) AS short_side FROM detection)
"""


@query("house_shapes", with_views(["detection"], _SHAPE + """
SELECT det_id, area_px, long_side, short_side FROM shape WHERE area_px BETWEEN 150 AND 4000
 AND short_side >= 1 AND long_side/greatest(short_side, 1) >= 2.5 AND long_side BETWEEN 25 AND 300"""))
def house_shapes(spark, d):
    return D.house_like(D.box_shape(T.detection(spark, d))).select(
        "det_id", "area_px", "long_side", "short_side"
    )


@query("lagoon_shapes", with_views(["detection"], _SHAPE + """
SELECT det_id, area_px, long_side, short_side FROM shape WHERE area_px BETWEEN 300 AND 60000
 AND short_side >= 1 AND long_side/greatest(short_side, 1) <= 5"""))
def lagoon_shapes(spark, d):
    return D.lagoon_like(D.box_shape(T.detection(spark, d))).select(
        "det_id", "area_px", "long_side", "short_side"
    )


@query("valid_rings", with_views(["detection"], """
SELECT det_id, (3 + det_id % 3)::INTEGER AS vertices FROM detection WHERE 3 + det_id % 3 >= 4"""))
def valid_rings(spark, d):
    cut = detection_rings(spark, d).select(
        "det_id", F.slice("ring", F.lit(1), (F.lit(3) + F.col("det_id") % 3).cast("int")).alias("ring")
    )
    return cut.filter(F.size("ring") >= 4).select("det_id", F.size("ring").alias("vertices"))


@query("detections_per_tile", with_views(["detection"], f"""
SELECT tile_path, {CLASS_SQL} AS class_name, count(*) AS detections FROM detection
GROUP BY ALL"""))
def detections_per_tile(spark, d):
    return D.per_tile(D.labelled(T.detection(spark, d)), "class_name")


@query("all_detections", with_views(["detection"], _SHAPE + """
SELECT 'poultry_house' AS class_name, det_id, area_px FROM shape WHERE area_px BETWEEN 150 AND 4000
 AND short_side >= 1 AND long_side/greatest(short_side, 1) >= 2.5 AND long_side BETWEEN 25 AND 300
UNION ALL
SELECT 'manure_lagoon', det_id, area_px FROM shape WHERE area_px BETWEEN 300 AND 60000
 AND short_side >= 1 AND long_side/greatest(short_side, 1) <= 5"""))
def all_detections(spark, d):
    shapes = D.box_shape(T.detection(spark, d))
    named = lambda df, name: df.select(F.lit(name).alias("class_name"), "det_id", "area_px")
    return named(D.house_like(shapes), "poultry_house").unionByName(
        named(D.lagoon_like(shapes), "manure_lagoon")
    )


# --- permits on tiles ---------------------------------------------------------------
def tiles(spark, d):
    t = T.detection(spark, d).select("tile", "tile_path").distinct()
    return t.select(
        "tile", "tile_path",
        (F.lit(T.WEST) + F.lit(T.TILE_STEP) * F.col("tile")).alias("west"),
        F.lit(T.NORTH).alias("north"),
    )


_TILES = """
, tiles AS (SELECT DISTINCT tile_path, -76.5::DOUBLE + 0.03::DOUBLE*tile AS west, 39.0::DOUBLE AS north
  FROM detection)
, inside AS (SELECT * FROM located JOIN tiles ON longitude BETWEEN west AND west + 0.3::DOUBLE
   AND latitude BETWEEN north - 0.3::DOUBLE AND north)
, pbox AS (SELECT *, greatest(0, px - 50) AS x1, greatest(0, py - 50) AS y1, least(1000, px + 50) AS x2,
    least(1000, py + 50) AS y2
  FROM (SELECT *, floor((longitude - west)/0.0003::DOUBLE)::INTEGER AS px,
     floor((latitude - north)/(-0.0003::DOUBLE))::INTEGER AS py FROM inside))
"""


@query("permits_in_tile", with_views(["located", "detection"], _TILES + """
SELECT tile_path, permit_id FROM inside"""))
def permits_in_tile(spark, d):
    bounds = tiles(spark, d).select(
        "tile_path", "west", (F.col("north") - T.PIXEL * T.TILE_PX).alias("south"),
        (F.col("west") + T.PIXEL * T.TILE_PX).alias("east"), "north",
    )
    hits = S.points_in_boxes(
        R.located(T.permit(spark, d)).select("permit_id", "longitude", "latitude"),
        bounds, "longitude", "latitude", cell=T.PIXEL * T.TILE_PX,
    )
    return hits.select("tile_path", "permit_id")


def fallback_boxes(spark, d):
    return D.permit_boxes(T.permit(spark, d), tiles(spark, d), T.PIXEL, T.TILE_PX, T.TILE_PX)


@query("permit_boxes", with_views(["located", "detection"], _TILES + """
SELECT permit_id AS source_id, tile_path, x1, y1, x2, y2, animal_type AS class_name FROM pbox
WHERE x2 > x1 AND y2 > y1"""))
def permit_boxes(spark, d):
    return fallback_boxes(spark, d).select("source_id", "tile_path", "bbox_px.*", "class_name")


@query("detections_or_permits", with_views(["located", "detection"], _TILES + f"""
SELECT 'some' AS detector, det_id AS source_id, {CLASS_SQL} AS class_name, confidence FROM detection
WHERE confidence >= 0.25
UNION ALL SELECT 'none', permit_id, animal_type, 1.0::DOUBLE FROM pbox WHERE x2 > x1 AND y2 > y1"""))
def detections_or_permits(spark, d):
    dets = geo_boxes(spark, d).withColumnRenamed("det_id", "source_id")
    backup = fallback_boxes(spark, d)
    cols = ["source_id", "class_name", "confidence"]

    def run(name: str, threshold: float):
        kept = D.confident(dets, threshold).select(*cols)
        return D.or_fallback(kept, backup.select(*cols)).select(F.lit(name).alias("detector"), *cols)

    return run("some", 0.25).unionByName(run("none", 2.0))


@query("detections_with_site", with_views(["located", "detection"], """
, site AS (SELECT row_number() OVER (ORDER BY headcount DESC, permit_id) - 1 AS tile, permit_id,
    farm_name, county, headcount FROM located ORDER BY headcount DESC, permit_id LIMIT 10)
SELECT det_id, tile_path, permit_id, trim(farm_name) AS farm_name, county, headcount
FROM detection JOIN site USING (tile)"""))
def detections_with_site(spark, d):
    manifest = top_sites(spark, d, 10)
    return D.with_sites(T.detection(spark, d), manifest).select(
        "det_id", "tile_path", "permit_id", "farm_name", "county", "headcount"
    )


def top_sites(spark, d, n: int):
    """Manifest of the n largest located facilities, tile i for the i-th largest."""
    from pyspark.sql import Window

    top = R.located(T.permit(spark, d)).orderBy(F.desc("headcount"), "permit_id").limit(n)
    rank = F.row_number().over(Window.orderBy(F.desc("headcount"), "permit_id")) - 1
    return top.select(
        rank.alias("tile"), "permit_id", F.trim("farm_name").alias("farm_name"), "county", "headcount"
    )


# --- feature text -----------------------------------------------------------------
@query("geojson_points", with_views(["located"], """
SELECT permit_id, '{"type":"Feature","geometry":{"type":"Point","coordinates":' ||
  printf('[%.6f,%.6f]', longitude, latitude) || '},"properties":' ||
  json_object('permit_id', permit_id, 'county', county, 'headcount', headcount)::VARCHAR || '}' AS feature
FROM located"""))
def geojson_points(spark, d):
    return D.point_features(
        R.located(T.permit(spark, d)), "permit_id", "county", "headcount"
    ).select("permit_id", "feature")


_RING_TEXT = """printf('[%.6f,%.6f],[%.6f,%.6f],[%.6f,%.6f],[%.6f,%.6f],[%.6f,%.6f]',
   w,s, e,s, e,n, w,n, w,s)"""


@query("geojson_detections", with_views(["detection"], GEO_BOX + f"""
SELECT det_id, '{{"type":"Feature","geometry":{{"type":"Polygon","coordinates":[[' || {_RING_TEXT} ||
  ']]}},"properties":' || printf('{{"class_name":"%s","class_id":%d,"confidence":%.4f,"tile":"%s","bbox_px":[%d,%d,%d,%d]}}',
   {CLASS_SQL}, class_id, confidence, replace(tile_path, '/tiles/', ''), x1, y1, x2, y2) || '}}' AS feature
FROM gbox"""))
def geojson_detections(spark, d):
    return D.detection_features(geo_boxes(spark, d)).select("det_id", "feature")


@query("geojson_polygons", with_views(["detection"], GEO_BOX + f"""
SELECT det_id, '{{"type":"Feature","geometry":{{"type":"Polygon","coordinates":[[' || {_RING_TEXT} ||
  ']]}},"properties":' || printf('{{"class_name":"%s","confidence":%.4f,"area_m2":%.2f,"area_acres":%.4f,"tile":"%s"}}',
   {CLASS_SQL}, confidence, (x2-x1)*(y2-y1)*0.36::DOUBLE, (x2-x1)*(y2-y1)*0.36::DOUBLE/4046.86::DOUBLE,
   replace(tile_path, '/tiles/', '')) || '}}' AS feature
FROM gbox"""))
def geojson_polygons(spark, d):
    segments = D.box_shape(detection_rings(spark, d)).withColumn(
        "area_m2", F.col("area_px") * F.lit(0.36)
    )
    return D.polygon_features(segments).select("det_id", "feature")
