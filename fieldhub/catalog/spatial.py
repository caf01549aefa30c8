"""Nearest join, close pairs, merged boxes, raster masks and regions, embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldhub.catalog.geometry import GEO_BOX, _RING_UTM, detection_rings
from fieldhub.catalog.registry import query
from fieldhub.fixtures import tables as T
from fieldhub.fixtures.views import with_views
from fieldhub.functions import geo
from fieldhub.operators import embeddings as V
from fieldhub.operators import merging as M
from fieldhub.operators import raster as P
from fieldhub.operators import registry as R
from fieldhub.operators import spatial as S

TILE_ROWS = TILE_COLS = 100


# --- nearest permit -----------------------------------------------------------------
def permits_utm(spark, d):
    x, y = geo.utm18(F.col("longitude"), F.col("latitude"))
    return R.located(T.permit(spark, d)).select("permit_id", x.alias("x"), y.alias("y"))


NEAREST_SQL = GEO_BOX + _RING_UTM + """
, ext AS (SELECT det_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM ringm GROUP BY det_id)
, seg AS (SELECT det_id, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS b_y FROM ringm
    WINDOW w AS (PARTITION BY det_id ORDER BY pos))
, pair AS (SELECT det_id, permit_id, ux, uy FROM ext JOIN utm
    ON ux BETWEEN x0 - 2000 AND x1 + 2000 AND uy BETWEEN y0 - 2000 AND y1 + 2000)
, par AS (SELECT *, greatest(0, least(1, ((ux-ax)*(bx-ax) + (uy-ay)*(b_y-ay)) /
     ((bx-ax)*(bx-ax) + (b_y-ay)*(b_y-ay)))) AS u
   FROM pair JOIN seg USING (det_id) WHERE bx IS NOT NULL)
, dist AS (SELECT det_id, permit_id, CASE WHEN sum(CASE WHEN (ay > uy) <> (b_y > uy) AND
      ux < ax + (uy-ay)*(bx-ax)/(b_y-ay) THEN 1 ELSE 0 END) % 2 = 1 THEN 0::DOUBLE ELSE
     min(sqrt((ux-(ax+u*(bx-ax)))*(ux-(ax+u*(bx-ax))) + (uy-(ay+u*(b_y-ay)))*(uy-(ay+u*(b_y-ay))))) END AS dm
   FROM par GROUP BY det_id, permit_id)
, near AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY det_id ORDER BY dm) AS rk FROM dist
    WHERE dm <= 2000) WHERE rk = 1)
"""


def _nearest(spark, d, **kw):
    polygons = detection_rings(spark, d).select(F.col("det_id").alias("polygon_id"), "ring")
    out = S.nearest_within(polygons, permits_utm(spark, d), 2000.0, ring=geo.project_ring(F.col("ring")), **kw)
    return out.withColumn("join_distance_m", F.round("join_distance_m", 3))


@query("nearest_permit", with_views(["utm", "detection"], NEAREST_SQL + """
SELECT d.det_id AS polygon_id, min(permit_id) AS permit_id, round(min(dm), 3) AS join_distance_m,
  count(permit_id) AS join_ties
FROM detection d LEFT JOIN near n ON n.det_id = d.det_id GROUP BY d.det_id"""))
def nearest_permit(spark, d):
    return _nearest(spark, d).select("polygon_id", "permit_id", "join_distance_m", "join_ties")


@query("nearest_permit_first", with_views(["utm", "detection"], NEAREST_SQL + """
SELECT d.det_id AS polygon_id, min(permit_id) AS permit_id, round(min(dm), 3) AS join_distance_m
FROM detection d LEFT JOIN near n ON n.det_id = d.det_id GROUP BY d.det_id"""))
def nearest_permit_first(spark, d):
    return _nearest(spark, d).select("polygon_id", "permit_id", "join_distance_m")


@query("nearest_permit_ties", with_views(["utm", "detection"], NEAREST_SQL + """
SELECT d.det_id AS polygon_id, permit_id, round(dm, 3) AS join_distance_m
FROM detection d LEFT JOIN near n ON n.det_id = d.det_id"""))
def nearest_permit_ties(spark, d):
    """Every equally near permit, as a plain nearest join gives them."""
    return _nearest(spark, d, ties=True).select("polygon_id", "permit_id", "join_distance_m")


@query("near_pairs", with_views(["detection"], """
, c AS (SELECT tile, x1+x2 AS hx, y1+y2 AS hy, count(*) AS n FROM detection GROUP BY ALL)
SELECT a.tile, a.hx AS ax, a.hy AS ay, b.hx AS bx, b.hy AS "by", a.n AS n_a, b.n AS n_b
FROM c a JOIN c b ON a.tile = b.tile AND (b.hx > a.hx OR (b.hx = a.hx AND b.hy > a.hy))
 AND (b.hx-a.hx)*(b.hx-a.hx) + (b.hy-a.hy)*(b.hy-a.hy) < 24*24"""))
def near_pairs(spark, d):
    return S.close_centers(S.box_centers(T.detection(spark, d)), 12)


@query("merge_boxes", with_views(["detection"], """
, link AS (SELECT a.det_id AS p, b.det_id AS q FROM detection a JOIN detection b ON a.tile = b.tile
   AND (a.x1+a.x2-b.x1-b.x2)*(a.x1+a.x2-b.x1-b.x2) + (a.y1+a.y2-b.y1-b.y2)*(a.y1+a.y2-b.y1-b.y2) < 24*24)
, reach(p, q) AS (SELECT p, q FROM link UNION SELECT r.p, l.q FROM reach r JOIN link l ON l.p = r.q)
, root AS (SELECT p AS det_id, min(q) AS merged_id FROM reach GROUP BY p)
SELECT merged_id, min(tile) AS tile, count(*) AS boxes, sum((x2-x1)*(y2-y1))::BIGINT AS area_px, min(x1) AS x1,
  min(y1) AS y1, max(x2) AS x2, max(y2) AS y2
FROM detection JOIN root USING (det_id) GROUP BY merged_id""", recursive=True))
def merge_boxes(spark, d):
    return M.merge_boxes(T.detection(spark, d))


# --- rasters ---------------------------------------------------------------------------
_DEMAND = """
, dem AS (SELECT *, (CASE code WHEN 1 THEN 150 WHEN 24 THEN 90 WHEN 21 THEN 80 WHEN 4 THEN 100
     WHEN 37 THEN 60 WHEN 42 THEN 120 ELSE 0 END)::FLOAT AS nd,
   (CASE code WHEN 1 THEN 60 WHEN 5 THEN 45 WHEN 24 THEN 40 WHEN 21 THEN 35 WHEN 4 THEN 40
     WHEN 36 THEN 50 WHEN 37 THEN 30 WHEN 42 THEN 80 ELSE 0 END)::FLOAT AS pd FROM raster)
"""
_MASKED = """
, hit AS (SELECT tile_id, row, col, shape, count(*) AS crossings FROM raster JOIN edge USING (tile_id)
   WHERE (ay <= row + 0.5::DOUBLE) <> (b_y <= row + 0.5::DOUBLE)
    AND ax + (row + 0.5::DOUBLE - ay)*(bx - ax)/(b_y - ay) > col + 0.5::DOUBLE
   GROUP BY ALL)
, inside AS (SELECT DISTINCT tile_id, row, col FROM hit WHERE crossings % 2 = 1)
, dmap AS (SELECT d.tile_id, d.row, d.col, i.tile_id IS NOT NULL AS masked,
    CASE WHEN i.tile_id IS NULL THEN nd ELSE 0::FLOAT END AS n_demand,
    CASE WHEN i.tile_id IS NULL THEN pd ELSE 0::FLOAT END AS p_demand
  FROM dem d LEFT JOIN inside i ON i.tile_id = d.tile_id AND i.row = d.row AND i.col = d.col)
"""


@query("raster_profile", with_views(["raster"], """
SELECT tile_id, count(*) AS pixels, max(row) + 1 AS rows, max(col) + 1 AS cols,
  count(DISTINCT code) AS codes FROM raster GROUP BY tile_id"""))
def raster_profile(spark, d):
    return P.profile(T.raster(spark, d))


@query("crop_demand", with_views(["raster"], _DEMAND + """
SELECT tile_id, row, col, nd::DOUBLE AS n_demand, pd::DOUBLE AS p_demand FROM dem"""))
def crop_demand(spark, d):
    out = P.with_demand(T.raster(spark, d))
    return _as_double(out.select("tile_id", "row", "col", "n_demand", "p_demand"))


def _as_double(df):
    return df.withColumns({c: F.col(c).cast("double") for c in ("n_demand", "p_demand")})


@query("crop_demand_blocks", with_views(["raster"], _DEMAND + """
SELECT tile_id, row, col, nd::DOUBLE AS n_demand, pd::DOUBLE AS p_demand FROM dem"""))
def crop_demand_blocks(spark, d):
    return _pixels_of(P.block_demand(P.to_blocks(T.raster(spark, d))))


def _pixels_of(blocks):
    zipped = F.arrays_zip("codes", "n_demand", "p_demand")
    out = blocks.select(
        "tile_id", "row", "col0", F.posexplode(zipped).alias("i", "v")
    ).filter("v.codes is not null")
    return _as_double(out.select(
        "tile_id", "row", (F.col("col0") + F.col("i")).alias("col"),
        F.col("v.n_demand").alias("n_demand"), F.col("v.p_demand").alias("p_demand"),
    ))


@query("setback_mask", with_views(["raster", "edge"], _DEMAND + _MASKED + """
SELECT tile_id, row, col, masked FROM dmap"""))
def setback_mask(spark, d):
    out = P.with_setback(T.raster(spark, d), T.setback(spark, d), TILE_ROWS, TILE_COLS)
    return out.select("tile_id", "row", "col", "masked")


@query("setback_runs", with_views(["raster", "edge"], """
, grid AS (SELECT DISTINCT tile_id FROM raster)
, px AS (SELECT tile_id, r.range::INTEGER AS row, c.range::INTEGER AS col
   FROM grid, range(100) r, range(100) c)
, hit AS (SELECT tile_id, row, col, shape, count(*) AS crossings FROM px JOIN edge USING (tile_id)
   WHERE (ay <= row + 0.5::DOUBLE) <> (b_y <= row + 0.5::DOUBLE)
    AND ax + (row + 0.5::DOUBLE - ay)*(bx - ax)/(b_y - ay) > col + 0.5::DOUBLE
   GROUP BY ALL HAVING count(*) % 2 = 1)
, isl AS (SELECT *, col - row_number() OVER (PARTITION BY tile_id, shape, row ORDER BY col) AS g FROM hit)
SELECT (tile_id*100 + shape)::BIGINT AS polygon_id, row, min(col) AS col_start, max(col) AS col_end
FROM isl GROUP BY tile_id, shape, row, g"""))
def setback_runs(spark, d):
    runs = P.polygon_runs(T.setback(spark, d), TILE_ROWS, TILE_COLS)
    return runs.select("polygon_id", "row", "col_start", "col_end")


def demand(spark, d):
    return P.demand_map(T.raster(spark, d), T.setback(spark, d), TILE_ROWS, TILE_COLS)


@query("demand_map", with_views(["raster", "edge"], _DEMAND + _MASKED + """
SELECT tile_id, row, col, n_demand::DOUBLE AS n_demand, p_demand::DOUBLE AS p_demand FROM dmap"""))
def demand_map(spark, d):
    return _as_double(demand(spark, d).select("tile_id", "row", "col", "n_demand", "p_demand"))


@query("demand_map_blocks", with_views(["raster", "edge"], _DEMAND + _MASKED + """
SELECT tile_id, row, col, n_demand::DOUBLE AS n_demand, p_demand::DOUBLE AS p_demand FROM dmap"""))
def demand_map_blocks(spark, d):
    blocks = P.to_blocks(T.raster(spark, d))
    return _pixels_of(P.block_demand_map(blocks, T.setback(spark, d), TILE_ROWS, TILE_COLS))


@query("demand_stats", with_views(["raster", "edge"], _DEMAND + _MASKED + """
SELECT tile_id, count(*) AS pixels, min(n_demand)::DOUBLE AS n_min, max(n_demand)::DOUBLE AS n_max,
  min(p_demand)::DOUBLE AS p_min, max(p_demand)::DOUBLE AS p_max,
  count(*) FILTER (WHERE n_demand > 0) AS n_positive, count(*) FILTER (WHERE p_demand > 0) AS p_positive,
  count(*) FILTER (WHERE masked) AS masked_pixels,
  round(count(*) FILTER (WHERE masked) * 100.0::DOUBLE / count(*), 6) AS masked_pct
FROM dmap GROUP BY tile_id"""))
def demand_stats(spark, d):
    return P.demand_stats(demand(spark, d))


@query("crop_acreage", with_views(["raster"], """
SELECT code, count(*) AS pixels, round(count(*) * (900.0::DOUBLE/4046.8564224::DOUBLE), 6) AS acres FROM raster
WHERE -76.5::DOUBLE + 0.03::DOUBLE*tile_id + 0.0003::DOUBLE*(col + 0.5::DOUBLE) BETWEEN -76.49::DOUBLE AND -76.4::DOUBLE
 AND 39.0::DOUBLE + -0.0003::DOUBLE*(row + 0.5::DOUBLE) BETWEEN 38.975::DOUBLE AND 38.995::DOUBLE
GROUP BY code"""))
def crop_acreage(spark, d):
    return P.crop_acreage(
        T.raster(spark, d), -76.49, 38.975, -76.4, 38.995, T.tile_grid_of(F.col("tile_id")), 900.0
    )


_HSV = """
, hsv AS (SELECT *, greatest(r, g, b)::INTEGER AS v, CASE WHEN greatest(r, g, b) = 0 THEN 0 ELSE
   round((greatest(r, g, b) - least(r, g, b)) * 255.0::DOUBLE / greatest(r, g, b))::INTEGER END AS s FROM rgb)
, roof AS (SELECT tile_id, row, col FROM hsv WHERE v > 140 AND s < 60)
, water AS (SELECT tile_id, row, col FROM hsv WHERE g - r > 24 AND b - r > 18 AND v > 80 AND v < 235)
"""


def rgb_cols():
    return F.col("r"), F.col("g"), F.col("b")


@query("roof_pixels", with_views(["rgb"], _HSV + "SELECT tile_id, row, col FROM roof"))
def roof_pixels(spark, d):
    return T.rgb(spark, d).filter(P.is_roof(*rgb_cols())).select("tile_id", "row", "col")


@query("water_pixels", with_views(["rgb"], _HSV + "SELECT tile_id, row, col FROM water"))
def water_pixels(spark, d):
    return T.rgb(spark, d).filter(P.is_water(*rgb_cols())).select("tile_id", "row", "col")


def _grow(name: str, src: str, radius: int) -> str:
    o = ", ".join(str(i) for i in range(-radius, radius + 1))
    return f"""
, {name} AS (SELECT DISTINCT p.tile_id, p.row, p.col FROM (
   SELECT tile_id, row + dr AS row, col + dc AS col FROM {src},
    (SELECT unnest([{o}]) AS dr), (SELECT unnest([{o}]) AS dc)) g JOIN rgb p USING (tile_id, row, col))
"""


def _not(name: str, src: str) -> str:
    return f"""
, {name} AS (SELECT tile_id, row, col FROM rgb EXCEPT SELECT tile_id, row, col FROM {src})
"""


_CLEAN_ROOF = (
    _HSV + _grow("r1", "roof", 1) + _not("r1n", "r1") + _grow("r2n", "r1n", 1) + _not("r2", "r2n")
    + _not("r3n", "r2") + _grow("r4n", "r3n", 1) + _not("r4", "r4n") + _grow("r5", "r4", 1)
)
_CLEAN_WATER = (
    _grow("w1", "water", 3) + _not("w1n", "w1") + _grow("w2n", "w1n", 3) + _not("w2", "w2n")
)


def clean_roof(spark, d):
    words = P.pack(T.rgb(spark, d), P.is_roof(*rgb_cols()))
    return P.open_mask(P.close_mask(words, 3), 3)


def clean_water(spark, d):
    return P.close_mask(P.pack(T.rgb(spark, d), P.is_water(*rgb_cols())), 7)


@query("mask_morphology", with_views(["rgb"], _CLEAN_ROOF + _CLEAN_WATER + """
SELECT 'roof' AS mask, tile_id, row, col FROM r5 UNION ALL SELECT 'water', tile_id, row, col FROM w2"""))
def mask_morphology(spark, d):
    one = lambda name, words: P.unpack(words).select(F.lit(name).alias("mask"), "tile_id", "row", "col")
    return one("roof", clean_roof(spark, d)).unionByName(one("water", clean_water(spark, d)))


@query("mask_regions", with_views(["rgb"], _CLEAN_ROOF + """
, isl AS (SELECT *, col - row_number() OVER (PARTITION BY tile_id, row ORDER BY col) AS g FROM r5)
, run AS (SELECT tile_id, row, min(col) AS c0, max(col) AS c1,
   {'t': tile_id, 'r': row, 'c': min(col)} AS id FROM isl GROUP BY tile_id, row, g)
, link AS (SELECT a.id AS p, b.id AS q FROM run a JOIN run b ON a.tile_id = b.tile_id
   AND abs(a.row - b.row) <= 1 AND a.c0 <= b.c1 + 1 AND b.c0 <= a.c1 + 1)
, reach(p, q) AS (SELECT p, q FROM link UNION SELECT r.p, l.q FROM reach r JOIN link l ON l.p = r.q)
, root AS (SELECT p AS id, min(q) AS region_id FROM reach GROUP BY p)
SELECT region_id.t AS tile_id, region_id.r AS first_row, region_id.c AS first_col, min(row) AS row_min, max(row) AS row_max, min(c0) AS col_min,
  max(c1) AS col_max, sum(c1 - c0 + 1)::BIGINT AS area_px FROM run JOIN root USING (id) GROUP BY region_id""",
    recursive=True))
def mask_regions(spark, d):
    return P.regions(clean_roof(spark, d))


@query("mask_bbox", with_views(["raster"], """
SELECT tile_id, code, count(*) AS area_px, min(row) AS row_min, max(row) AS row_max,
  min(col) AS col_min, max(col) AS col_max FROM raster GROUP BY tile_id, code"""))
def mask_bbox(spark, d):
    return P.extents(T.raster(spark, d), "tile_id", "code")


@query("mask_area", with_views(["raster"], """
SELECT tile_id, row // 10 AS band, code, count(*) AS area_px FROM raster
GROUP BY ALL HAVING count(*) >= 100"""))
def mask_area(spark, d):
    masks = T.raster(spark, d).withColumn("band", F.floor(F.col("row") / 10).cast("int"))
    return P.large_masks(P.extents(masks, "tile_id", "band", "code")).select(
        "tile_id", "band", "code", "area_px"
    )


# --- embeddings ----------------------------------------------------------------------------
_REF = """
, el AS (SELECT label, unnest(range(64)) AS pos, unnest(vector)::DOUBLE AS v FROM embedding
   WHERE vector IS NOT NULL)
, ref AS (SELECT label, pos, avg(v) AS m, count(*) AS n FROM el GROUP BY label, pos)
"""
_SCORE = _REF + """
, prod AS (SELECT vec_id, unnest(range(64)) AS pos, unnest(vector)::DOUBLE AS v FROM embedding
    WHERE vector IS NOT NULL)
, cosv AS (SELECT vec_id, CASE WHEN sum(v*v) = 0 OR sum(m*m) = 0 THEN 0 ELSE
    sum(v*m)/(sqrt(sum(v*v))*sqrt(sum(m*m))) END AS score
   FROM prod JOIN ref USING (pos) WHERE ref.label = 0 GROUP BY vec_id)
, scored AS (SELECT e.vec_id, coalesce(score, 0.5::DOUBLE) AS score FROM embedding e
    LEFT JOIN cosv USING (vec_id))
"""


@query("reference_vectors", with_views(["embedding"], _REF + """
SELECT label, pos::INTEGER AS pos, n, round(m, 9) AS mean FROM ref"""))
def reference_vectors(spark, d):
    means = V.mean_vectors(T.embedding(spark, d), "label", "vector")
    out = means.select("label", "n", F.posexplode("mean").alias("pos", "mean"))
    return out.select("label", "pos", "n", F.round("mean", 9).alias("mean"))


def facility_reference(spark, d):
    means = V.mean_vectors(T.embedding(spark, d), "label", "vector")
    return V.reference_vector(means, "label", 0)


@query("cosine_score", with_views(["embedding"], _SCORE + """
SELECT vec_id, round(score, 9) AS score FROM cosv"""))
def cosine_score(spark, d):
    known = T.embedding(spark, d).filter("vector is not null")
    scored = V.classify(known, facility_reference(spark, d))
    return scored.select("vec_id", F.round("ae_score", 9).alias("score"))


@query("embedding_classify", with_views(["embedding"], _SCORE + """
SELECT vec_id, round(score, 9) AS ae_score, score >= 0.10::DOUBLE AS ae_is_afo,
  score < 0.10::DOUBLE AS ae_filtered FROM scored"""))
def embedding_classify(spark, d):
    out = V.classify(T.embedding(spark, d), facility_reference(spark, d), threshold=0.10)
    return out.select("vec_id", F.round("ae_score", 9).alias("ae_score"), "ae_is_afo", "ae_filtered")


@query("embedding_validated", with_views(["embedding"], _SCORE + """
SELECT vec_id FROM scored WHERE score >= 0.10::DOUBLE"""))
def embedding_validated(spark, d):
    out = V.classify(T.embedding(spark, d), facility_reference(spark, d), threshold=0.10)
    return V.validated(out).select("vec_id")


@query("embedding_no_reference", with_views(["embedding"], """
SELECT vec_id, 1.0::DOUBLE AS ae_score, true AS ae_is_afo, false AS ae_filtered FROM embedding"""))
def embedding_no_reference(spark, d):
    return V.classify(T.embedding(spark, d), None).select(
        "vec_id", "ae_score", "ae_is_afo", "ae_filtered"
    )
