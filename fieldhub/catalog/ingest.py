"""Registry ingest, text cleaning, permit filters, geocoding tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldhub.catalog.registry import query
from fieldhub.fixtures import tables as T
from fieldhub.fixtures.views import with_views
from fieldhub.functions import geo, nutrient, text
from fieldhub.operators import registry as R

_ALIAS_SQL = """CASE lower(trim(animal_type))
  WHEN 'broiler chicken' THEN 'broiler_chicken' WHEN 'turkey' THEN 'turkey'
  WHEN 'dairy' THEN 'dairy_cattle' WHEN 'hog' THEN 'swine' ELSE lower(trim(animal_type)) END"""
_N_MILLI = "CASE {a} WHEN 'broiler_chicken' THEN 5915 WHEN 'turkey' THEN 7200 WHEN 'dairy_cattle' THEN 168000 WHEN 'swine' THEN 24000 ELSE 0 END"
_P_MILLI = "CASE {a} WHEN 'broiler_chicken' THEN 4095 WHEN 'turkey' THEN 5400 WHEN 'dairy_cattle' THEN 96000 WHEN 'swine' THEN 18000 ELSE 0 END"


def _tenths(milli: str) -> str:
    """Thousandths to one decimal, ties to even, in integer arithmetic."""
    return (
        f"(({milli}) // 100 + CASE WHEN ({milli}) % 100 > 50 OR (({milli}) % 100 = 50 "
        f"AND (({milli}) // 100) % 2 = 1) THEN 1 ELSE 0 END) / 10.0::DOUBLE"
    )


SUPPLY_CTE = f"""
, canon AS (SELECT *, {_ALIAS_SQL} AS animal FROM permit)
, supply AS (SELECT *, {_tenths("headcount * " + _N_MILLI.format(a="animal"))} AS annual_n_lbs,
   {_tenths("headcount * " + _P_MILLI.format(a="animal"))} AS annual_p2o5_lbs FROM canon)
"""

_STD_COUNT = """coalesce(trunc(try_cast(animals_text AS DOUBLE)), 0)::BIGINT"""


@query("coerce_numeric", with_views(["registry"], f"""
SELECT permit_id, {_STD_COUNT} AS headcount FROM registry"""))
def coerce_numeric(spark, d):
    raw = R.normalise_names(T.raw_registry(spark, d))
    return raw.select(
        F.col("permit_id").cast("bigint").alias("permit_id"),
        text.to_count(F.col("number_of_animals")).alias("headcount"),
    )


_ARGMAX_SQL = """
SELECT permit_id, greatest(laying_hens, dairy_cattle, ducks) AS headcount,
  CASE WHEN greatest(laying_hens, dairy_cattle, ducks) = 0 THEN 'unknown'
    WHEN laying_hens >= dairy_cattle AND laying_hens >= ducks THEN 'laying_hens'
    WHEN dairy_cattle >= ducks THEN 'dairy_cattle' ELSE 'ducks' END AS animal_type
FROM registry"""


@query("animal_argmax", with_views(["registry"], _ARGMAX_SQL))
def animal_argmax(spark, d):
    permits = R.parse_permits(T.raw_registry(spark, d, wide=True), "permit_id")
    return permits.select("permit_id", "headcount", "animal_type")


@query("headcount_mode", with_views(["registry"], f"""
SELECT permit_id,
  CASE WHEN (SELECT sum({_STD_COUNT}) FROM registry) > 0 THEN {_STD_COUNT} ELSE 0 END AS headcount,
  CASE WHEN (SELECT sum({_STD_COUNT}) FROM registry) > 0 THEN lower(trim(animal_type))
    ELSE 'unknown' END AS animal_type
FROM registry"""))
def headcount_mode(spark, d):
    permits = R.parse_permits(T.raw_registry(spark, d), "permit_id")
    return permits.select("permit_id", "headcount", "animal_type")


@query("clean_text", with_views(["permit"], """
SELECT permit_id, trim(farm_name) AS farm_name, upper(trim(designation)) AS designation,
  trim(status) AS status, trim(county) AS county, lower(trim(animal_type)) AS animal_type
FROM permit"""))
def clean_text(spark, d):
    permits = R.parse_permits(T.raw_registry(spark, d), "permit_id", assume_standard=True)
    return permits.select("permit_id", "farm_name", "designation", "status", "county", "animal_type")


@query("city_zip", with_views(["permit"], """
SELECT permit_id, trim(split_part(city_state_zip, ',', 1)) AS city,
  regexp_extract(city_state_zip, '([0-9]{5})', 1) AS zip_code FROM permit"""))
def city_zip(spark, d):
    permits = R.parse_permits(T.raw_registry(spark, d), "permit_id", assume_standard=True)
    return permits.select("permit_id", "city", "zip_code")


@query("permit_points", with_views(["permit"], """
SELECT permit_id, longitude, latitude, longitude IS NOT NULL AND latitude IS NOT NULL AS located
FROM permit"""))
def permit_points(spark, d):
    permits = R.parse_permits(T.raw_registry(spark, d), "permit_id", assume_standard=True)
    return permits.select("permit_id", "longitude", "latitude", R.is_located().alias("located"))


@query("canonical_animal", with_views(["permit"], f"""
SELECT permit_id, {_ALIAS_SQL} AS animal FROM permit"""))
def canonical_animal(spark, d):
    return T.permit(spark, d).select(
        "permit_id", text.canonical_animal(F.col("animal_type")).alias("animal")
    )


@query("nutrient_supply", with_views(["permit"], SUPPLY_CTE + """
SELECT permit_id, animal, headcount, annual_n_lbs, annual_p2o5_lbs FROM supply"""))
def nutrient_supply(spark, d):
    return with_supply(T.permit(spark, d)).select(
        "permit_id", "animal", "headcount", "annual_n_lbs", "annual_p2o5_lbs"
    )


def with_supply(permits):
    animal, heads = F.col("animal"), F.col("headcount")
    return permits.withColumn("animal", text.canonical_animal(F.col("animal_type"))).withColumns({
        "annual_n_lbs": nutrient.nitrogen_lbs(animal, heads),
        "annual_p2o5_lbs": nutrient.phosphate_lbs(animal, heads),
    })


@query("supply_totals", with_views(["permit"], SUPPLY_CTE + """
SELECT count(*) AS facilities, round(sum(annual_n_lbs), 1) AS total_n_lbs,
  round(sum(annual_p2o5_lbs), 1) AS total_p2o5_lbs FROM supply"""))
def supply_totals(spark, d):
    return with_supply(T.permit(spark, d)).agg(
        F.count(F.lit(1)).alias("facilities"),
        F.round(F.sum("annual_n_lbs"), 1).alias("total_n_lbs"),
        F.round(F.sum("annual_p2o5_lbs"), 1).alias("total_p2o5_lbs"),
    )


@query("active_permits", with_views(["permit"], """
SELECT permit_id, status, county, headcount FROM permit WHERE status IN ('Registered', 'Pending',
 'Notice of Preliminary Approval', 'Issued', 'Administratively Extended')"""))
def active_permits(spark, d):
    return R.active(T.permit(spark, d)).select("permit_id", "status", "county", "headcount")


@query("county_filter", with_views(["permit"], """
SELECT permit_id, county FROM permit WHERE contains(lower(county), 'co')"""))
def county_filter(spark, d):
    return R.in_county(T.permit(spark, d), "CO").select("permit_id", "county")


@query("region_filter", with_views(["permit"], """
SELECT 'eastern-shore' AS region, permit_id FROM permit WHERE county IN ('Worcester', 'Wicomico',
  'Caroline', 'Somerset', 'Dorchester', 'Queen Anne''s', 'Kent', 'Talbot')
UNION ALL SELECT 'full-state', permit_id FROM permit
UNION ALL SELECT 'Cecil', permit_id FROM permit WHERE county = 'Cecil'"""))
def region_filter(spark, d):
    permits = T.permit(spark, d)
    one = lambda region: R.in_region(permits, region).select(
        F.lit(region).alias("region"), "permit_id"
    )
    return one("eastern-shore").unionByName(one("full-state")).unionByName(one("Cecil"))


@query("located_permits", with_views(["located"], """
SELECT permit_id, longitude, latitude FROM located"""))
def located_permits(spark, d):
    return R.located(T.permit(spark, d)).select("permit_id", "longitude", "latitude")


@query("placeholder_permits", with_views(["permit"], """
SELECT permit_id, longitude, latitude FROM permit
WHERE round(latitude*100) = 3880 AND round(longitude*100) = -7580"""))
def placeholder_permits(spark, d):
    return T.permit(spark, d).filter(R.is_placeholder()).select(
        "permit_id", "longitude", "latitude"
    )


@query("first_n", with_views(["permit"], """
SELECT permit_id, headcount FROM permit ORDER BY permit_id LIMIT 25"""))
def first_n(spark, d):
    return R.first_rows(T.permit(spark, d).select("permit_id", "headcount"), 25, "permit_id")


@query("explore", with_views(["permit"], """
SELECT permit_id, county, animal_type, headcount, status FROM permit
WHERE county IN ('Kent', 'Cecil', 'Talbot') AND animal_type IN ('dairy', 'hog')
 AND headcount BETWEEN 10000 AND 300000 AND status IN ('Registered', 'Issued', 'Pending')"""))
def explore(spark, d):
    return R.explore(
        T.permit(spark, d),
        counties=["Kent", "Cecil", "Talbot"],
        animals=["dairy", "hog"],
        headcount=(10_000, 300_000),
        statuses=["Registered", "Issued", "Pending"],
    ).select("permit_id", "county", "animal_type", "headcount", "status")


@query("geocode_requests", with_views(["permit"], """
SELECT permit_id, batch, '"' || permit_id || '","' || trim(address) || '","' ||
  trim(split_part(city_state_zip, ',', 1)) || '","MD","' ||
  regexp_extract(city_state_zip, '([0-9]{5})', 1) || '"' AS line
FROM (SELECT *, (row_number() OVER (ORDER BY permit_id) - 1) // 9999 AS batch FROM permit)
WHERE lower(trim(address)) NOT IN ('', 'nan', 'unknown')"""))
def geocode_requests(spark, d):
    permits = R.parse_permits(T.raw_registry(spark, d), "permit_id", assume_standard=True)
    return R.geocode_requests(permits)


@query("geocode_place_requests", with_views(["permit"], """
, part AS (SELECT permit_id, coalesce(trim(address), '') AS address, (row_number() OVER (ORDER BY permit_id) - 1) // 9999 AS batch,
   coalesce(trim(split_part(city_state_zip, ',', 1)), '') AS city,
   coalesce(regexp_extract(city_state_zip, '([0-9]{5})', 1), '') AS zip FROM permit)
SELECT permit_id, batch, permit_id || ',' || address || ',' || city || ',MD,' || zip AS line
FROM part WHERE city <> '' OR zip <> ''"""))
def geocode_place_requests(spark, d):
    permits = R.parse_permits(T.raw_registry(spark, d), "permit_id", assume_standard=True)
    return R.geocode_place_requests(permits)


@query("geocode_response", with_views(["reply"], """
SELECT id, lat, lon FROM reply WHERE matched AND NOT malformed"""))
def geocode_response(spark, d):
    return R.parse_geocode_replies(T.geocode_reply(spark, d))


_UPDATED_SQL = """
, upd AS (SELECT p.permit_id, p.latitude AS old_lat,
    r.id IS NOT NULL AND p.latitude IS NULL AS geocoded,
    CASE WHEN p.latitude IS NULL THEN r.lat ELSE p.latitude END AS latitude,
    CASE WHEN p.longitude IS NULL THEN r.lon ELSE p.longitude END AS longitude
  FROM permit p LEFT JOIN (SELECT * FROM reply WHERE matched AND NOT malformed) r
    ON r.id = p.permit_id)
"""


def _updated(spark, d):
    permits = T.permit(spark, d)
    replies = R.parse_geocode_replies(T.geocode_reply(spark, d))
    return permits, R.apply_geocodes(permits, replies, only=~R.is_located())


@query("geocode_update", with_views(["permit", "reply"], _UPDATED_SQL + """
SELECT permit_id, latitude, longitude, geocoded FROM upd"""))
def geocode_update(spark, d):
    _, after = _updated(spark, d)
    return after.select("permit_id", "latitude", "longitude", "geocoded")


@query("geocode_placeholders", with_views(["permit", "reply"], """
SELECT p.permit_id, coalesce(r.lat, p.latitude) AS latitude, coalesce(r.lon, p.longitude) AS longitude
FROM permit p LEFT JOIN reply r ON r.id = p.permit_id AND r.matched AND NOT r.malformed
  AND round(p.latitude*100) = 3880 AND round(p.longitude*100) = -7580"""))
def geocode_placeholders(spark, d):
    replies = R.parse_geocode_replies(T.geocode_reply(spark, d))
    out = R.apply_geocodes(T.permit(spark, d), replies, only=R.is_placeholder())
    return out.select("permit_id", "latitude", "longitude")


@query("geocode_coverage", with_views(["permit", "reply"], _UPDATED_SQL + """
SELECT count(*) AS total, count(old_lat) AS located_before,
  count(*) FILTER (WHERE geocoded) AS newly_geocoded, count(latitude) AS located_after,
  count(*) - count(latitude) AS still_missing,
  round(count(latitude) * 100.0::DOUBLE / count(*), 6) AS coverage_pct FROM upd"""))
def geocode_coverage(spark, d):
    before, after = _updated(spark, d)
    return R.geocode_coverage(before, after)


def tile_keys(permits):
    """One tile name per located permit, from its index and box corner."""
    b = R.target_boxes(permits)
    return b.select(
        "permit_id",
        F.format_string(
            "naip_%06d_%.4f_%.4f.tif", "permit_id", F.col("box.west"), F.col("box.south")
        ).alias("tile_key"),
    )


_TILE_KEY_SQL = """
, tile AS (SELECT permit_id, printf('naip_%06d_%.4f_%.4f.tif', permit_id,
    longitude - 2.0::DOUBLE/(111.0::DOUBLE*cos(radians(latitude))),
    latitude - 2.0::DOUBLE/111.0::DOUBLE) AS tile_key FROM located)
"""


@query("tile_key", with_views(["located"], _TILE_KEY_SQL + """
SELECT permit_id, tile_key FROM tile"""))
def tile_key(spark, d):
    return tile_keys(T.permit(spark, d))


@query("pending_tiles", with_views(["located"], _TILE_KEY_SQL + """
SELECT tile_key, permit_id FROM tile WHERE tile_key NOT IN (
  SELECT tile_key FROM tile JOIN events ON event_id = permit_id WHERE event_type = 'click')"""))
def pending_tiles(spark, d):
    wanted = tile_keys(T.permit(spark, d))
    fetched = T.read(spark, d, "events").filter(F.col("event_type") == "click")
    existing = wanted.join(fetched, wanted["permit_id"] == fetched["event_id"], "left_semi")
    return R.pending(wanted, existing)


@query("extract_url", """
SELECT page_id, nullif(trim(regexp_extract(html, '<title>(.*?)</title>', 1)), '') AS found
FROM pages""")
def extract_url(spark, d):
    pages = T.read(spark, d, "pages")
    return pages.select("page_id", text.tagged_text(F.col("html"), "title").alias("found"))


@query("return_url", """
WITH reply AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '<r><returnURL> ' || url || ' </returnURL></r>'
   WHEN 1 THEN '{"returnURL" : "' || url || '"}' ELSE html END AS body FROM pages)
SELECT page_id, trim(coalesce(nullif(regexp_extract(body, '<returnURL>(.*?)</returnURL>', 1), ''),
  nullif(regexp_extract(body, '"returnURL"\\s*:\\s*"(.*?)"', 1), ''))) AS url FROM reply""")
def return_url(spark, d):
    """The service's reply holds the download address as XML or JSON, or not at all."""
    part = F.col("page_id") % 3
    body = F.when(part == 0, F.concat(F.lit("<r><returnURL> "), "url", F.lit(" </returnURL></r>"))).when(
        part == 1, F.concat(F.lit('{"returnURL" : "'), "url", F.lit('"}'))
    ).otherwise(F.col("html"))
    return T.read(spark, d, "pages").select("page_id", text.return_url(body).alias("url"))


@query("class_label", with_views(["detection"], """
SELECT det_id, CASE class_id WHEN 0 THEN 'poultry_house' WHEN 1 THEN 'barn'
  WHEN 2 THEN 'manure_lagoon' WHEN 3 THEN 'feedlot' WHEN 4 THEN 'silo'
  ELSE 'class_' || class_id END AS class_name FROM detection"""))
def class_label(spark, d):
    return T.detection(spark, d).select(
        "det_id", text.class_label(F.col("class_id")).alias("class_name")
    )
