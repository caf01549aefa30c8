"""Distributions, county profiles, hub tables and report lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldhub.catalog.registry import query
from fieldhub.catalog.siting import facilities
from fieldhub.fixtures import tables as T
from fieldhub.fixtures.views import with_views
from fieldhub.functions import nutrient
from fieldhub.operators import profiles as A
from fieldhub.operators import registry as R
from fieldhub.operators import siting as G
from fieldhub.plans import reports, scenarios

R6 = lambda c: F.round(c, 6).alias(c)


_BATCHES: dict[tuple[str, str], scenarios.Scenarios] = {}


def batch(spark, d) -> scenarios.Scenarios:
    """The siting runs of all scenario sizes; kept as long as their stored assignments are.

    All scenarios have the same room per hub, 9 % of all animals, so the small ones leave facilities out.
    """
    key = spark.sparkContext.applicationId, d
    found = _BATCHES.get(key)
    if found is None or not found.stored():
        permits = T.permit(spark, d)
        room = (R.located(permits).agg(F.sum("headcount")).first()[0] or 0) * 9 // 100
        found = _BATCHES[key] = scenarios.run(permits, T.SCENARIOS, room)
    return found


def assignment(spark, d):
    """The facilities of every scenario with their hub, -1 where none has room."""
    return batch(spark, d).assignments


def scenario_sites(spark, d):
    """(n_hubs, site_id, x, y): the hubs of each scenario."""
    return batch(spark, d).sites


def ten_hubs(spark, d):
    return assignment(spark, d).filter("n_hubs = 10")


@query("animal_distribution", with_views(["permit"], """
SELECT animal_type, count(*) AS facilities, sum(headcount)::BIGINT AS animals,
  round(sum(headcount)*100.0::DOUBLE/(SELECT sum(headcount) FROM permit), 6) AS pct
FROM permit GROUP BY animal_type ORDER BY animals DESC LIMIT 5"""))
def animal_distribution(spark, d):
    out = A.top(A.distribution(T.permit(spark, d), "animal_type"), 5, F.desc("animals"), F.col("animal_type"))
    return out.withColumn("pct", F.round("pct", 6))


@query("animal_share", with_views(["permit"], """
SELECT animal_type, sum(headcount)::BIGINT AS animals,
  round_even(sum(headcount)*100.0::DOUBLE/(SELECT sum(headcount) FROM permit), 1) AS pct
FROM permit GROUP BY animal_type"""))
def animal_share(spark, d):
    out = A.distribution(T.permit(spark, d), "animal_type")
    return out.select("animal_type", "animals", F.bround("pct", 1).alias("pct"))


@query("county_distribution", with_views(["permit"], """
SELECT county, count(*) AS facilities, sum(headcount)::BIGINT AS animals,
  round(sum(headcount)*100.0::DOUBLE/(SELECT sum(headcount) FROM permit), 6) AS pct
FROM permit GROUP BY county ORDER BY animals DESC LIMIT 10"""))
def county_distribution(spark, d):
    out = A.top(A.distribution(T.permit(spark, d), "county"), 10, F.desc("animals"), F.col("county"))
    return out.withColumn("pct", F.round("pct", 6))


_SIZE = """CASE WHEN headcount > 1000000 THEN '>1M' WHEN headcount > 100000 THEN '100K-1M'
 WHEN headcount > 10000 THEN '10K-100K' WHEN headcount > 1000 THEN '1K-10K' WHEN headcount > 0 THEN '<1K' END"""


@query("size_bins", with_views(["permit"], f"""
SELECT permit_id, {_SIZE} AS size_class FROM permit"""))
def size_bins(spark, d):
    return T.permit(spark, d).select(
        "permit_id", nutrient.size_label(F.col("headcount")).alias("size_class")
    )


_HIST = f"""
, cls AS (SELECT unnest(range(5))::INTEGER AS ord, unnest(['<1K','1K-10K','10K-100K','100K-1M','>1M']) AS size_class)
, cnt AS (SELECT {_SIZE} AS size_class, count(*) AS facilities FROM permit GROUP BY 1)
, hist AS (SELECT ord, size_class, coalesce(facilities, 0) AS facilities,
  coalesce(facilities, 0)*100.0::DOUBLE/(SELECT count(*) FROM permit) AS pct FROM cls LEFT JOIN cnt USING (size_class))
"""


@query("size_histogram", with_views(["permit"], _HIST + """
SELECT ord, size_class, facilities, round(pct, 6) AS pct FROM hist"""))
def size_histogram(spark, d):
    return A.size_histogram(T.permit(spark, d)).withColumn("pct", F.round("pct", 6))


@query("quality_profile", with_views(["permit"], """
SELECT count(*) AS records, count(latitude) AS located, count(*) - count(latitude) AS missing,
  count(*) FILTER (WHERE headcount > 0) AS with_headcount, sum(headcount)::BIGINT AS animals FROM permit"""))
def quality_profile(spark, d):
    return A.quality(T.permit(spark, d))


_COUNTY = """
, county AS (SELECT county, count(*) AS facilities, sum(headcount)::BIGINT AS animals,
   count(*) FILTER (WHERE headcount > 100000) AS industrial,
   sum(headcount)*100.0::DOUBLE/(SELECT sum(headcount) FROM permit) AS pct_of_state,
   sum(headcount)/count(*) AS avg_per_facility FROM permit GROUP BY county)
, lead10 AS (SELECT * FROM county ORDER BY animals DESC, county LIMIT 10)
, prio AS (SELECT *, facilities/100 AS density_score, animals/10000000 AS volume_score,
   industrial*100.0::DOUBLE/facilities AS industrial_pct,
   facilities/100 + animals/10000000 + industrial*100.0::DOUBLE/facilities/10 AS priority_score FROM county)
, prio2 AS (SELECT *, CASE WHEN priority_score > 5 THEN 'HIGH' WHEN priority_score > 2 THEN 'MEDIUM' ELSE 'LOW' END
   AS priority FROM prio)
"""


@query("county_summary", with_views(["permit"], _COUNTY + """
SELECT county, facilities, animals, industrial, round(pct_of_state, 6) AS pct_of_state,
  round(avg_per_facility, 6) AS avg_per_facility FROM lead10"""))
def county_summary(spark, d):
    out = A.top_counties(A.county_summary(T.permit(spark, d)))
    return out.select(
        "county", "facilities", "animals", "industrial", R6("pct_of_state"), R6("avg_per_facility")
    )


@query("county_priority", with_views(["permit"], _COUNTY + """
SELECT county, round(density_score, 6) AS density_score, round(volume_score, 7) AS volume_score,
  round(industrial_pct, 6) AS industrial_pct, round(priority_score, 6) AS priority_score, priority FROM prio2"""))
def county_priority(spark, d):
    out = A.county_priority(A.county_summary(T.permit(spark, d)))
    return out.select(
        "county", R6("density_score"), F.round("volume_score", 7).alias("volume_score"), R6("industrial_pct"),
        R6("priority_score"), "priority",
    )


@query("county_animal", with_views(["permit"], """
SELECT county, animal_type, count(*) AS facilities, sum(headcount)::BIGINT AS animals,
  round(sum(headcount)*100.0::DOUBLE/sum(sum(headcount)) OVER (PARTITION BY county), 6) AS pct_of_county
FROM permit GROUP BY county, animal_type"""))
def county_animal(spark, d):
    out = A.within_county(T.permit(spark, d), "animal_type")
    return out.withColumn("pct_of_county", F.round("pct_of_county", 6))


@query("hub_county_matrix", with_views(["permit", "assignment"], """
, tot AS (SELECT county, sum(headcount) AS all_animals FROM permit GROUP BY county)
SELECT county, assigned_site_idx::INTEGER AS assigned_site_idx, count(*) AS facilities, sum(headcount)::BIGINT AS animals,
  round(sum(headcount)*100.0::DOUBLE/any_value(all_animals), 6) AS pct_of_county
FROM assignment JOIN tot USING (county) WHERE n_hubs = 10 GROUP BY county, assigned_site_idx"""))
def hub_county_matrix(spark, d):
    totals = T.permit(spark, d).groupBy("county").agg(F.sum("headcount").alias("animals"))
    out = A.within_county(ten_hubs(spark, d), "assigned_site_idx", totals)
    return out.withColumns({
        "pct_of_county": F.round("pct_of_county", 6),
        "assigned_site_idx": F.col("assigned_site_idx").cast("int"),
    })


_ZONES = """
, zone AS (SELECT c.site_id, count(a.permit_id) AS zone_afos, coalesce(sum(a.headcount), 0)::BIGINT AS zone_animals
  FROM scenario_site c LEFT JOIN assignment a ON a.assigned_site_idx = c.site_id AND a.n_hubs = 10
  WHERE c.n_hubs = 10 GROUP BY c.site_id)
"""


def zones(spark, d):
    hubs = scenario_sites(spark, d).filter("n_hubs = 10").select("site_id")
    return A.zone_totals(ten_hubs(spark, d), hubs)


@query("zone_totals", with_views(["assignment", "scenario_site"], _ZONES + """
SELECT site_id, zone_afos, zone_animals FROM zone"""))
def zone_totals(spark, d):
    return zones(spark, d)


@query("zone_balance", with_views(["assignment", "scenario_site"], _ZONES + """
SELECT site_id, round(zone_afos*100.0::DOUBLE/(SELECT sum(zone_afos) FROM zone), 6) AS pct_afos,
  round(zone_animals*100.0::DOUBLE/(SELECT sum(headcount) FROM assignment WHERE n_hubs = 10), 6) AS pct_animals
FROM zone WHERE zone_afos > 0"""))
def zone_balance(spark, d):
    return A.zone_balance(ten_hubs(spark, d)).select("site_id", R6("pct_afos"), R6("pct_animals"))


@query("hub_summary", with_views(["assignment", "scenario_site"], _ZONES + """
SELECT site_id, zone_afos, zone_animals, round(zone_animals/5000000*100, 0) AS capacity_pct FROM zone"""))
def hub_summary(spark, d):
    return A.hub_summary(zones(spark, d))


@query("hubs_by_county", with_views(["assignment", "scenario_site"], _ZONES + """
, snap AS (SELECT site_id, county FROM (SELECT s.site_id, p.county, row_number() OVER (PARTITION BY s.site_id
    ORDER BY sqrt((p.px-s.px)*(p.px-s.px) + (p.py-s.py)*(p.py-s.py)), p.permit_id) AS rn
   FROM scenario_site s CROSS JOIN plane p WHERE s.n_hubs = 10) WHERE rn = 1)
SELECT county, count(*) AS hubs, sum(zone_afos)::BIGINT AS total_afos, sum(zone_animals)::BIGINT AS total_animals
FROM zone JOIN snap USING (site_id) GROUP BY county"""))
def hubs_by_county(spark, d):
    at = G.snap_hubs(facilities(spark, d), batch(spark, d).runs[10].hubs)
    where = T.permit(spark, d).select("permit_id", "county").join(F.broadcast(at), "permit_id")
    return A.hubs_by_county(where.join(zones(spark, d), "site_id"))


@query("top_facilities", with_views(["permit"], """
SELECT permit_id, trim(farm_name) AS farm_name, headcount, county FROM permit
ORDER BY headcount DESC, permit_id LIMIT 10"""))
def top_facilities(spark, d):
    p = T.permit(spark, d).select(
        "permit_id", F.trim("farm_name").alias("farm_name"), "headcount", "county"
    )
    return A.top(p, 10, F.desc("headcount"), F.col("permit_id"))


@query("top_per_county", with_views(["permit"], """
SELECT county, rank::INTEGER AS rank, permit_id, headcount FROM (SELECT *, row_number() OVER (PARTITION BY county
  ORDER BY headcount DESC, permit_id) AS rank FROM permit) WHERE rank <= 10"""))
def top_per_county(spark, d):
    return A.top_per_county(T.permit(spark, d)).select("county", "rank", "permit_id", "headcount")


@query("baseline_findings", with_views(["permit"], """
SELECT count(*) AS records, sum(headcount)::BIGINT AS animals,
  round(count(*) FILTER (WHERE county IN ('Worcester', 'Wicomico', 'Caroline', 'Somerset', 'Dorchester',
   'Queen Anne''s', 'Kent', 'Talbot'))*100.0::DOUBLE/count(*), 6) AS region_pct,
  round(coalesce(sum(headcount) FILTER (WHERE contains(lower(animal_type), 'chicken')), 0)*100.0::DOUBLE/sum(headcount), 6) AS chicken_pct,
  count(*) FILTER (WHERE headcount > 100000) AS industrial,
  round(count(*) FILTER (WHERE headcount > 100000)*100.0::DOUBLE/count(*), 6) AS industrial_pct FROM permit"""))
def baseline_findings(spark, d):
    return A.baseline_findings(T.permit(spark, d)).select(
        "records", "animals", R6("region_pct"), R6("chicken_pct"), "industrial", R6("industrial_pct")
    )


@query("map_markers", with_views(["assignment"], """
SELECT permit_id, CASE WHEN headcount = 0 THEN 2 WHEN headcount < 10000 THEN 3 WHEN headcount < 100000 THEN 5
   WHEN headcount < 1000000 THEN 8 ELSE 12 END AS radius,
  CASE WHEN headcount < 100000 THEN 5 ELSE 8 END AS simple_radius,
  ['red','blue','green','purple','orange','darkred','darkblue','darkgreen','cadetblue','pink'][(assigned_site_idx + 10) % 10 + 1] AS colour
FROM assignment WHERE n_hubs = 10"""))
def map_markers(spark, d):
    return A.map_markers(ten_hubs(spark, d)).select("permit_id", "radius", "simple_radius", "colour")


def _big(n: str, width: int = 0) -> str:
    text = f"format('{{:,}}', {n})"
    return f"lpad({text}, {width}, ' ')" if width else text


def _padded(n: str, width: int) -> str:
    """At least ``width`` characters (lpad alone cuts longer numbers)."""
    return f"lpad({_big(n)}, greatest({width}, length({_big(n)}))::INTEGER, ' ')"


@query("report_lines", with_views(["permit"], _HIST + f"""
, q AS (SELECT count(*) AS n, count(latitude) AS loc, count(*) FILTER (WHERE headcount > 0) AS hc,
   sum(headcount)::BIGINT AS animals FROM permit)
, dist AS (SELECT 2 AS section, animal_type AS name, count(*) AS f, sum(headcount)::BIGINT AS a FROM permit GROUP BY ALL
   UNION ALL SELECT 3, county, count(*), sum(headcount)::BIGINT FROM permit GROUP BY ALL)
, ranked AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY a DESC, name) AS rn FROM dist)
, fi AS (SELECT count(*) FILTER (WHERE county NOT IN ('Cecil', 'Carroll'))*100.0::DOUBLE/count(*) AS reg,
   coalesce(sum(headcount) FILTER (WHERE contains(lower(animal_type), 'chicken')), 0)*100.0::DOUBLE/sum(headcount) AS chk,
   count(*) FILTER (WHERE headcount > 100000) AS ind FROM permit)
SELECT 1 AS section, 0 AS ord, 'Total AFO Records: ' || {_big("n")} AS line FROM q
UNION ALL SELECT 1, 1, 'With Valid Coordinates: ' || {_big("loc")} || printf(' (%.1f%%)', loc*100.0::DOUBLE/n) FROM q
UNION ALL SELECT 1, 2, 'Missing Coordinates: ' || {_big("n - loc")} FROM q
UNION ALL SELECT 1, 3, 'With Headcount Data: ' || {_big("hc")} FROM q
UNION ALL SELECT 1, 4, 'Total Animals: ' || {_big("animals")} FROM q
UNION ALL SELECT section, rn::INTEGER, printf(CASE section WHEN 2 THEN '%-30s: %4d AFOs, ' ELSE '%-20s: %4d AFOs, ' END, name, f) ||
  {_padded("a", 12)} || printf(' animals (%5.1f%%)', a*100.0::DOUBLE/(SELECT animals FROM q)) FROM ranked
  WHERE rn <= CASE section WHEN 2 THEN 5 ELSE 10 END
UNION ALL SELECT 4, ord, printf('%-15s: %4d facilities (%5.1f%%)', size_class, facilities, pct) FROM hist
UNION ALL SELECT 5, 0, '1. ' || {_big("n")} || ' registered AFOs managing ' || {_big("animals")} || ' animals' FROM q
UNION ALL SELECT 5, 1, printf('2. %.1f%% of AFOs are concentrated on the Eastern Shore', reg) FROM fi
UNION ALL SELECT 5, 2, printf('3. %.1f%% of total animals are chickens', chk) FROM fi
UNION ALL SELECT 5, 3, '4. ' || {_big("ind")} || printf(' facilities (%.1f%%) have >100K animals', ind*100.0::DOUBLE/n) FROM fi, q"""))
def report_lines(spark, d):
    return reports.baseline_report(T.permit(spark, d))


@query("county_report_lines", with_views(["permit", "assignment"], _COUNTY + f"""
, mine AS (SELECT p.* FROM permit p JOIN lead10 USING (county))
, types AS (SELECT county, animal_type, count(*) AS f, sum(headcount)::BIGINT AS a, row_number() OVER (PARTITION BY county
    ORDER BY sum(headcount) DESC, animal_type) AS rn FROM mine GROUP BY county, animal_type)
, sz AS (SELECT county, {_SIZE} AS s, count(*) AS n FROM mine GROUP BY ALL)
, class(rn, s) AS (VALUES (1, '<1K'), (2, '1K-10K'), (3, '10K-100K'), (4, '100K-1M'), (5, '>1M'))
, szr AS (SELECT l.county, class.rn, class.s, coalesce(sz.n, 0) AS n FROM lead10 l CROSS JOIN class
    LEFT JOIN sz ON sz.county = l.county AND sz.s = class.s)
, advice(priority, texts) AS (VALUES
    ('HIGH', ['Excellent candidate for pilot digester program', 'Consider 2-3 hubs within county boundaries',
      'High potential for economies of scale', 'Engage with top 10 facilities for partnership']),
    ('MEDIUM', ['Good candidate for regional hub serving multiple counties',
      'Consider shared infrastructure with neighboring counties', 'Focus on largest facilities first']),
    ('LOW', ['Better suited for regional hub access', 'May not justify standalone county hub',
      'Include in multi-county service area']))
, tops AS (SELECT *, row_number() OVER (PARTITION BY county ORDER BY headcount DESC, permit_id) AS rn FROM mine)
, hubs AS (SELECT county, assigned_site_idx AS h, count(*) AS f, sum(headcount)::BIGINT AS a, row_number() OVER (PARTITION BY
    county ORDER BY sum(headcount) DESC, assigned_site_idx) AS rn FROM assignment WHERE n_hubs = 10 GROUP BY county, assigned_site_idx)
, pl AS (SELECT p.* FROM prio2 p JOIN lead10 USING (county))
SELECT county, 1 AS section, 0 AS ord, 'Total AFOs: ' || {_big("facilities")} AS line FROM lead10
UNION ALL SELECT county, 1, 1, 'Total Animals: ' || {_big("animals")} FROM lead10
UNION ALL SELECT county, 1, 2, printf('Percentage of State Total: %.1f%%', pct_of_state) FROM lead10
UNION ALL SELECT county, 1, 3, 'Average Animals per AFO: ' || {_big("round_even(avg_per_facility, 0)::BIGINT")} FROM lead10
UNION ALL SELECT t.county, 2, rn::INTEGER, printf('%-30s: %3d AFOs, ', trim(animal_type), f) || {_big("a", 12)} ||
  printf(' animals (%5.1f%%)', a*100.0::DOUBLE/l.animals) FROM types t JOIN lead10 l ON l.county = t.county
UNION ALL SELECT s.county, 3, rn::INTEGER, printf('%-15s: %3d facilities (%5.1f%%)', s, n, n*100.0::DOUBLE/l.facilities)
  FROM szr s JOIN lead10 l ON l.county = s.county
UNION ALL SELECT county, 4, rn::INTEGER, printf('%-50s ', trim(farm_name)) || {_big("headcount", 12)} || ' ' || trim(animal_type)
  FROM tops WHERE rn <= 10
UNION ALL SELECT h.county, 5, rn::INTEGER, printf('Hub %2d: %3d AFOs, ', h, f) || {_big("a", 12)} ||
  printf(' animals (%5.1f%%)', a*100.0::DOUBLE/l.animals) FROM hubs h JOIN lead10 l ON l.county = h.county
UNION ALL SELECT county, 6, 0, 'Priority Level: ' || priority FROM pl
UNION ALL SELECT county, 6, 1, 'Reason: ' || CASE priority WHEN 'HIGH' THEN 'High AFO density and large animal population'
  WHEN 'MEDIUM' THEN 'Significant AFO presence' ELSE 'Lower AFO concentration' END FROM pl
UNION ALL SELECT county, 6, 2, printf('AFO Density Score: %.1f', density_score) FROM pl
UNION ALL SELECT county, 6, 3, printf('Volume Score: %.1f', volume_score) FROM pl
UNION ALL SELECT county, 6, 4, printf('Industrial Facilities: %.0f%%', industrial_pct) FROM pl
UNION ALL SELECT county, 7, pos::INTEGER, '• ' || texts[pos + 1] FROM (SELECT county, texts, unnest(range(len(texts))) AS pos
  FROM pl JOIN advice USING (priority))"""))
def county_report_lines(spark, d):
    return reports.county_reports(T.permit(spark, d), ten_hubs(spark, d))


@query("county_master", with_views(["permit"], _COUNTY + """
SELECT row_number() OVER (ORDER BY animals DESC, county)::INTEGER AS rank, county, facilities, animals,
  round(pct_of_state, 6) AS pct_of_state, round(avg_per_facility, 6) AS avg_per_facility,
  industrial AS industrial_facilities, replace(county, ' ', '_') || '_report.txt' AS report_file FROM lead10"""))
def county_master(spark, d):
    out = reports.county_master(T.permit(spark, d))
    return out.withColumns({"pct_of_state": R6("pct_of_state"), "avg_per_facility": R6("avg_per_facility")})
