"""Costs, revenue, sensitivity grids, cash flow, scenario ranking, run comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldhub.catalog.registry import query
from fieldhub.catalog.reports import assignment, scenario_sites
from fieldhub.catalog.siting import _CAPACITY, _HUBS, _dist, _fill, P, assigned
from fieldhub.fixtures import tables as T
from fieldhub.fixtures.views import with_views
from fieldhub.operators import economics as E
from fieldhub.operators import profiles as A
from fieldhub.plans import reports


def rounded(df, digits: dict[str, int]):
    return df.select(*[
        F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns
    ])


def base(spark, d):
    return E.scenario_base(assignment(spark, d), scenario_sites(spark, d))


_BASE = """
, base AS (SELECT n_hubs, count(*) AS afos_served, count(*) FILTER (WHERE assigned_site_idx >= 0) AS with_hub, sum(headcount)::BIGINT AS animals,
   sum(headcount*distance_to_hub_km) AS effort, (SELECT count(*) FROM scenario_site c WHERE c.n_hubs = a.n_hubs) AS hubs
  FROM assignment a GROUP BY n_hubs)
"""
_ECON = """
, econ AS (SELECT *, hubs*2000000.0::DOUBLE AS construction_cost, effort/25000*52*2.5::DOUBLE AS annual_transport_cost,
   effort/animals AS avg_distance_km, animals/25000*52 AS truckloads_per_year,
   hubs*2000000.0::DOUBLE + effort/25000*52*2.5::DOUBLE*5 AS total_5yr_cost,
   effort/25000*52*2.5::DOUBLE/animals AS cost_per_animal_per_year FROM base)
"""
_REV = """
, kg AS (SELECT *, animals*0.09::DOUBLE*365 AS kg FROM econ)
, rev AS (SELECT *, kg/1000 AS annual_manure_tons, kg*(0.2::DOUBLE*0.7::DOUBLE)*0.4::DOUBLE AS annual_biogas_m3,
   kg*(0.2::DOUBLE*0.7::DOUBLE)*0.4::DOUBLE*6*0.35::DOUBLE AS annual_kwh, kg/1000*0.95::DOUBLE AS annual_digestate_tons FROM kg)
, cash AS (SELECT *, annual_kwh*0.12::DOUBLE AS annual_energy_revenue, annual_digestate_tons*15 AS annual_digestate_revenue,
   annual_kwh*0.12::DOUBLE + annual_digestate_tons*15 AS total_annual_revenue,
   annual_kwh*0.12::DOUBLE + annual_digestate_tons*15 - annual_transport_cost AS net FROM rev)
"""
MONEY = {
    "effort": 2, "construction_cost": 2, "annual_transport_cost": 2, "avg_distance_km": 6,
    "truckloads_per_year": 2, "total_5yr_cost": 2, "cost_per_animal_per_year": 6,
}
_MONEY_SQL = """round(effort, 2) AS effort, round(construction_cost, 2) AS construction_cost,
  round(annual_transport_cost, 2) AS annual_transport_cost, round(avg_distance_km, 6) AS avg_distance_km,
  round(truckloads_per_year, 2) AS truckloads_per_year, round(total_5yr_cost, 2) AS total_5yr_cost,
  round(cost_per_animal_per_year, 6) AS cost_per_animal_per_year"""


@query("weighted_distance", with_views(["assignment"], """
SELECT n_hubs, round(sum(headcount*distance_to_hub_km)/sum(headcount), 6) AS avg_distance_km
FROM assignment GROUP BY n_hubs"""))
def weighted_distance(spark, d):
    return assignment(spark, d).groupBy("n_hubs").agg(
        F.round(E.effort() / F.sum("headcount"), 6).alias("avg_distance_km")
    )


@query("economics", with_views(["assignment", "scenario_site"], _BASE + _ECON + f"""
SELECT n_hubs, afos_served, with_hub, animals, hubs, {_MONEY_SQL} FROM econ"""))
def economics(spark, d):
    return rounded(E.economics(base(spark, d)), MONEY)


@query("siting_economics", with_views(["plane"], _HUBS + _CAPACITY + _fill(0) + f"""
, t AS (SELECT sum(headcount) AS animals, sum(CASE WHEN pick >= 0 THEN headcount * {_dist()} END) AS effort FROM done0)
SELECT round(effort/25000*2.5::DOUBLE*52, 2) AS annual_transport_cost, {P}*2000000.0::DOUBLE AS total_construction_cost,
  round(effort/25000*2.5::DOUBLE*52*5 + {P}*2000000.0::DOUBLE, 2) AS total_cost_5yr,
  round(effort/25000*2.5::DOUBLE*52/animals, 6) AS cost_per_animal_per_year,
  round(effort/25000*52, 2) AS effort_trips_per_year, round(effort/animals, 6) AS avg_distance_km FROM t""",
    recursive=True))
def siting_economics(spark, d):
    return rounded(E.siting_economics(assigned(spark, d), P), {
        "annual_transport_cost": 2, "total_cost_5yr": 2, "cost_per_animal_per_year": 6,
        "effort_trips_per_year": 2, "avg_distance_km": 6,
    })


REVENUE = {
    "annual_manure_tons": 3, "annual_biogas_m3": 2, "annual_kwh": 2, "annual_digestate_tons": 3,
    "annual_energy_revenue": 2, "annual_digestate_revenue": 2, "total_annual_revenue": 2,
    "revenue_per_animal_per_year": 6,
}


@query("revenue", with_views(["assignment", "scenario_site"], _BASE + _ECON + _REV + """
SELECT n_hubs, animals, round(annual_manure_tons, 3) AS annual_manure_tons, round(annual_biogas_m3, 2) AS annual_biogas_m3,
  round(annual_kwh, 2) AS annual_kwh, round(annual_digestate_tons, 3) AS annual_digestate_tons,
  round(annual_energy_revenue, 2) AS annual_energy_revenue, round(annual_digestate_revenue, 2) AS annual_digestate_revenue,
  round(total_annual_revenue, 2) AS total_annual_revenue,
  round(total_annual_revenue/animals, 6) AS revenue_per_animal_per_year FROM cash"""))
def revenue(spark, d):
    return rounded(E.base_revenue(base(spark, d).select("n_hubs", "animals")), REVENUE)


@query("sens_transport", with_views(["assignment", "scenario_site"], _BASE + """
, grid AS (SELECT *, unnest([1.5, 2.0, 2.5, 3.0, 3.5, 4.0])::DOUBLE AS rate FROM base WHERE n_hubs = 10)
SELECT rate AS transport_cost_per_km, round(effort/25000*52*rate, 2) AS annual_transport_cost,
  round(hubs*2000000.0::DOUBLE + effort/25000*52*rate*5, 2) AS total_5yr_cost,
  round(effort/25000*52*rate/animals, 6) AS cost_per_animal_per_year FROM grid"""))
def sens_transport(spark, d):
    grid = E.transport_grid(base(spark, d).filter("n_hubs = 10"))
    return rounded(grid, MONEY).select(
        "transport_cost_per_km", "annual_transport_cost", "total_5yr_cost", "cost_per_animal_per_year"
    )


@query("sens_construction", with_views(["assignment", "scenario_site"], _BASE + """
, grid AS (SELECT *, unnest([1500000, 2000000, 2500000, 3000000])::DOUBLE AS cost FROM base WHERE n_hubs = 10)
SELECT cost AS construction_cost_per_hub, round(hubs*cost, 2) AS construction_cost,
  round(hubs*cost + effort/25000*52*2.5::DOUBLE*5, 2) AS total_5yr_cost FROM grid"""))
def sens_construction(spark, d):
    grid = E.construction_grid(base(spark, d).filter("n_hubs = 10"))
    return rounded(grid, MONEY).select(
        "construction_cost_per_hub", "construction_cost", "total_5yr_cost"
    )


_REV_GRID = """
, g1 AS (SELECT *, unnest([0.08, 0.10, 0.12, 0.15, 0.18])::DOUBLE AS energy FROM rev)
, g2 AS (SELECT *, unnest([10, 15, 20, 25])::DOUBLE AS dig FROM g1)
, rg AS (SELECT *, annual_kwh*energy + annual_digestate_tons*dig AS total_annual_revenue FROM g2)
"""


@query("sens_revenue", with_views(["assignment", "scenario_site"], _BASE + _ECON + _REV + _REV_GRID + """
SELECT energy AS energy_price_per_kwh, dig AS digestate_price_per_ton,
  round(total_annual_revenue, 2) AS total_annual_revenue FROM rg WHERE n_hubs = 10"""))
def sens_revenue(spark, d):
    grid = E.revenue_grid(base(spark, d).filter("n_hubs = 10").select("n_hubs", "animals"))
    return rounded(grid, REVENUE).select(
        "energy_price_per_kwh", "digestate_price_per_ton", "total_annual_revenue"
    )


@query("revenue_summary", with_views(["assignment", "scenario_site"], _BASE + _ECON + _REV + _REV_GRID + """
SELECT n_hubs, round(min(total_annual_revenue), 2) AS low, round(quantile_cont(total_annual_revenue, 0.5), 2) AS mid,
  round(max(total_annual_revenue), 2) AS high FROM rg GROUP BY n_hubs"""))
def revenue_summary(spark, d):
    grid = E.revenue_grid(base(spark, d).select("n_hubs", "animals"))
    return rounded(E.revenue_summary(grid), {"low": 2, "mid": 2, "high": 2})


_FLOW_SQL = """SELECT n_hubs, round(construction_cost, 2) AS construction_cost,
  round(annual_transport_cost, 2) AS annual_transport_cost, round(total_annual_revenue, 2) AS total_annual_revenue,
  round(net, 2) AS annual_net_cash_flow, round({npv}, 2) AS npv_5yr,
  CASE WHEN net > 0 THEN round(construction_cost/net, 6) ELSE 'Infinity'::DOUBLE END AS payback_years FROM cash"""
FLOW = {
    "construction_cost": 2, "annual_transport_cost": 2, "total_annual_revenue": 2,
    "annual_net_cash_flow": 2, "npv_5yr": 2,
}


def _flow(spark, d, rate: float = 0.0):
    out = rounded(E.cash_flow(base(spark, d), rate), FLOW)
    years = F.col("payback_years")
    return out.select(
        "n_hubs", *FLOW,
        F.when(years < float("inf"), F.round(years, 6)).otherwise(years).alias("payback_years"),
    )


@query("hub_npv", with_views(["assignment", "scenario_site"], _BASE + _ECON + _REV + _FLOW_SQL.format(
    npv="net*5 - construction_cost")))
def hub_npv(spark, d):
    return _flow(spark, d)


@query("npv_discounted", with_views(["assignment", "scenario_site"], _BASE + _ECON + _REV + _FLOW_SQL.format(
    npv="net/1.05::DOUBLE + net/pow(1.05::DOUBLE,2) + net/pow(1.05::DOUBLE,3) + net/pow(1.05::DOUBLE,4) "
        "+ net/pow(1.05::DOUBLE,5) - construction_cost")))
def npv_discounted(spark, d):
    return _flow(spark, d, 0.05)


@query("break_even", with_views(["assignment", "scenario_site"], _BASE + _ECON + _REV + """
SELECT round(construction_cost, 2) AS construction, round(annual_transport_cost*5, 2) AS operating_5yr,
  round(total_annual_revenue*5, 2) AS revenue_5yr, round(net*5 - construction_cost, 2) AS npv_5yr,
  CASE WHEN net > 0 THEN round(construction_cost/net, 6) END AS payback_years FROM cash WHERE n_hubs = 10"""))
def break_even(spark, d):
    f = E.cash_flow(base(spark, d).filter("n_hubs = 10"))
    return f.select(
        F.round("construction_cost", 2).alias("construction"),
        F.round(F.col("annual_transport_cost") * 5, 2).alias("operating_5yr"),
        F.round(F.col("total_annual_revenue") * 5, 2).alias("revenue_5yr"),
        F.round("npv_5yr", 2).alias("npv_5yr"),
        F.when(F.col("payback_years") < float("inf"), F.round("payback_years", 6)).alias("payback_years"),
    )


# --- scenarios -------------------------------------------------------------------------
_CAP = 60_000_000  # hub capacity that suits the size of the test tables
_SCEN = f"""
, load AS (SELECT c.n_hubs, c.site_id, coalesce(sum(a.headcount), 0)::BIGINT AS zone_animals
   FROM scenario_site c
   LEFT JOIN assignment a ON a.n_hubs = c.n_hubs AND a.assigned_site_idx = c.site_id GROUP BY ALL)
, scen AS (SELECT e.*, mx, mn FROM econ e JOIN (SELECT n_hubs, max(zone_animals/{_CAP}.0::DOUBLE*100) AS mx,
    min(zone_animals/{_CAP}.0::DOUBLE*100) AS mn FROM load GROUP BY n_hubs) USING (n_hubs))
, scored AS (SELECT *, total_5yr_cost/(SELECT max(total_5yr_cost) FROM scen) + abs(100 - mx)/100
    + avg_distance_km/(SELECT max(avg_distance_km) FROM scen) AS score FROM scen)
"""


def scenario_table(spark, d):
    a, sites = assignment(spark, d), scenario_sites(spark, d)
    loads = a.groupBy("n_hubs", F.col("assigned_site_idx").alias("site_id")).agg(
        F.sum("headcount").alias("zone_animals")
    )
    zones = sites.join(loads, ["n_hubs", "site_id"], "left").select(
        "n_hubs", "site_id", F.coalesce("zone_animals", F.lit(0)).alias("zone_animals")
    )
    return E.comparison(E.scenario_base(a, sites), zones, _CAP)


@query("scenario_compare", with_views(["assignment", "scenario_site"], _BASE + _ECON + _SCEN + """
SELECT n_hubs, afos_served, round(animals/1000000, 6) AS animals_m, round(construction_cost/1000000, 6) AS construction_m,
  round(annual_transport_cost/1000000, 6) AS annual_transport_m, round(total_5yr_cost/1000000, 6) AS total_5yr_m,
  round(cost_per_animal_per_year, 6) AS cost_per_animal_per_year, round(avg_distance_km, 6) AS avg_distance_km,
  round(mx, 6) AS max_capacity_pct, round(mn, 6) AS min_capacity_pct, round(with_hub*100.0::DOUBLE/afos_served, 6) AS coverage_pct FROM scen"""))
def scenario_compare(spark, d):
    out = scenario_table(spark, d)
    return rounded(out, {c: 6 for c in out.columns if c not in ("n_hubs", "afos_served")})


@query("scenario_score", with_views(["assignment", "scenario_site"], _BASE + _ECON + _SCEN + """
SELECT n_hubs, round(score, 6) AS score FROM scored"""))
def scenario_score(spark, d):
    return E.score(scenario_table(spark, d)).select("n_hubs", F.round("score", 6).alias("score"))


@query("best_scenario", with_views(["assignment", "scenario_site"], _BASE + _ECON + _SCEN + """
SELECT (SELECT n_hubs FROM scored ORDER BY round(total_5yr_cost/1000000, 9), n_hubs LIMIT 1)::INTEGER AS lowest_cost,
  (SELECT n_hubs FROM scored ORDER BY round(annual_transport_cost/1000000, 9), n_hubs LIMIT 1)::INTEGER AS lowest_transport,
  (SELECT n_hubs FROM scored ORDER BY round(avg_distance_km, 9), n_hubs LIMIT 1)::INTEGER AS shortest_distance,
  (SELECT n_hubs FROM scored ORDER BY round(score, 9), n_hubs LIMIT 1)::INTEGER AS recommended"""))
def best_scenario(spark, d):
    return E.best(E.score(scenario_table(spark, d)))


@query("recommendation", with_views(["assignment", "scenario_site"], _BASE + _ECON + _SCEN + """
, top AS (SELECT * FROM scored ORDER BY round(score, 9), n_hubs LIMIT 1)
SELECT 1 AS ord, printf('OPTIMAL SOLUTION: %d regional hubs', n_hubs) AS line FROM top
UNION ALL SELECT 2, printf('Facilities served: %d', afos_served) FROM top
UNION ALL SELECT 3, printf('Animals processed: %.1fM', animals/1000000) FROM top
UNION ALL SELECT 4, printf('Construction cost: $%.1fM', construction_cost/1000000) FROM top
UNION ALL SELECT 5, printf('Annual transport: $%.1fM', annual_transport_cost/1000000) FROM top
UNION ALL SELECT 6, printf('5-year total: $%.1fM', total_5yr_cost/1000000) FROM top
UNION ALL SELECT 7, printf('Average distance: %.1f km', avg_distance_km) FROM top
UNION ALL SELECT 8, printf('Cost per animal: $%.2f/year', cost_per_animal_per_year) FROM top
UNION ALL SELECT 9, printf('Hub capacity range: %.0f%%-%.0f%%', mn, mx) FROM top
UNION ALL SELECT 10, printf('Facilities with a hub: %.1f%%', with_hub*100.0::DOUBLE/afos_served) FROM top
UNION ALL SELECT * FROM (SELECT 11, printf('Budget-constrained: %d hubs ($%.0fM construction)', n_hubs, construction_cost/1000000) FROM scored
  ORDER BY construction_cost, n_hubs LIMIT 1)
UNION ALL SELECT * FROM (SELECT 12, printf('Distance-optimized: %d hubs (%.1f km avg)', n_hubs, avg_distance_km) FROM scored
  ORDER BY round(avg_distance_km, 9), n_hubs LIMIT 1)
UNION ALL SELECT (100 + n_hubs)::INTEGER, printf('%d hubs: at least one hub at %.0f%% capacity', n_hubs, mx) FROM scored WHERE mx >= 99"""))
def recommendation(spark, d):
    return E.recommendation(E.score(scenario_table(spark, d)))


@query("compare_runs", with_views(["assignment", "permit"], """
, r AS (SELECT n_hubs, count(*)::DOUBLE AS afos, sum(headcount)::DOUBLE AS animals, n_hubs::DOUBLE AS hubs,
   count(DISTINCT county)::DOUBLE AS counties FROM assignment WHERE n_hubs IN (8, 10) GROUP BY n_hubs)
, m AS (SELECT n_hubs, unnest(['AFOs','Animals','Hubs','Counties','Avg Animals/Hub','Coverage %']) AS metric,
   unnest([afos, animals, hubs, counties, animals/hubs, afos/(SELECT count(*) FROM permit)*100]) AS v FROM r)
SELECT metric, round(b.v, 6) AS baseline, round(u.v, 6) AS updated, round(u.v - b.v, 6) AS change,
  round_even((u.v - b.v)/b.v*100, 1) AS change_pct
FROM (SELECT * FROM m WHERE n_hubs = 8) b FULL JOIN (SELECT * FROM m WHERE n_hubs = 10) u USING (metric)"""))
def compare_runs(spark, d):
    total = T.permit(spark, d).select(F.count(F.lit(1))).scalar()
    a = assignment(spark, d)
    run = lambda n: E.run_metrics(a.filter(F.col("n_hubs") == n), F.lit(n), total)
    return rounded(E.compare_runs(run(8), run(10)), {"baseline": 6, "updated": 6, "change": 6})


@query("sensitivity_lines", with_views(["assignment", "scenario_site"], _BASE + _ECON + _REV + """
, b AS (SELECT * FROM cash WHERE n_hubs = 10)
, t AS (SELECT *, unnest([1.5, 2.0, 2.5, 3.0, 3.5, 4.0])::DOUBLE AS rate, unnest([1,2,3,4,5,6]) AS rn FROM b)
, c AS (SELECT *, unnest([1500000, 2000000, 2500000, 3000000])::DOUBLE AS cost, unnest([1,2,3,4]) AS rn FROM b)
SELECT 1 AS section, 0 AS ord, printf('Construction: $%.1fM', construction_cost/1000000) AS line FROM b
UNION ALL SELECT 1, 1, printf('Annual Transport: $%.1fM', annual_transport_cost/1000000) FROM b
UNION ALL SELECT 1, 2, printf('Annual Revenue: $%.1fM', total_annual_revenue/1000000) FROM b
UNION ALL SELECT 1, 3, printf('5-Year NPV: $%.1fM', (net*5 - construction_cost)/1000000) FROM b
UNION ALL SELECT 1, 4, CASE WHEN net > 0 THEN printf('Payback: %.1f years', construction_cost/net) ELSE 'Payback: Infinity years' END FROM b
UNION ALL SELECT 2, rn, printf('$%.2f/km: 5-yr cost = $%.1fM', rate, (hubs*2000000.0::DOUBLE + effort/25000*52*rate*5)/1000000) FROM t
UNION ALL SELECT 3, rn, printf('$%.1fM/hub: Total = $%.1fM', cost/1000000, (hubs*cost + effort/25000*52*2.5::DOUBLE*5)/1000000) FROM c"""))
def sensitivity_lines(spark, d):
    b = base(spark, d).filter("n_hubs = 10")
    return reports.sensitivity_report(E.cash_flow(b), E.transport_grid(b), E.construction_grid(b))
