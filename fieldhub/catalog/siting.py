"""Distances, capacity assignment, refinement, snapping and p-median."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldhub.catalog.registry import query
from fieldhub.fixtures import tables as T
from fieldhub.fixtures.views import with_views
from fieldhub.functions.geo import METRES_PER_US_FOOT
from fieldhub.operators import profiles as A
from fieldhub.operators import registry as R
from fieldhub.operators import siting as G
from fieldhub.operators.median_bound import median_bound

P = 10
KM = f"{METRES_PER_US_FOOT / 1000.0!r}::DOUBLE"


def facilities(spark, d):
    return G.project(T.permit(spark, d))


def candidate_points(spark, d):
    x, y = G.geo.state_plane(F.col("longitude"), F.col("latitude"))
    return T.candidate(spark, d).select("site_id", x.alias("x"), y.alias("y"))


_HUBS = f"""
, hub AS (SELECT row_number() OVER (ORDER BY headcount, permit_id DESC) - 1 AS k, permit_id, headcount,
   px AS hx, py AS hy FROM (SELECT * FROM plane ORDER BY headcount DESC, permit_id LIMIT {P}))
"""


def _dist(ax="px", ay="py", bx="hx", by="hy") -> str:
    return f"(sqrt(({ax}-{bx})*({ax}-{bx}) + ({ay}-{by})*({ay}-{by})) * {KM})"


@query("initial_hubs", with_views(["plane"], _HUBS + """
SELECT k::INTEGER AS site_id, round(hx, 3) AS x, round(hy, 3) AS y FROM hub"""))
def initial_hubs(spark, d):
    hubs = G.sites_table(spark, G.initial_hubs(facilities(spark, d), P))
    return hubs.select(
        F.col("site_id").cast("int"), F.round("x", 3).alias("x"), F.round("y", 3).alias("y")
    )


@query("distance_matrix", with_views(["permit", "plane"], _HUBS + f"""
SELECT p.permit_id, k::INTEGER AS site_id, round(coalesce({_dist()}, 999999.0::DOUBLE), 6) AS dist
FROM permit p LEFT JOIN plane USING (permit_id) CROSS JOIN hub"""))
def distance_matrix(spark, d):
    hubs = G.initial_hubs(facilities(spark, d), P)
    x, y = G.geo.state_plane(F.col("longitude"), F.col("latitude"))
    everyone = T.permit(spark, d).select("permit_id", x.alias("x"), y.alias("y"))
    out = G.distance_table(everyone, hubs, missing=999_999.0)
    return out.withColumn("dist", F.round("dist", 6))


@query("hub_preferences", with_views(["plane"], _HUBS + f"""
SELECT p.permit_id, row_number() OVER (PARTITION BY p.permit_id ORDER BY {_dist()}, k)::INTEGER AS rank,
  k::INTEGER AS site_id FROM plane p CROSS JOIN hub"""))
def hub_preferences(spark, d):
    f = facilities(spark, d)
    return G.hub_preferences(f, G.initial_hubs(f, P))


_NEAR = f"""
, near AS (SELECT p.permit_id, p.headcount, arg_min(k, {{order}}) AS k, min({_dist()}) AS dist
   FROM plane p CROSS JOIN hub GROUP BY ALL)
""".replace("{order}", f"{_dist()}")


@query("nearest_site", with_views(["plane"], _HUBS + _NEAR + """
SELECT permit_id, k::INTEGER AS site_id, round(dist, 6) AS dist FROM near"""))
def nearest_site(spark, d):
    f = facilities(spark, d)
    out = G.nearest_site(f, G.initial_hubs(f, P))
    return out.select(
        "permit_id", F.col("assigned_site_idx").alias("site_id"),
        F.round("distance_to_hub_km", 6).alias("dist"),
    )


@query("hub_running_load", with_views(["plane"], _HUBS + _NEAR + """
SELECT permit_id, k::INTEGER AS site_id, headcount, coalesce(sum(headcount) OVER (PARTITION BY k
   ORDER BY headcount DESC, permit_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS load_before
FROM near"""))
def hub_running_load(spark, d):
    f = facilities(spark, d)
    return G.running_load(f, G.initial_hubs(f, P))


def _fill(n: int) -> str:
    """The serial rule for hub table hub{n}: facilities in order, hub loads as a list."""
    return f"""
, fac{n} AS MATERIALIZED (SELECT permit_id, headcount AS w, px, py, row_number() OVER (ORDER BY headcount DESC,
    permit_id) AS pos, prefs FROM (SELECT p.permit_id, p.headcount, p.px, p.py, list(k ORDER BY {_dist()}, k) AS prefs
   FROM plane p CROSS JOIN hub{n} GROUP BY ALL))
, step{n}(pos, loads, pick, permit_id) AS (
   SELECT 0::BIGINT, list_transform(range({P}), lambda x: 0::BIGINT), -1::BIGINT, -1::BIGINT
   UNION ALL
   SELECT pos, list_transform(loads, lambda x, i: CASE WHEN i - 1 = pick THEN x + w ELSE x END), pick, permit_id
   FROM (SELECT f.pos, f.w, f.permit_id, s.loads, coalesce(list_filter(f.prefs, lambda h: s.loads[h + 1] + f.w <= cap)[1], -1) AS pick
     FROM step{n} s JOIN fac{n} f ON f.pos = s.pos + 1 CROSS JOIN capacity))
, done{n} AS MATERIALIZED (SELECT s.permit_id, s.pick, p.headcount, p.px, p.py, h.hx, h.hy
   FROM step{n} s JOIN plane p USING (permit_id) LEFT JOIN hub{n} h ON h.k = s.pick)
"""


_CAPACITY = f"""
, capacity AS (SELECT ceil(sum(headcount) * 11 / (10.0 * {P}))::BIGINT AS cap FROM plane)
, hub0 AS (SELECT k, hx, hy FROM hub)
"""


def assigned(spark, d):
    f = facilities(spark, d)
    return G.assign_with_capacity(f, G.initial_hubs(f, P), G.default_capacity(f, P))


@query("capacity_assign", with_views(["plane"], _HUBS + _CAPACITY + _fill(0) + f"""
SELECT permit_id, pick::INTEGER AS site_id, round({_dist()}, 6) AS dist FROM done0""", recursive=True))
def capacity_assign(spark, d):
    return assigned(spark, d).select(
        "permit_id", F.col("assigned_site_idx").alias("site_id"),
        F.round("distance_to_hub_km", 6).alias("dist"),
    )


_TIGHT = f"""
, capacity AS (SELECT (sum(headcount) * 9 // (10 * {P}))::BIGINT AS cap FROM plane)
, hub0 AS (SELECT k * 7 + 100 AS id, k, hx, hy FROM hub)
"""


@query("capacity_tight", with_views(["plane"], _HUBS + _TIGHT + _fill(0) + f"""
SELECT permit_id, CASE WHEN pick < 0 THEN -1 ELSE pick * 7 + 100 END::INTEGER AS site_id, round({_dist()}, 6) AS dist
FROM done0""", recursive=True))
def capacity_tight(spark, d):
    """Room for nine tenths only, so facilities are left out; sites have numbers of their own."""
    f = facilities(spark, d)
    hubs = [G.Hub(h.site_id * 7 + 100, h.x, h.y) for h in G.initial_hubs(f, P)]
    total = f.agg(F.sum("headcount")).first()[0] or 0
    return G.assign_with_capacity(f, hubs[::-1], total * 9 // (10 * P)).select(
        "permit_id", F.col("assigned_site_idx").alias("site_id"),
        F.round("distance_to_hub_km", 6).alias("dist"),
    )


@query("transport_effort", with_views(["plane"], _HUBS + _CAPACITY + _fill(0) + f"""
SELECT round(sum(headcount * {_dist()}), 2) AS effort FROM done0 WHERE pick >= 0""", recursive=True))
def transport_effort(spark, d):
    return G.transport_effort(assigned(spark, d)).select(F.round("effort", 2).alias("effort"))


def _move(n: int) -> str:
    """hub{n+1}: centroids of round n, or hub{n} again once the move is below the tolerance."""
    return f"""
, mean{n} AS (SELECT pick AS k, avg(px) AS mx, avg(py) AS my FROM done{n} WHERE pick >= 0 GROUP BY pick)
, next{n} AS (SELECT h.k, h.hx, h.hy, coalesce(mx, hx) AS nx, coalesce(my, hy) AS ny FROM hub{n} h LEFT JOIN mean{n} USING (k))
, far{n} AS (SELECT sqrt(sum((nx-hx)*(nx-hx) + (ny-hy)*(ny-hy))) >= 100 AS go FROM next{n})
, hub{n + 1} AS MATERIALIZED (SELECT k, CASE WHEN go THEN nx ELSE hx END AS hx, CASE WHEN go THEN ny ELSE hy END AS hy
   FROM next{n} CROSS JOIN far{n})
"""


@query("refine_once", with_views(["plane"], _HUBS + _CAPACITY + _fill(0) + _move(0) + """
SELECT k::INTEGER AS site_id, round(nx, 3) AS x, round(ny, 3) AS y FROM next0""", recursive=True))
def refine_once(spark, d):
    f = facilities(spark, d)
    hubs = G.initial_hubs(f, P)
    moved = G.centroids(G.assign_with_capacity(f, hubs, G.default_capacity(f, P)), hubs)
    return G.sites_table(spark, moved).select(
        F.col("site_id").cast("int"), F.round("x", 3).alias("x"), F.round("y", 3).alias("y")
    )


ROUNDS = 20
_REFINED = _HUBS + _CAPACITY + "".join(_fill(n) + _move(n) for n in range(ROUNDS))


def refined(spark, d):
    return G.refine_hubs(facilities(spark, d), P)


@query("refine_hubs", with_views(["plane"], _REFINED + f"""
SELECT h.k::INTEGER AS site_id, round(h.hx, 3) AS x, round(h.hy, 3) AS y, count(d.permit_id) AS zone_afos,
  coalesce(sum(d.headcount), 0)::BIGINT AS zone_animals
FROM hub{ROUNDS} h LEFT JOIN done{ROUNDS - 1} d ON d.pick = h.k GROUP BY h.k, h.hx, h.hy""", recursive=True))
def refine_hubs(spark, d):
    run = refined(spark, d)
    hubs = G.sites_table(spark, run.hubs)
    return A.zone_totals(run.assigned, hubs).select(
        F.col("site_id").cast("int"), F.round("x", 3).alias("x"), F.round("y", 3).alias("y"),
        "zone_afos", "zone_animals",
    )


def snapped(spark, d, run):
    """Snapped hubs with the attributes of their facility and zone totals."""
    at = G.snap_hubs(run.assigned, run.hubs)
    attrs = R.located(T.permit(spark, d)).select(
        "permit_id", F.trim("farm_name").alias("farm_name"), "county", "longitude", "latitude"
    )
    hubs = attrs.join(F.broadcast(at), "permit_id")  # one row per hub
    return A.zone_totals(run.assigned, hubs)


@query("snap_hubs", with_views(["plane"], _REFINED + f"""
, snap AS (SELECT k, permit_id, county FROM (SELECT h.k, p.permit_id, p.county, row_number() OVER (PARTITION BY h.k
    ORDER BY sqrt((px-hx)*(px-hx) + (py-hy)*(py-hy)), p.permit_id) AS rn FROM hub{ROUNDS} h CROSS JOIN plane p) WHERE rn = 1)
SELECT s.k::INTEGER AS site_id, s.permit_id, s.county, count(d.permit_id) AS zone_afos,
  coalesce(sum(d.headcount), 0)::BIGINT AS zone_animals
FROM snap s LEFT JOIN done{ROUNDS - 1} d ON d.pick = s.k GROUP BY s.k, s.permit_id, s.county""", recursive=True))
def snap_hubs(spark, d):
    return snapped(spark, d, refined(spark, d)).select(
        "site_id", "permit_id", "county", "zone_afos", "zone_animals"
    )


# --- p-median ------------------------------------------------------------------------
@query("pmedian_one", with_views(["plane", "site_plane"], f"""
SELECT site_id, round(total, 2) AS objective FROM (SELECT s.site_id, sum(p.headcount *
   {_dist("p.px", "p.py", "s.px", "s.py")}) AS total FROM plane p CROSS JOIN site_plane s GROUP BY s.site_id)
ORDER BY total, site_id LIMIT 1"""))
def pmedian_one(spark, d):
    return _median(spark, d, 1, swap=False)


def _median(spark, d, p: int, swap: bool):
    m = G.p_median(facilities(spark, d), candidate_points(spark, d), p, swap=swap)
    return G.sites_table(spark, m.sites).select(
        "site_id", F.lit(round(m.objective, 2)).alias("objective")
    )


@query("pmedian_greedy", with_views(["plane", "site_plane"], f"""
, dd AS (SELECT p.permit_id, p.headcount AS w, s.site_id, {_dist("p.px", "p.py", "s.px", "s.py")} AS dist
   FROM plane p CROSS JOIN site_plane s)
, s1 AS (SELECT site_id FROM dd GROUP BY site_id ORDER BY sum(w*dist), site_id LIMIT 1)
, b1 AS (SELECT permit_id, dist AS b FROM dd JOIN s1 USING (site_id))
, s2 AS (SELECT site_id FROM dd JOIN b1 USING (permit_id) WHERE site_id NOT IN (FROM s1)
   GROUP BY site_id ORDER BY sum(w*least(b, dist)), site_id LIMIT 1)
, b2 AS (SELECT permit_id, least(b, dist) AS b FROM dd JOIN b1 USING (permit_id) JOIN s2 USING (site_id))
, s3 AS (SELECT site_id, sum(w*least(b, dist)) AS total FROM dd JOIN b2 USING (permit_id)
   WHERE site_id NOT IN (FROM s1) AND site_id NOT IN (FROM s2) GROUP BY site_id ORDER BY total, site_id LIMIT 1)
SELECT site_id, (SELECT round(total, 2) FROM s3) AS objective FROM (SELECT site_id FROM s1
  UNION ALL SELECT site_id FROM s2 UNION ALL SELECT site_id FROM s3)"""))
def pmedian_greedy(spark, d):
    return _median(spark, d, 3, swap=False)


# Dropping one of two sites and taking the best partner of the other is a walk from site to
# best partner; it ends in a pair that are each other's best.
SWAP_PAIR = f"""
, dd AS (SELECT p.permit_id, p.headcount AS w, s.site_id, {_dist("p.px", "p.py", "s.px", "s.py")} AS dist
   FROM plane p CROSS JOIN site_plane s)
, pairs AS MATERIALIZED (SELECT a.site_id AS s1, b.site_id AS s2, sum(a.w * least(a.dist, b.dist)) AS total
   FROM dd a JOIN dd b ON a.permit_id = b.permit_id AND a.site_id <> b.site_id GROUP BY ALL)
, partner AS MATERIALIZED (SELECT s1, s2 AS mate, total FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY total, s2) AS rn
   FROM pairs) WHERE rn = 1)
, first AS (SELECT site_id FROM dd GROUP BY site_id ORDER BY sum(w*dist), site_id LIMIT 1)
, chain(step, x, y, total) AS (
   SELECT 0, site_id, mate, total FROM first JOIN partner ON s1 = site_id
   UNION ALL SELECT step + 1, y, mate, p.total FROM chain JOIN partner p ON p.s1 = y WHERE step < 40)
, best AS (SELECT least(x, y) AS s1, greatest(x, y) AS s2, total FROM chain WHERE step = 40)
"""


@query("pmedian", with_views(["plane", "site_plane"], SWAP_PAIR + """
SELECT unnest([s1, s2]) AS site_id, round(total, 2) AS objective FROM best""", recursive=True))
def pmedian(spark, d):
    return _median(spark, d, 2, swap=True)


@query("pmedian_bound", with_views(["plane", "site_plane"], SWAP_PAIR.split(", partner AS", 1)[0] + """
SELECT 2 AS p, round(min(total), 2) AS objective, true AS bound_holds, true AS within_1_percent FROM pairs"""))
def pmedian_bound(spark, d):
    """The best pair of sites, proven by a bound: the SQL tries every pair."""
    found = median_bound(facilities(spark, d), candidate_points(spark, d), 2)
    return spark.range(1).select(
        F.lit(2).alias("p"), F.lit(round(found.upper, 2)).alias("objective"),
        F.lit(found.lower <= found.upper).alias("bound_holds"), F.lit(found.gap <= 0.01).alias("within_1_percent"),
    )
