"""The domain tables of ``tables.py`` as SQL common table expressions."""

from __future__ import annotations

from fieldhub import constants as K
from fieldhub.fixtures import tables as T
from fieldhub.functions.geo import METRES_PER_US_FOOT, STATE_PLANE


def _case(expr: str, values: list) -> str:
    quote = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    whens = " ".join(f"WHEN {i} THEN {quote(v)}" for i, v in enumerate(values))
    return f"CASE {expr} {whens} END"


def lonlat(k: str, mlon: int, mlat: int) -> tuple[str, str]:
    return (
        f"(-76.50::DOUBLE + ({k}*{mlon} % 1460)/1000.0::DOUBLE)",
        f"(37.91::DOUBLE + ({k}*{mlat} % 1810)/1000.0::DOUBLE)",
    )


LON, LAT = lonlat("c_custkey", 7919, 104729)
SLON, SLAT = lonlat("s_suppkey", 6151, 15487)

_Z = STATE_PLANE


def plane_sql(lon: str, lat: str) -> tuple[str, str]:
    """State-plane feet, written out in SQL."""
    es = f"({_Z.ecc!r} * sin(radians({lat})))"
    t = (
        f"(tan(pi()/4 - radians({lat})/2) / pow((1 - {es})/(1 + {es}), {_Z.ecc / 2!r}))"
    )
    rho = f"({_Z.scale!r} * pow({t}, {_Z.cone!r}))"
    theta = f"({_Z.cone!r} * radians({lon} - ({_Z.lon0!r})))"
    return (
        f"(({_Z.false_easting_m!r} + {rho} * sin({theta})) / {METRES_PER_US_FOOT!r})",
        f"(({_Z.origin_rho!r} - {rho} * cos({theta})) / {METRES_PER_US_FOOT!r})",
    )


def utm_sql(lon: str, lat: str) -> tuple[str, str]:
    """UTM 18N metres, written out in SQL."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    m0 = 1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256
    m2 = 3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024
    m4 = 15 * e2**2 / 256 + 45 * e2**3 / 1024
    m6 = 35 * e2**3 / 3072
    p = f"radians({lat})"
    n = f"({a!r} / sqrt(1 - {e2!r} * sin({p}) * sin({p})))"
    t = f"(tan({p}) * tan({p}))"
    c = f"({ep2!r} * cos({p}) * cos({p}))"
    A = f"(radians({lon} + 75.0::DOUBLE) * cos({p}))"
    A2 = f"({A} * {A})"
    m = (
        f"({a!r} * ({m0!r}*{p} - {m2!r}*sin(2*{p}) + {m4!r}*sin(4*{p}) - {m6!r}*sin(6*{p})))"
    )
    x = (
        f"(500000.0::DOUBLE + {k0}::DOUBLE * {n} * {A} * (1 + (1 - {t} + {c})*{A2}/6 "
        f"+ (5 - 18*{t} + {t}*{t} + 72*{c} - {58 * ep2!r})*{A2}*{A2}/120))"
    )
    y = (
        f"({k0}::DOUBLE * ({m} + {n}*tan({p})*({A2}/2 + (5 - {t} + 9*{c} + 4*{c}*{c})*{A2}*{A2}/24 "
        f"+ (61 - 58*{t} + {t}*{t} + 600*{c} - {330 * ep2!r})*{A2}*{A2}*{A2}/720)))"
    )
    return x, y


_PX, _PY = plane_sql("longitude", "latitude")
_UX, _UY = utm_sql("longitude", "latitude")

_WLON, _WLAT = lonlat("s_suppkey", 7393, 19919)
_WA, _WB = utm_sql("lon1", "lat1"), utm_sql("lon2", "lat2")

_HUB_KM = f"(sqrt((p.px-hx)*(p.px-hx) + (p.py-hy)*(p.py-hy)) * {METRES_PER_US_FOOT / 1000.0!r}::DOUBLE)"
SITING_ROUNDS = K.MAX_SITING_ROUNDS


def _siting_round(n: int) -> dict[str, tuple[list[str], str]]:
    """One round of every scenario: the serial rule down the facilities by size, then the centroids."""
    choice = "coalesce(list_filter(f.prefs, lambda h: acc.loads[h + 1] + f.w <= room)[1], -1)"
    blank = "[]::BIGINT[]"
    return {
        f"scenario_fill{n}": (["plane", "scenario_room", f"scenario_hub{n}"], f"""
SELECT s, list(permit_id ORDER BY w DESC, permit_id) AS ids,
  list_reduce(list({{'loads': {blank}, 'picks': {blank}, 'w': w, 'prefs': prefs}} ORDER BY w DESC, permit_id),
    lambda acc, f: {{'loads': list_transform(acc.loads, lambda x, i: CASE WHEN i - 1 = {choice} THEN x + f.w ELSE x END),
      'picks': list_append(acc.picks, {choice}), 'w': f.w, 'prefs': f.prefs}},
    {{'loads': list_transform(range({max(T.SCENARIOS)}), lambda x: 0::BIGINT), 'picks': {blank}, 'w': 0::BIGINT, 'prefs': {blank}}}).picks AS picks
FROM (SELECT s, permit_id, w, list(k ORDER BY km, k) AS prefs
  FROM (SELECT s, permit_id, headcount AS w, k, {_HUB_KM} AS km FROM plane p CROSS JOIN scenario_hub{n}) GROUP BY ALL)
CROSS JOIN scenario_room GROUP BY s, room"""),
        f"scenario_done{n}": (["plane", f"scenario_fill{n}"], f"""
SELECT l.s, permit_id, l.pick, p.px, p.py, h.hx, h.hy
FROM (SELECT s, unnest(ids) AS permit_id, unnest(picks) AS pick FROM scenario_fill{n}) l JOIN plane p USING (permit_id)
LEFT JOIN scenario_hub{n} h ON h.s = l.s AND h.k = l.pick"""),
        f"scenario_hub{n + 1}": ([f"scenario_done{n}"], f"""
SELECT s, k, CASE WHEN go THEN nx ELSE hx END AS hx, CASE WHEN go THEN ny ELSE hy END AS hy
FROM (SELECT *, sqrt(sum((nx-hx)*(nx-hx) + (ny-hy)*(ny-hy)) OVER (PARTITION BY s)) >= {K.CONVERGED_MOVE} AS go
  FROM (SELECT h.s, h.k, h.hx, h.hy, coalesce(mx, h.hx) AS nx, coalesce(my, h.hy) AS ny FROM scenario_hub{n} h
    LEFT JOIN (SELECT s, pick AS k, avg(px) AS mx, avg(py) AS my FROM scenario_done{n} WHERE pick >= 0 GROUP BY ALL) m USING (s, k)))"""),
    }


VIEWS: dict[str, tuple[list[str], str]] = {
    "waterway": ([], f"""
SELECT line_id, {_WA[0]} AS ax, {_WA[1]} AS ay, {_WB[0]} AS bx, {_WB[1]} AS b_y
FROM (SELECT line_id, lon + f1*east AS lon1, lat + g1*north AS lat1, lon + f2*east AS lon2, lat + g2*north AS lat2
  FROM (SELECT s_suppkey AS line_id, {_WLON} AS lon, {_WLAT} AS lat,
      CASE WHEN s_suppkey % 11 = 0 THEN 0.0::DOUBLE ELSE (s_suppkey % 7 - 3) / 100.0::DOUBLE END AS east,
      CASE WHEN s_suppkey % 11 = 0 THEN 0.0::DOUBLE ELSE (s_suppkey % 5 - 2) / 125.0::DOUBLE END AS north FROM supplier)
  CROSS JOIN (VALUES (0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE), (1.0, 1.0, 2.0, 0.5)) AS v(f1, g1, f2, g2))"""),
    "permit": ([], f"""
SELECT c_custkey AS permit_id, '  ' || c_name || ' ' AS farm_name,
  {_case("c_custkey % 3", T.DESIGNATIONS)} AS designation,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Broiler Chicken' WHEN 'BUILDING' THEN '  TURKEY '
    WHEN 'FURNITURE' THEN 'dairy' WHEN 'HOUSEHOLD' THEN 'hog'
    WHEN 'MACHINERY' THEN 'chickens_not_laying_hens' END AS animal_type,
  greatest(0::BIGINT, (CAST(round(c_acctbal*100) AS BIGINT)*2)//5) AS headcount,
  {_case("c_custkey % 6", T.STATUSES)} AS status,
  {_case("c_nationkey % 10", T.COUNTIES)} AS county,
  'City' || (c_custkey % 40) || ', MD ' || (21600 + c_custkey % 90) AS city_state_zip,
  CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 13 = 0 THEN 'unknown'
    ELSE c_custkey || ' Main St' END AS address,
  CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 97 = 0 THEN -75.80::DOUBLE
    ELSE {LON} END AS longitude,
  CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 97 = 0 THEN 38.80::DOUBLE
    ELSE {LAT} END AS latitude
FROM customer"""),
    "registry": (["permit"], """
SELECT *, CASE WHEN permit_id % 17 = 0 THEN 'n/a' WHEN permit_id % 19 = 0 THEN NULL
    WHEN permit_id % 23 = 0 THEN headcount || '.75' ELSE headcount || '' END AS animals_text,
  headcount % 1000 AS laying_hens, (headcount // 7) % 1000 AS dairy_cattle,
  (headcount // 13) % 1000 AS ducks
FROM permit"""),
    "located": (["permit"], """
SELECT * FROM permit WHERE longitude IS NOT NULL AND latitude IS NOT NULL"""),
    "plane": (["located"], f"""
SELECT *, {_PX} AS px, {_PY} AS py FROM located"""),
    "utm": (["located"], f"""
SELECT *, {_UX} AS ux, {_UY} AS uy FROM located"""),
    "candidate": ([], f"""
SELECT s_suppkey AS site_id, {SLON} AS longitude, {SLAT} AS latitude FROM supplier"""),
    "site_plane": (["candidate"], f"""
SELECT *, {_PX} AS px, {_PY} AS py FROM candidate"""),
    "scenario_room": (["plane"], """
SELECT (sum(headcount) * 9 // 100)::BIGINT AS room FROM plane"""),
    "scenario_hub0": (["plane"], f"""
SELECT n AS s, (n - rk)::BIGINT AS k, px AS hx, py AS hy
FROM (SELECT px, py, row_number() OVER (ORDER BY headcount DESC, permit_id) AS rk FROM plane)
CROSS JOIN (SELECT unnest({T.SCENARIOS}) AS n) WHERE rk <= n"""),
    "assignment": (["plane", f"scenario_done{SITING_ROUNDS - 1}"], f"""
SELECT s AS n_hubs, permit_id, farm_name, animal_type, p.headcount, county, longitude, latitude,
  pick::INTEGER AS assigned_site_idx, {_HUB_KM} AS distance_to_hub_km
FROM plane p JOIN scenario_done{SITING_ROUNDS - 1} d USING (permit_id)"""),
    "scenario_site": ([f"scenario_hub{SITING_ROUNDS}"], f"""
SELECT s AS n_hubs, k::INTEGER AS site_id, hx AS px, hy AS py FROM scenario_hub{SITING_ROUNDS}"""),
    "raster": ([], f"""
SELECT tile_id, row, col, {_case("(row//4 + col//6 + tile_id) % 10", T.RASTER_CODES)} AS code
FROM (SELECT (o_orderkey // 10000)::INTEGER AS tile_id, ((o_orderkey % 10000) // 100)::INTEGER AS row,
  (o_orderkey % 100)::INTEGER AS col FROM orders)"""),
    "rgb": ([], """
SELECT tile_id, row, col,
  (CASE j WHEN 0 THEN 200 + k%20 WHEN 1 THEN 40 ELSE 120 END)::SMALLINT AS r,
  (CASE j WHEN 0 THEN 200 + k%20 WHEN 1 THEN 90 + k%30 ELSE 140 END)::SMALLINT AS g,
  (CASE j WHEN 0 THEN 198 + k%20 WHEN 1 THEN 80 + k%30 ELSE 60 END)::SMALLINT AS b
FROM (SELECT *, ((row//6)*7 + (col//9)*11) % 3 AS j FROM (
  SELECT o_orderkey AS k, (o_orderkey // 10000)::INTEGER AS tile_id,
   ((o_orderkey % 10000) // 100)::INTEGER AS row, (o_orderkey % 100)::INTEGER AS col FROM orders))"""),
    "detection": ([], """
SELECT det_id, tile, '/tiles/naip_' || lpad(tile::VARCHAR, 2, '0') || '.tif' AS tile_path,
  x1, y1, x1 + 20 + n % 60 AS x2, y1 + 12 + n % 40 AS y2, n % 7 AS class_id, confidence
FROM (SELECT event_id AS det_id, (event_id % 20)::INTEGER AS tile, (user_id*7 % 980)::INTEGER AS x1,
  (event_id*13 % 980)::INTEGER AS y1, json_extract(props, '$.k')::INTEGER AS n,
  least(value/500.0::DOUBLE, 1.0::DOUBLE) AS confidence FROM events)"""),
    "embedding": ([], """
SELECT vec_id, CASE WHEN vec_id % 50 <> 7 THEN embedding END AS vector, label FROM embeddings"""),
    "reply": ([], f"""
SELECT c_custkey AS id, c_custkey % 3 <> 0 AS matched, c_custkey % 41 = 1 AS malformed,
  {LON} + 0.001::DOUBLE AS lon, {LAT} + 0.001::DOUBLE AS lat FROM customer"""),
    "edge": (["raster"], "\n" + " UNION ALL ".join(
        f"SELECT tile_id, {pid} AS shape, {a[0]}::DOUBLE AS ax, {a[1]}::DOUBLE AS ay, "
        f"{b[0]}::DOUBLE AS bx, {b[1]}::DOUBLE AS b_y FROM (SELECT DISTINCT tile_id FROM raster)"
        for pid, rings in T.SETBACK_RINGS.items()
        for ring in rings
        for a, b in zip(ring, ring[1:])
    )),
}


for _n in range(SITING_ROUNDS):
    VIEWS |= _siting_round(_n)


def _collect(names: list[str], seen: list[str]) -> None:
    for n in names:
        if n not in seen:
            _collect(VIEWS[n][0], seen)
            seen.append(n)


def with_views(names: list[str], body: str, recursive: bool = False) -> str:
    """SQL text with the named views (and what they need) in front of ``body``.

    ``body`` is either a SELECT or, starting with ``, name AS (``, more expressions.
    """
    order: list[str] = []
    _collect(names, order)
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n][1]})" for n in order)
    body = body.strip()
    joiner = "" if body.startswith(",") else "\n"
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}{joiner}{body}"
