"""Column functions for boxes, projections, rings and pixel grids (no geometry library)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldhub import constants as K

METRES_PER_US_FOOT = 1200.0 / 3937.0


# --- boxes -------------------------------------------------------------------
def box(west: Column, south: Column, east: Column, north: Column) -> Column:
    return F.struct(
        west.alias("west"), south.alias("south"), east.alias("east"), north.alias("north")
    )


def box_around(lon: Column, lat: Column, km: float) -> Column:
    """Box reaching ``km`` from a point, with the usual 111 km degree."""
    return grow_box(box(lon, lat, lon, lat), km)


def grow_box(b: Column, km: float) -> Column:
    mid = (b["south"] + b["north"]) / 2
    dlat = F.lit(km / K.KM_PER_DEGREE)
    dlon = F.lit(float(km)) / (F.lit(K.KM_PER_DEGREE) * F.cos(F.radians(mid)))
    return box(b["west"] - dlon, b["south"] - dlat, b["east"] + dlon, b["north"] + dlat)


def box_center(b: Column) -> Column:
    return F.struct(
        ((b["west"] + b["east"]) / 2).alias("x"), ((b["south"] + b["north"]) / 2).alias("y")
    )


def box_text(b: Column) -> Column:
    return F.concat_ws(",", *[b[s].cast("string") for s in ("west", "south", "east", "north")])


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def box_ring(b: Column) -> Column:
    """Closed 5-point ring, starting at the south-west corner."""
    w, s, e, n = (b[k] for k in ("west", "south", "east", "north"))
    return F.array(point(w, s), point(e, s), point(e, n), point(w, n), point(w, s))


def box_tiles(b: Column, tile_m: float = K.TILE_SIZE_M) -> Column:
    """Array of ``struct(ix, iy, box)`` covering the box, last tiles clipped to its edge.

    A box without width or height has no tiles.
    """
    metres = K.KM_PER_DEGREE * 1000.0
    dlat = F.lit(tile_m / metres)
    dlon = F.lit(float(tile_m)) / (
        F.lit(metres) * F.cos(F.radians((b["south"] + b["north"]) / 2))
    )
    nx = F.ceil(F.try_divide(b["east"] - b["west"], dlon)).cast("int")
    ny = F.ceil((b["north"] - b["south"]) / dlat).cast("int")
    cells = F.transform(
        F.when((nx > 0) & (ny > 0), F.sequence(F.lit(0), nx * ny - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(
            (i / ny).cast("int").alias("ix"), (i % ny).alias("iy")
        ),
    )
    return F.transform(
        cells,
        lambda c: F.struct(
            c["ix"].alias("ix"),
            c["iy"].alias("iy"),
            (b["west"] + c["ix"] * dlon).alias("west"),
            (b["south"] + c["iy"] * dlat).alias("south"),
            F.least(b["west"] + c["ix"] * dlon + dlon, b["east"]).alias("east"),
            F.least(b["south"] + c["iy"] * dlat + dlat, b["north"]).alias("north"),
        ),
    )


# --- projections -------------------------------------------------------------
_UTM_A, _UTM_F, _UTM_K0, _UTM_LON0, _UTM_FE = 6378137.0, 1 / 298.257223563, 0.9996, -75.0, 500000.0
_UTM_E2 = _UTM_F * (2 - _UTM_F)
_UTM_EP2 = _UTM_E2 / (1 - _UTM_E2)


def _utm_terms(lon: Column, lat: Column) -> dict[str, Column]:
    """Shared terms of the transverse Mercator series."""
    phi = F.radians(lat)
    s, c, tan = F.sin(phi), F.cos(phi), F.tan(phi)
    return {
        "phi": phi,
        "n": F.lit(_UTM_A) / F.sqrt(1 - F.lit(_UTM_E2) * s * s),
        "tan": tan,
        "cc": F.lit(_UTM_EP2) * c * c,
        "aa": F.radians(lon - F.lit(_UTM_LON0)) * c,
    }


def _utm_series(v) -> tuple[Column, Column]:
    e2, ep2 = _UTM_E2, _UTM_EP2
    m0 = 1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256
    m2 = 3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024
    m4 = 15 * e2**2 / 256 + 45 * e2**3 / 1024
    m6 = 35 * e2**3 / 3072
    phi, n, tan, cc, aa = (v[k] for k in ("phi", "n", "tan", "cc", "aa"))
    t, a2 = tan * tan, aa * aa
    m = F.lit(_UTM_A) * (
        F.lit(m0) * phi - F.lit(m2) * F.sin(2 * phi) + F.lit(m4) * F.sin(4 * phi)
        - F.lit(m6) * F.sin(6 * phi)
    )
    x = F.lit(_UTM_FE) + F.lit(_UTM_K0) * n * aa * (
        1
        + (1 - t + cc) * a2 / 6
        + (5 - 18 * t + t * t + 72 * cc - F.lit(58 * ep2)) * a2 * a2 / 120
    )
    y = F.lit(_UTM_K0) * (
        m
        + n * tan * (
            a2 / 2
            + (5 - t + 9 * cc + 4 * cc * cc) * a2 * a2 / 24
            + (61 - 58 * t + t * t + 600 * cc - F.lit(330 * ep2)) * a2 * a2 * a2 / 720
        )
    )
    return x, y


def utm18(lon: Column, lat: Column) -> tuple[Column, Column]:
    """WGS84 degrees to UTM zone 18N metres (transverse Mercator series)."""
    return _utm_series(_utm_terms(lon, lat))


@dataclass(frozen=True)
class ConicZone:
    """Lambert conformal conic zone with two standard parallels, in US survey feet."""

    lat1: float = 39.45
    lat2: float = 38.30
    lat0: float = 37.0 + 40.0 / 60.0
    lon0: float = -77.0
    false_easting_m: float = 400000.0
    radius: float = 6378137.0
    inverse_flattening: float = 298.257222101

    @property
    def ecc(self) -> float:
        f = 1 / self.inverse_flattening
        return math.sqrt(f * (2 - f))

    def _m(self, deg: float) -> float:
        p = math.radians(deg)
        return math.cos(p) / math.sqrt(1 - (self.ecc * math.sin(p)) ** 2)

    def _t(self, deg: float) -> float:
        p = math.radians(deg)
        es = self.ecc * math.sin(p)
        return math.tan(math.pi / 4 - p / 2) / ((1 - es) / (1 + es)) ** (self.ecc / 2)

    @property
    def cone(self) -> float:
        return (math.log(self._m(self.lat1)) - math.log(self._m(self.lat2))) / (
            math.log(self._t(self.lat1)) - math.log(self._t(self.lat2))
        )

    @property
    def scale(self) -> float:
        """Radius times the conic constant: rho = scale * t**cone."""
        return self.radius * self._m(self.lat1) / (self.cone * self._t(self.lat1) ** self.cone)

    @property
    def origin_rho(self) -> float:
        return self.scale * self._t(self.lat0) ** self.cone


STATE_PLANE = ConicZone()


def state_plane(lon: Column, lat: Column, zone: ConicZone = STATE_PLANE) -> tuple[Column, Column]:
    """NAD83 degrees to state-plane US survey feet."""
    phi = F.radians(lat)
    es = F.lit(zone.ecc) * F.sin(phi)
    t = F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((1 - es) / (1 + es), F.lit(zone.ecc / 2))
    rho = F.lit(zone.scale) * F.pow(t, F.lit(zone.cone))
    theta = F.lit(zone.cone) * F.radians(lon - F.lit(zone.lon0))
    x = F.lit(zone.false_easting_m) + rho * F.sin(theta)
    y = F.lit(zone.origin_rho) - rho * F.cos(theta)
    return x / F.lit(METRES_PER_US_FOOT), y / F.lit(METRES_PER_US_FOOT)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = ax - bx, ay - by
    return F.sqrt(dx * dx + dy * dy)


def distance_scale(unit: str) -> float:
    """Factor from state-plane feet: 'km' is true kilometres, 'raw' is feet / 1000."""
    return {"km": METRES_PER_US_FOOT / 1000.0, "raw": 1 / 1000.0}[unit]


# --- rings -------------------------------------------------------------------
def ring_edges(ring: Column) -> Column:
    """Array of ``struct(ax, ay, bx, by)`` for a closed ring."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(
        F.slice(ring, 1, n),
        F.slice(ring, 2, n),
        lambda p, q: F.struct(
            p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by")
        ),
    )


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def _bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (lambdas share no subexpressions)."""
    return F.transform(F.array(value), body)[0]


def _shifted(ring: Column) -> Column:
    """The ring about its first vertex, which keeps precision far from the origin."""
    return _bind(
        F.struct(ring.alias("r"), F.get(ring, 0).alias("o")),
        lambda s: F.transform(
            s["r"], lambda p: point(p["x"] - s["o"]["x"], p["y"] - s["o"]["y"])
        ),
    )


def _cross(e: Column) -> Column:
    return e["ax"] * e["by"] - e["bx"] * e["ay"]


def ring_signed_area(ring: Column) -> Column:
    """Shoelace area; positive for a counter-clockwise ring."""
    return _bind(_shifted(ring), lambda r: _total(F.transform(ring_edges(r), _cross))) / 2


def ring_area(ring: Column) -> Column:
    return F.abs(ring_signed_area(ring))


def ring_centroid(ring: Column) -> Column:
    """Area centroid of a closed ring.

    A flat ring has no area and gets the centroid of its line, a ring that is one point that
    point, an empty ring null.
    """

    def moments(r: Column) -> Column:
        edges = ring_edges(r)
        length = lambda e: distance(e["ax"], e["ay"], e["bx"], e["by"])
        return F.struct(
            _total(F.transform(edges, _cross)).alias("a2"),
            _total(F.transform(edges, lambda e: _cross(e) * (e["ax"] + e["bx"]))).alias("mx"),
            _total(F.transform(edges, lambda e: _cross(e) * (e["ay"] + e["by"]))).alias("my"),
            _total(F.transform(edges, length)).alias("l"),
            _total(F.transform(edges, lambda e: length(e) * (e["ax"] + e["bx"]) / 2)).alias("lx"),
            _total(F.transform(edges, lambda e: length(e) * (e["ay"] + e["by"]) / 2)).alias("ly"),
        )

    def place(r: Column) -> Column:
        m = _bind(_shifted(r), moments)
        first = F.get(r, 0)
        along = lambda v, area, line: F.coalesce(
            F.try_divide(v[area], 3 * v["a2"]), F.try_divide(v[line], v["l"]), F.lit(0.0)
        )
        return F.when(first.isNotNull(), _bind(
            m, lambda v: point(first["x"] + along(v, "mx", "lx"), first["y"] + along(v, "my", "ly"))
        ))

    return _bind(ring, place)


def project_ring(ring: Column) -> Column:
    """Ring in degrees to UTM 18N metres."""
    terms = F.transform(
        ring,
        lambda p: F.struct(*[c.alias(k) for k, c in _utm_terms(p["x"], p["y"]).items()]),
    )
    return F.transform(terms, lambda v: point(*_utm_series(v)))


def measured_edges(ring: Column) -> Column:
    """Edges as start, direction and squared length: what distances to many points share."""
    vectors = F.transform(
        ring_edges(ring),
        lambda e: F.struct(
            e["ax"].alias("ax"), e["ay"].alias("ay"),
            (e["bx"] - e["ax"]).alias("dx"), (e["by"] - e["ay"]).alias("dy"),
        ),
    )
    return F.transform(
        vectors,
        lambda v: F.struct(
            *[v[k].alias(k) for k in ("ax", "ay", "dx", "dy")],
            (v["dx"] * v["dx"] + v["dy"] * v["dy"]).alias("l2"),
        ),
    )


def edges_point_distance(edges: Column, px: Column, py: Column) -> Column:
    """Distance from a filled ring (``measured_edges``) to a point: 0 inside."""

    def step(acc: Column, e: Column) -> Column:
        ex, ey = px - e["ax"], py - e["ay"]
        along = F.greatest(
            F.lit(0.0), F.least(F.lit(1.0), (ex * e["dx"] + ey * e["dy"]) / e["l2"])
        )
        crosses = ((e["ay"] > py) != (e["ay"] + e["dy"] > py)) & (ex < ey * e["dx"] / e["dy"])

        def square(u: Column) -> Column:
            gx, gy = ex - u * e["dx"], ey - u * e["dy"]
            return F.least(acc["best"], gx * gx + gy * gy)

        return F.struct(
            _bind(F.when(e["l2"] == 0, F.lit(0.0)).otherwise(along), square).alias("best"),
            (acc["odd"] != crosses).alias("odd"),
        )

    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(False).alias("odd"))
    return F.aggregate(
        edges, start, step, lambda acc: F.when(acc["odd"], F.lit(0.0)).otherwise(F.sqrt(acc["best"]))
    )


def ring_point_distance(ring: Column, px: Column, py: Column) -> Column:
    return edges_point_distance(measured_edges(ring), px, py)


# --- pixel grids (north-up affine: lon = west + a*(col+.5), lat = north + e*(row+.5)) ---
@dataclass(frozen=True)
class Grid:
    """North-up affine of a tile; ``west`` may be a column so tiles can differ."""

    west: Column
    north: Column
    a: float
    e: float

    def lon(self, col: Column) -> Column:
        return self.west + F.lit(self.a) * (col + F.lit(0.5))

    def lat(self, row: Column) -> Column:
        return self.north + F.lit(self.e) * (row + F.lit(0.5))

    def col(self, lon: Column) -> Column:
        return F.floor((lon - self.west) / F.lit(self.a)).cast("int")

    def row(self, lat: Column) -> Column:
        return F.floor((lat - self.north) / F.lit(self.e)).cast("int")


def pixel_box_to_geo(b: Column, grid: Grid) -> Column:
    """Geographic box spanned by the centres of two opposite pixel corners."""
    lon1, lon2 = grid.lon(b["x1"]), grid.lon(b["x2"])
    lat1, lat2 = grid.lat(b["y1"]), grid.lat(b["y2"])
    return box(
        F.least(lon1, lon2), F.least(lat1, lat2), F.greatest(lon1, lon2), F.greatest(lat1, lat2)
    )


def pixel_ring_to_geo(ring: Column, grid: Grid) -> Column:
    """Pixel ring to a closed geographic ring."""
    geo = F.transform(ring, lambda p: point(grid.lon(p["x"]), grid.lat(p["y"])))
    closed = (geo[0]["x"] == F.element_at(geo, -1)["x"]) & (
        geo[0]["y"] == F.element_at(geo, -1)["y"]
    )
    return F.when(closed, geo).otherwise(F.concat(geo, F.array(geo[0])))
