"""Nearest join, masks, regions, merging and components against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldhub.functions import geo
from fieldhub.operators import balance, components, merging, raster, spatial


def ring_of(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]


def box_distance(x, y, w, h, px, py):
    dx = max(x - px, 0.0, px - x - w)
    dy = max(y - py, 0.0, py - y - h)
    return math.sqrt(dx * dx + dy * dy)


POLY = "polygon_id bigint, ring array<struct<x:double,y:double>>"


@pytest.mark.parametrize("crowd_limit", [2048, 3])
@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_within(spark, crowd_limit, seed):
    """Both the plain grid and the refined grid give the all-pairs answer, ties included."""
    rng = random.Random(seed)
    boxes = [
        (i, rng.uniform(-900, 900), rng.uniform(-900, 900), rng.uniform(1, 90), rng.uniform(1, 90))
        for i in range(60)
    ]
    points = [(i, rng.uniform(-1000, 1000), rng.uniform(-1000, 1000)) for i in range(60)]
    points += [(100 + i, 250.0, 250.0) for i in range(20)]  # many facilities on one spot
    points += [(200 + i, 260 + rng.uniform(0, 4), 260 + rng.uniform(0, 4)) for i in range(60)]
    polys = spark.createDataFrame([(b[0], ring_of(*b[1:])) for b in boxes], POLY)
    pts = spark.createDataFrame(points, "permit_id bigint, x double, y double")
    radius = 200.0
    want = set()
    for pid, *b in boxes:
        ds = [(box_distance(*b, px, py), i) for i, px, py in points]
        best = min(ds)[0]
        hits = [i for dist, i in ds if dist == best] if best <= radius else [None]
        want |= {(pid, i, round(best, 6) if i is not None else None) for i in hits}
    run = lambda **kw: {
        (r["polygon_id"], r["permit_id"],
         None if r["join_distance_m"] is None else round(r["join_distance_m"], 6))
        for r in spatial.nearest_within(polys, pts, radius, crowd_limit=crowd_limit, **kw).collect()
    }
    got = run(ties=True)
    assert got == want
    single = run()
    assert len(single) == len(boxes)
    assert single == {min((w for w in want if w[0] == pid), key=lambda w: w[1] or 0) for pid, *_ in boxes}


@pytest.mark.parametrize("crowd_limit", [2048, 1])
def test_points_exactly_as_far_as_the_radius_are_found(spark, crowd_limit):
    """Squares of this distance exceed the radius's square by rounding, the distance is the radius."""
    dy = math.nextafter(120.0, 200.0)
    assert 90.0 * 90.0 + dy * dy > 150.0 * 150.0 and math.sqrt(90.0 * 90.0 + dy * dy) == 150.0
    polys = spark.createDataFrame([(1, ring_of(0.0, 0.0, 10.0, 10.0)), (2, ring_of(9_000.0, 0.0, 10.0, 10.0))], POLY)
    points = spark.createDataFrame(
        [(7, -90.0, -dy), (8, 8_850.0, 5.0), (9, 8_910.0, -dy), (10, 5_000.0, 9_000.0)], "permit_id bigint, x double, y double")
    for radius in (150.0, 16 * 150.0):  # the last and the first reach
        found = spatial.nearest_within(polys, points, radius, crowd_limit=crowd_limit).collect()
        rows = sorted((r["polygon_id"], r["permit_id"], r["join_distance_m"], r["join_ties"]) for r in found)
        assert rows == [(1, 7, 150.0, 1), (2, 8, 150.0, 2)]
        every = spatial.nearest_within(polys, points, radius, crowd_limit=crowd_limit, ties=True).collect()
        assert sorted((r["polygon_id"], r["permit_id"]) for r in every) == [(1, 7), (2, 8), (2, 9)]


def test_close_centers_and_merge(spark):
    rng = random.Random(5)
    dets = []
    for i in range(160):
        x, y = rng.randrange(0, 220), rng.randrange(0, 220)
        dets.append((i, i % 2, (x, y, x + rng.randrange(4, 20), y + rng.randrange(4, 20))))
    dets += [(1000 + i, 0, (50, 50, 60, 60)) for i in range(30)]  # copies on one spot
    df = spark.createDataFrame(
        dets, "det_id bigint, tile int, bbox_px struct<x1:int,y1:int,x2:int,y2:int>"
    )
    center = lambda b: ((b[0] + b[2]) / 2, (b[1] + b[3]) / 2)
    close = lambda p, q: p[1] == q[1] and math.dist(center(p[2]), center(q[2])) < 12

    pairs = spatial.close_centers(spatial.box_centers(df), 12).collect()
    weight = sum(r["n_a"] * r["n_b"] for r in pairs)
    brute = sum(
        close(p, q) and center(p[2]) != center(q[2]) for i, p in enumerate(dets) for q in dets[i + 1 :]
    )
    assert weight == brute

    group = {p[0]: p[0] for p in dets}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, p in enumerate(dets):
        for q in dets[i + 1 :]:
            if close(p, q):
                a, b = sorted((root(p[0]), root(q[0])))
                group[b] = a
    want = {}
    for p in dets:
        g = want.setdefault(root(p[0]), [0, 0, 10**9, 10**9, -1, -1])
        x1, y1, x2, y2 = p[2]
        g[0] += 1
        g[1] += (x2 - x1) * (y2 - y1)
        g[2:] = [min(g[2], x1), min(g[3], y1), max(g[4], x2), max(g[5], y2)]
    got = {
        r["merged_id"]: [r["boxes"], r["area_px"], r["x1"], r["y1"], r["x2"], r["y2"]]
        for r in merging.merge_boxes(df).collect()
    }
    assert got == want


@pytest.mark.parametrize("hot_split_edges", [10**9, 1])
def test_components_on_chain_and_star(spark, hot_split_edges, monkeypatch):
    monkeypatch.setattr(components, "HOT_NODES", 20)  # nodes with more than ~50 edges are hot
    chain = [(i, i + 1) for i in range(0, 300)]
    star = [(1000, 1000 + i) for i in range(1, 200)] + [(3000, 3000 - i) for i in range(1, 200)]
    pairs = [(5000, 5001), (5001, 5000), (6000, 6000)]
    edges = chain + star + pairs
    random.Random(3).shuffle(edges)
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = dict(map(tuple, components.connected_components(df, hot_split_edges=hot_split_edges).collect()))
    want = {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(200)} | {
        3000 - i: 2801 for i in range(200)} | {5000: 5000, 5001: 5000}
    assert got == want


def pixels_of(spark, mask):
    rows = [(0, r, c, bool(mask[r, c])) for r in range(mask.shape[0]) for c in range(mask.shape[1])]
    return spark.createDataFrame(rows, "tile_id int, row int, col int, on boolean")


def grow(mask, radius):
    out = np.zeros_like(mask)
    h, w = mask.shape
    for r, c in zip(*np.nonzero(mask)):
        out[max(0, r - radius) : r + radius + 1, max(0, c - radius) : c + radius + 1] = True
    return out


@pytest.mark.parametrize("size", [3, 7])
def test_morphology(spark, size):
    mask = np.random.default_rng(size).random((40, 150)) < 0.45
    words = raster.pack(pixels_of(spark, mask), F.col("on"))
    radius = size // 2
    shrink = lambda m: ~grow(~m, radius)
    cases = {
        "close": (raster.close_mask, shrink(grow(mask, radius))),
        "open": (raster.open_mask, grow(shrink(mask), radius)),
    }
    for op, want in cases.values():
        got = {(r["row"], r["col"]) for r in raster.unpack(op(words, size)).collect()}
        assert got == set(zip(*map(lambda a: a.tolist(), np.nonzero(want))))


@pytest.mark.parametrize("band_rows", [64, 1, 7])
def test_regions_against_flood_fill(spark, band_rows):
    mask = np.random.default_rng(9).random((30, 140)) < 0.42
    seen, want = np.zeros_like(mask), set()
    for r0, c0 in zip(*np.nonzero(mask)):
        if seen[r0, c0]:
            continue
        stack, cells = [(r0, c0)], []
        seen[r0, c0] = True
        while stack:
            r, c = stack.pop()
            cells.append((r, c))
            for dr in (-1, 0, 1):
                for dc in (-1, 0, 1):
                    rr, cc = r + dr, c + dc
                    if 0 <= rr < 30 and 0 <= cc < 140 and mask[rr, cc] and not seen[rr, cc]:
                        seen[rr, cc] = True
                        stack.append((rr, cc))
        rows, cols = zip(*cells)
        want.add((len(cells), int(min(rows)), int(max(rows)), int(min(cols)), int(max(cols))))
    on = raster.pack(pixels_of(spark, mask), F.col("on"))
    got = {
        (r["area_px"], r["row_min"], r["row_max"], r["col_min"], r["col_max"])
        for r in raster.regions(on, band_rows).collect()
    }
    assert got == want


def test_polygon_mask_against_even_odd(spark):
    rng = random.Random(11)
    polys = []
    for pid in range(6):
        cx, cy = rng.uniform(5, 95), rng.uniform(5, 35)
        n = rng.randrange(3, 9)
        pts = [
            (cx + rng.uniform(3, 25) * math.cos(2 * math.pi * k / n),
             cy + rng.uniform(3, 18) * math.sin(2 * math.pi * k / n))
            for k in range(n)
        ]
        rings = [pts + pts[:1]]
        if pid % 2:
            rings.append(ring_of(cx - 2, cy - 2, 4, 4))
        polys.append((0, pid, rings))
    df = spark.createDataFrame(
        polys, "tile_id int, polygon_id bigint, rings array<array<struct<x:double,y:double>>>"
    )

    def inside(px, py, rings):
        odd = False
        for ring in rings:
            for (ax, ay), (bx, by) in zip(ring, ring[1:]):
                if (ay <= py) != (by <= py) and ax + (py - ay) * (bx - ax) / (by - ay) > px:
                    odd = not odd
        return odd

    pixels = pixels_of(spark, np.ones((40, 100), dtype=bool)).drop("on")
    got = {
        (r["row"], r["col"])
        for r in raster.with_setback(pixels, df, 40, 100).filter("masked").collect()
    }
    want = {
        (r, c) for r in range(40) for c in range(100)
        if any(inside(c + 0.5, r + 0.5, rings) for _, _, rings in polys)
    }
    assert got == want and want


def test_full_word_runs(spark):
    """Runs that fill, start and end 64-pixel words."""
    runs = spark.createDataFrame(
        [(0, 1, 0, 0, 63), (0, 1, 1, 63, 64), (0, 1, 2, 0, 199), (0, 2, 2, 100, 150)],
        "tile_id int, polygon_id bigint, row int, col_start int, col_end int",
    )
    words = raster.run_words(runs).withColumn("valid", F.lit(-1).cast("bigint"))
    got = {(r["row"], r["col"]) for r in raster.unpack(words).collect()}
    want = {(0, c) for c in range(64)} | {(1, 63), (1, 64)} | {(2, c) for c in range(200)}
    assert got == want


def test_demand_without_setbacks_and_blocks(spark):
    pixels = spark.createDataFrame(
        [(0, 0, c, code) for c, code in enumerate([1, 5, 111, 42])],
        "tile_id int, row int, col int, code int",
    )
    plain = raster.demand_map(pixels, None, 1, 4).orderBy("col").collect()
    assert [(r["n_demand"], r["p_demand"]) for r in plain] == [(150, 60), (0, 45), (0, 0), (120, 80)]
    gaps = raster.to_blocks(pixels.filter("col <> 1"), width=4).first()
    assert gaps["codes"] == [1, None, 111, 42]
    block = raster.block_demand(raster.to_blocks(pixels)).first()
    assert block["n_demand"] == [150, 0, 0, 120] and block["p_demand"] == [60, 45, 0, 80]


def test_points_in_boxes_edges_included(spark):
    boxes = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0)], "west double, south double, east double, north double")
    points = spark.createDataFrame([(0.0, 1.0), (1.0, 1.0), (1.0001, 0.5), (-0.1, 0.2)], "x double, y double")
    assert spatial.points_in_boxes(points, boxes, "x", "y", 0.3).count() == 2


def test_regions_of_far_tiles_stay_apart(spark):
    """Tile, row and column numbers of any size, in one place of different tiles."""
    places = [(0, 0), (2**24, 0), (2**31 - 1, 2**30), (5, 2**20)]
    rows = [(tile, row + r, 2**20 + c) for tile, row in places for r in range(2) for c in range(70)]
    pixels = spark.createDataFrame(rows, "tile_id int, row int, col int")
    found = raster.regions(raster.pack(pixels, F.lit(True))).collect()
    assert {(r["tile_id"], r["first_row"], r["area_px"]) for r in found} == {(t, row, 140) for t, row in places}


def test_shapes_without_size(spark):
    """Flat and empty rings, boxes and extents give nothing or a point, never an error."""
    p = lambda *xy: [{"x": float(x), "y": float(y)} for x, y in xy]
    rings = [(1, p((0, 0), (2, 0), (4, 0), (0, 0))), (2, []), (3, p((1, 1), (1, 1), (1, 1))), (4, None), (5, p((0, 0), (2, 0), (2, 2), (0, 2), (0, 0)))]
    df = spark.createDataFrame(rings, "id int, ring array<struct<x:double,y:double>>")
    got = {r["id"]: r for r in df.select(
        "id", geo.ring_area(F.col("ring")).alias("area"), geo.ring_centroid(F.col("ring")).alias("c"),
        geo.ring_point_distance(F.col("ring"), F.lit(3.0), F.lit(1.0)).alias("d")).collect()}
    assert [got[i]["area"] for i in (1, 2, 3, 4, 5)] == [0, 0, 0, None, 4]
    assert tuple(got[1]["c"]) == (2, 0) and got[2]["c"] is None and tuple(got[3]["c"]) == (1, 1) and tuple(got[5]["c"]) == (1, 1)
    assert got[1]["d"] == 1 and got[5]["d"] == 1
    boxes = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 1.0, 0.0), (1.0, 1.0, 0.0, 0.0)], "west double, south double, east double, north double")
    tiles = boxes.select(F.size(geo.box_tiles(F.struct("west", "south", "east", "north"))).alias("n")).collect()
    assert [r["n"] for r in tiles] == [0, 0, 0]
    assert balance.candidate_grid(boxes).count() == 0


def test_a_crowded_spot_gives_one_row_per_polygon(spark):
    """10^5 facilities on one coordinate: one row each, and the ties as a number."""
    polys = spark.createDataFrame([(i, ring_of(100.0 + i, 90.0, 5, 5)) for i in range(40)], POLY)
    pts = spark.range(100_000).selectExpr("id AS permit_id", "100D AS x", "100D AS y")
    rows = spatial.nearest_within(polys, pts, 200.0).collect()
    assert len(rows) == 40 and all(r["permit_id"] == 0 and r["join_ties"] == 100_000 for r in rows)
