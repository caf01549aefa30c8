"""Steps whose rows, memory or passes must not grow faster than their input."""

from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pytest

from fieldhub.catalog import all_entries, environment, geometry
from fieldhub.operators import capacity, components, median_bound, merging, siting, spatial
from fieldhub.operators.siting import Median
from fieldhub.session import Scratch


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("threshold", [3, 12])
def test_merging_links_neighbouring_cells_without_a_broadcast(spark, monkeypatch, threshold):
    rng = random.Random(threshold)
    boxes = [(i, i % 2, (x := rng.randrange(300), y := rng.randrange(300), x + rng.randrange(30), y + rng.randrange(30)))
             for i in range(500)]
    df = spark.createDataFrame(boxes, "det_id bigint, tile int, bbox_px struct<x1:int,y1:int,x2:int,y2:int>")
    seen = []
    label = components.label
    monkeypatch.setattr(merging.components, "label", lambda nodes, edges, key: seen.append((nodes, edges)) or label(nodes, edges, key))
    got = {r["merged_id"]: (r["boxes"], r["tile"]) for r in merging.merge_boxes(df, threshold).collect()}

    group = list(range(len(boxes)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    centre = [((b[0] + b[2]) / 2, (b[1] + b[3]) / 2) for _, _, b in boxes]
    for i in range(len(boxes)):
        for j in range(i):
            if (i - j) % 2 == 0 and math.dist(centre[i], centre[j]) < threshold:
                a, b = sorted((root(i), root(j)))
                group[b] = a
    want = {}
    for i in range(len(boxes)):
        want[root(i)] = (want.get(root(i), (0, 0))[0] + 1, i % 2)
    assert got == want
    (nodes, edges), = seen
    assert "BroadcastHashJoin" not in physical(edges)
    # a cell carries plain numbers, one per line and side, not its centres
    assert not any("struct" in kind for _, kind in nodes.dtypes)


def test_dense_points_far_from_a_polygon_are_not_measured(spark, monkeypatch):
    """Pairs that get an exact distance, with and without a crowd of points within the radius."""
    ring = lambda x, y: [(x, y), (x + 20.0, y), (x + 20.0, y + 20.0), (x, y + 20.0), (x, y)]
    polys = spark.createDataFrame(
        [(i, ring(40.0 * i, 500.0)) for i in range(25)], "polygon_id bigint, ring array<struct<x:double,y:double>>")
    grid = [(k, 31.0 * (k % 40), 31.0 * (k // 40)) for k in range(1600)]
    points = spark.createDataFrame(grid + [(5000, 31.0, 31.0)], "permit_id bigint, x double, y double")
    met = []
    inner = spatial._candidates
    monkeypatch.setattr(spatial, "_candidates", lambda *a, **kw: met.append(inner(*a, **kw)) or met[-1])
    rows = spatial.nearest_within(polys, points, 400.0).collect()
    for r in rows:
        x = 40.0 * r["polygon_id"]
        gaps = sorted((math.hypot(max(x - px, 0, px - x - 20), max(500 - py, 0, py - 520)), k) for k, px, py in grid)
        assert math.isclose(r["join_distance_m"], gaps[0][0], abs_tol=1e-9)
        assert r["join_ties"] == sum(math.isclose(g, gaps[0][0], abs_tol=1e-9) for g, _ in gaps)
    assert len(rows) == 25
    assert sum(df.count() for df in met) <= 25 * 20


def test_report_of_billions_of_animals_matches_its_sql(spark, sf, tmp_path):
    with duckdb.connect() as con:
        con.execute(f"copy (select * replace (c_acctbal * 100000 as c_acctbal) from '{sf}/customer.parquet') "
                    f"to '{tmp_path}/customer.parquet' (format parquet)")
        for name in ("supplier", "orders", "events", "embeddings"):
            con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
        con.execute(f"create view customer as select * from '{tmp_path}/customer.parquet'")
        entry = all_entries()["report_lines"]
        got = sorted(tuple(r) for r in entry.run(spark, str(tmp_path)).collect())
        assert any(len(line.split("AFOs, ")[1].split(" animals")[0]) > 12 for s, _, line in got if s == 2)
        assert got == sorted(con.execute(entry.sql).fetchall())


def test_the_bound_works_out_few_of_many_candidates(spark, monkeypatch):
    rng = random.Random(4)
    place = lambda: (rng.uniform(0, 3e5), rng.uniform(0, 5e5))
    sources = spark.createDataFrame([(rng.randrange(5_000), *place()) for _ in range(400)], "headcount bigint, x double, y double")
    sites = [(k, *place()) for k in range(4_000)]
    table = spark.createDataFrame(sites, "site_id bigint, x double, y double")
    start = Median([siting.Hub(*sites[k]) for k in (5, 900, 3_100)], 1e12, False)
    asked = []
    inner = median_bound._worth
    monkeypatch.setattr(median_bound, "_worth", lambda prices, given, *rest: asked.append(len(given)) or inner(prices, given, *rest))
    found = median_bound.median_bound(sources, table, 3, start=start, rounds=4)
    cut, asked[:] = list(asked), []
    monkeypatch.setattr(median_bound, "AT_ONCE", 10_000)
    whole = median_bound.median_bound(sources, table, 3, start=start, rounds=4)
    assert asked == [4_000] * 4
    assert found.trail == pytest.approx(whole.trail, rel=1e-12) and found.sites == whole.sites
    assert max(cut) < 2_500 and sum(cut) < 4 * 4_000


def test_the_bound_works_out_next_to_no_candidates_and_deals_its_sources(spark, monkeypatch):
    """Planes leave few of many sites, also of sites on a line and on one spot; sources on one spot are one."""
    rng = random.Random(6)
    place = lambda: (rng.uniform(0, 3e5), rng.uniform(0, 5e5))
    spots = [place() for _ in range(300)]
    rows = [(rng.randrange(-50, 5_000), *spots[k % 300]) for k in range(900)] + [(None, 1.0, 1.0), (7, None, 1.0)]
    sources = spark.createDataFrame(rows, "headcount bigint, x double, y double").coalesce(1)
    sites = [(k, *place()) for k in range(2_600)]
    sites += [(3_000 + k, 1e5, 2e5 + 40.0 * k) for k in range(200)] + [(4_000 + k, 1.5e5, 2.4e5) for k in range(100)]
    table = spark.createDataFrame(sites, "site_id bigint, x double, y double")
    start = Median([siting.Hub(*sites[k]) for k in (5, 900)], 1e12, False)
    asked, read = [], []
    inner, most = median_bound._worth, median_bound._most_worth
    monkeypatch.setattr(median_bound, "_worth", lambda prices, given, *rest: asked.append(len(given)) or inner(prices, given, *rest))
    monkeypatch.setattr(median_bound, "_most_worth", lambda places, *rest: read.append(places) or most(places, *rest))
    found = median_bound.median_bound(sources, table, 2, start=start, rounds=5)
    assert len(read[0].inputFiles()) > 1 and read[0].count() <= 300
    cut, asked[:] = list(asked), []
    monkeypatch.setattr(median_bound, "AT_ONCE", 10_000)
    whole = median_bound.median_bound(sources, table, 2, start=start, rounds=5)
    assert asked == [2_900] * 5 and sum(cut) < 5 * 290
    assert found.trail == pytest.approx(whole.trail, rel=1e-12) and found.sites == whole.sites


def test_detection_columns_are_worked_out_once(spark, sf):
    """The events' text is parsed once a row, however many vertices read what comes of it."""
    plan = all_entries()["geojson_polygons"].run(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("get_json_object") == 1


@pytest.mark.parametrize("slack", [0.5, 0.9, 1.2, 3.0])
def test_rows_without_a_full_hub_are_chosen_together(monkeypatch, slack):
    rng = np.random.default_rng(int(slack * 10))
    for most in (1, 3, 1_000):
        weights = np.sort(rng.integers(0, most + 1, 5_000).astype(float))[::-1]
        dist, start = np.round(rng.random((5_000, 4)) * 3), rng.integers(0, 50, 4).astype(float)
        given = weights, dist, start, slack * weights.sum() / 4
        with monkeypatch.context() as one_by_one:
            one_by_one.setattr(capacity, "_plain", lambda *_: None)
            wanted = capacity.fill(*given)
        got = capacity.fill(*given)
        assert all(np.array_equal(getattr(got, c), getattr(wanted, c)) for c in ("choice", "added", "up", "down"))


def test_settling_reads_a_row_per_bucket_without_a_shuffle(spark):
    rows = [(i, (i * 37) % 500, float(i % 91), float(i % 57)) for i in range(3_000)]
    scratch = Scratch(spark, "test", keep=4)
    points = capacity.bucketed(spark.createDataFrame(rows, "permit_id bigint, headcount bigint, x double, y double"), scratch, 6)
    table = siting.packed(points, scratch)
    problems = {0: capacity.Problem(capacity.Hubs.of([siting.Hub(0, 1.0, 1.0)], 1e9, "km"), np.zeros((6, 1)))}
    sums = table.mapInPandas(capacity._sums(problems, {0: set(range(6))}), capacity._SUMS)
    assert table.count() == 6 and "Exchange" not in physical(sums)
    assert sum(r["n"][0] for r in sums.collect()) == 3_000
    for r in table.collect():
        order = points.filter(points["bucket"] == r["bucket"]).orderBy("headcount", "permit_id", ascending=[False, True])
        weights = np.frombuffer(bytes(r["body"])).reshape(3, -1)[0].tolist()
        assert weights == [o["headcount"] for o in order.collect()]


def test_tiles_of_a_file_of_one_split_are_made_by_all_cores(spark, sf):
    tiles = geometry.tile_grid(spark, sf)
    assert tiles.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism > 1


def test_points_near_water_are_worked_out_once_and_by_all_cores(spark, sf, monkeypatch):
    monkeypatch.setattr(environment, "nearest_line", lambda points, segments: points)
    points = environment.near_water(spark, sf)
    assert 1 < len(points.inputFiles()) <= spark.sparkContext.defaultParallelism
    assert "cos" not in physical(points).lower()
