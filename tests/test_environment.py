"""Nearest line and runoff risk against every pair."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fieldhub.operators import balance, nearest_line as N


def distance(p, s):
    (x, y), (_, ax, ay, bx, by) = p, s
    dx, dy = bx - ax, by - ay
    t = 0.0 if dx == dy == 0 else max(0.0, min(1.0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy)))
    return math.hypot(x - ax - t * dx, y - ay - t * dy)


def crowded(draw):
    """A dense spot, a few far lines, a very long one, repeated and pointlike ones."""
    lines = [(k, 5000 + draw.random(), 5000 + draw.random(), 5000 + draw.random(), 5000 + draw.random()) for k in range(300)]
    lines += [(300 + k, *(draw.uniform(0, 100_000) for _ in range(4))) for k in range(40)]
    lines += [(400, 0.0, 0.0, 100_000.0, 90_000.0), (401, 7.0, 7.0, 7.0, 7.0), (402, 7.0, 7.0, 7.0, 7.0), (301, *lines[301][1:])]
    return lines


@pytest.mark.parametrize("crowd", [64, 3])
def test_nearest_line_equals_all_pairs(spark, crowd):
    draw = random.Random(crowd)
    lines = crowded(draw)
    points = [(k, draw.uniform(-50_000, 150_000), draw.uniform(-50_000, 150_000)) for k in range(150)]
    points += [(200 + k, 5000 + draw.random(), 5000 + draw.random()) for k in range(40)] + [(300, None, 1.0), (301, 7.0, 7.0), (302, 7.0, 7.0)]
    segments = spark.createDataFrame([*lines, (9, None, 1.0, 1.0, 1.0)], "line_id long, ax double, ay double, bx double, by double")
    frame = spark.createDataFrame([(*p, "kept") for p in points], "permit_id long, x double, y double, cx string")
    got = {r["permit_id"]: r for r in N.nearest_line(frame, segments, crowd=crowd).collect()}
    assert len(got) == len(points) and got[1]["cx"] == "kept"
    for k, x, y in points:
        if x is None:
            assert got[k]["line_id"] is None and got[k]["line_distance_m"] is None
            continue
        best = min(distance((x, y), s) for s in lines)
        assert got[k]["line_distance_m"] == pytest.approx(best, abs=1e-6)
        assert got[k]["line_id"] in {s[0] for s in lines if distance((x, y), s) <= best + 1e-6}
    assert got[301]["line_id"] == 401


def test_points_meet_few_lines(spark):
    """Plan: no product of points and lines; every join has keys."""
    points = spark.range(2000).select(F.col("id").alias("permit_id"), (F.col("id") % 50 * 10.0).alias("x"), (F.col("id") / 50 * 10.0).alias("y"))
    segments = spark.range(5000).select(
        F.col("id").alias("line_id"), (F.col("id") % 70 * 7.0).alias("ax"), (F.col("id") / 70 * 7.0).alias("ay"),
        (F.col("id") % 70 * 7.0 + 3).alias("bx"), (F.col("id") / 70 * 7.0 + 1).alias("by"))
    out = N.nearest_line(points, segments)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert out.filter("line_id is null").count() == 0


def test_without_lines_or_points(spark):
    none = spark.createDataFrame([], "line_id long, ax double, ay double, bx double, by double")
    points = spark.createDataFrame([(1, 0.0, 0.0)], "permit_id long, x double, y double")
    row = N.nearest_line(points, none).first()
    assert row["line_id"] is None and row["line_distance_m"] is None
    assert N.nearest_line(points.limit(0), none.union(spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0)], none.schema))).count() == 0


def test_segments_of_paths(spark):
    paths = spark.sql("""SELECT * FROM VALUES (1, array(named_struct('x', 0D, 'y', 0D), named_struct('x', 1D, 'y', 0D), named_struct('x', 1D, 'y', 2D))),
        (2, array(named_struct('x', 5D, 'y', 6D))), (3, CAST(array() AS array<struct<x: double, y: double>>)), (4, null) AS t(k, path)""")
    got = sorted(tuple(r) for r in N.segments_of(paths, "k", "path").collect())
    assert got == [(1, 0.0, 0.0, 1.0, 0.0), (1, 1.0, 0.0, 1.0, 2.0), (2, 5.0, 6.0, 5.0, 6.0)]


def test_runoff_risk(spark):
    rows = [(1, 1000.0, 200.0, 50.0), (2, 100.0, 200.0, 500.0), (3, 900.0, None, 300.0), (4, None, 1.0, 10.0), (5, 10.0, 0.0, None)]
    frame = spark.createDataFrame(rows, "permit_id long, annual_n_lbs double, n_demand double, line_distance_m double")
    risks = balance.runoff_risk(frame)
    assert {r["permit_id"]: r["runoff_risk"] for r in risks.collect()} == {1: 8.0, 2: 0.0, 3: 3.0, 4: 0.0, 5: 0.0}
    total = balance.runoff_summary(risks).first()
    assert (total["current_risk"], round(total["hub_risk"], 9), round(total["reduction_pct"], 9)) == (11.0, 1.1, 90.0)
    assert balance.runoff_summary(risks.limit(0)).first()["current_risk"] == 0.0
