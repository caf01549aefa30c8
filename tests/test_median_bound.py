"""The p-median bound against every choice of sites."""

import itertools
import math
import random

import pytest

from fieldhub.operators import median_bound as B
from fieldhub.operators import siting
from fieldhub.operators.siting import Hub, Median

SOURCES = "permit_id long, headcount long, x double, y double"
SITES = "site_id long, x double, y double"


def cost(sources, sites):
    return sum(w * min(math.hypot(x - a, y - b) for _, a, b in sites) for _, w, x, y in sources)


def make(seed, n=60, m=11):
    draw = random.Random(seed)
    place = lambda: (draw.uniform(0, 1000), draw.uniform(0, 1000))
    return [(k, draw.randrange(500), *place()) for k in range(n)], [(k * 3, *place()) for k in range(m)]


@pytest.mark.parametrize(("seed", "p"), [(1, 1), (2, 2), (3, 3), (4, 4)])
def test_bound_never_exceeds_the_best_choice(spark, seed, p):
    sources, sites = make(seed)
    best = min(cost(sources, some) for some in itertools.combinations(sites, p)) * siting.geo.distance_scale("km")
    found = B.median_bound(spark.createDataFrame(sources, SOURCES), spark.createDataFrame(sites, SITES), p)
    assert all(value <= best * (1 + 1e-9) for value in found.trail)
    assert found.lower <= best * (1 + 1e-9) <= found.upper * (1 + 2e-9)
    assert found.gap <= 0.01
    chosen = [s for s in sites if s[0] in {h.site_id for h in found.sites}]
    assert len(chosen) == p
    assert cost(sources, chosen) * siting.geo.distance_scale("km") == pytest.approx(found.upper)


def test_a_poor_start_is_improved(spark):
    sources, sites = make(5)
    frames = spark.createDataFrame(sources, SOURCES), spark.createDataFrame(sites, SITES)
    worst = max(itertools.combinations(sites, 2), key=lambda some: cost(sources, some))
    start = Median([Hub(*s) for s in worst], cost(sources, worst) * siting.geo.distance_scale("km"), False)
    found = B.median_bound(*frames, 2, start=start)
    best = min(cost(sources, some) for some in itertools.combinations(sites, 2)) * siting.geo.distance_scale("km")
    assert found.lower <= best * (1 + 1e-9) and found.upper < start.objective


def test_places_and_limits(spark):
    sources = spark.createDataFrame([(1, 5, 0.0, 0.0), (2, None, 1.0, 1.0), (3, 4, None, 0.0)], SOURCES)
    sites = spark.createDataFrame([(1, 0.0, 0.0), (2, 9.0, None), (3, 5.0, 5.0)], SITES)
    found = B.median_bound(sources, sites, 1)
    assert (found.lower, found.upper, found.gap, [h.site_id for h in found.sites]) == (0.0, 0.0, 0.0, [1])
    with pytest.raises(ValueError, match="3 sites"):
        B.median_bound(sources, sites, 3, start=Median([], 1.0, False))
