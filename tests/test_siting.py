"""Capacity assignment, refinement and p-median against serial and exhaustive versions."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldhub.operators import capacity, embeddings, siting
from fieldhub.operators.siting import Hub
from fieldhub.plans import siting_run
from fieldhub.session import Scratch

POINTS = "permit_id bigint, headcount bigint, x double, y double"


def serial(rows, hubs, room):
    """Site id of each facility by the serial rule; the lower id wins ties."""
    hubs = sorted(hubs, key=lambda h: h.site_id)
    load, pick = {h.site_id: 0 for h in hubs}, {}
    for pid, w, x, y in sorted(rows, key=lambda r: (-r[1], r[0])):
        order = sorted(hubs, key=lambda h: (math.sqrt((x - h.x) ** 2 + (y - h.y) ** 2), h.site_id))
        pick[pid] = next((h.site_id for h in order if load[h.site_id] + w <= room), -1)
        if pick[pid] >= 0:
            load[pick[pid]] += w
    return pick


def make(n, seed, same=0.3):
    """Points with a third of the facilities sharing one headcount."""
    rng = random.Random(seed)
    return [
        (i, 40 if rng.random() < same else rng.randrange(0, 100), rng.uniform(0, 1e5), rng.uniform(0, 1e5))
        for i in range(n)
    ]


@pytest.mark.parametrize(("buckets", "slack", "ids"), [
    (1, 1.1, range(5)), (4, 1.1, range(5)), (16, 0.8, range(5)), (60, 1.02, [205, 100, 7, 900, 3]),
])
def test_capacity_assignment_equals_serial_rule(spark, buckets, slack, ids):
    rows = make(240, 7)
    hubs = [Hub(k, r[2], r[3]) for k, r in zip(ids, rows[:5])]
    room = sum(r[1] for r in rows) * slack / 5
    df = spark.createDataFrame(rows, POINTS)
    out = siting.assign_with_capacity(df, hubs, room, buckets=buckets).collect()
    assert {r["permit_id"]: r["assigned_site_idx"] for r in out} == serial(rows, hubs, room)
    for r in out:
        if r["assigned_site_idx"] >= 0:
            h = next(h for h in hubs if h.site_id == r["assigned_site_idx"])
            d = math.dist((r["x"], r["y"]), (h.x, h.y)) * siting.geo.METRES_PER_US_FOOT / 1000
            assert r["distance_to_hub_km"] == pytest.approx(d)
        else:
            assert r["distance_to_hub_km"] is None


def test_margins_tell_which_starts_change_nothing():
    rng = np.random.default_rng(5)
    weights = np.sort(rng.integers(1, 60, 300))[::-1].astype(float)
    dist = rng.random((300, 6))
    start = rng.integers(0, 300, 6).astype(float)
    found = capacity.fill(weights, dist, start, 1_200.0)
    assert (found.choice < 0).any()
    for _ in range(300):
        moved = start + rng.integers(-6, 7, 6)
        again = capacity.fill(weights, dist, moved, 1_200.0)
        within = (moved - start <= found.up).all() and (moved - start > found.down).all()
        assert not within or (again.choice == found.choice).all()


def test_steps_choose_what_single_rows_choose(monkeypatch):
    rng = np.random.default_rng(6)
    weights = np.sort(rng.integers(0, 90, 400))[::-1].astype(float)
    dist = rng.integers(0, 9, (400, 4)).astype(float)
    whole = capacity.fill(weights, dist, np.zeros(4), 4_000.0)
    monkeypatch.setattr(capacity, "STEP_ROWS", 1)
    one = capacity.fill(weights, dist, np.zeros(4), 4_000.0)
    assert (whole.choice == one.choice).all() and (whole.up == one.up).all() and (whole.down == one.down).all()


def test_rounds_of_settling_stay_few(spark):
    """A tight capacity at two sizes: ten times the rows and buckets take about as many rounds."""
    rounds = []
    for n, buckets in ((300, 10), (3_000, 100)):
        rows = make(n, 9)
        hubs = [Hub(k, r[2], r[3]) for k, r in enumerate(rows[:6])]
        df = capacity.bucketed(spark.createDataFrame(rows, POINTS), Scratch(spark, "t"), buckets)
        done = capacity.settle(df, hubs, sum(r[1] for r in rows) * 0.95 / 6)
        rounds.append(done.rounds)
        assert {r["permit_id"]: r["assigned_site_idx"] for r in done.table.collect()} == serial(
            rows, hubs, sum(r[1] for r in rows) * 0.95 / 6)
    assert rounds[1] <= rounds[0] + 12, rounds


def test_no_facilities(spark):
    assert siting.assign_with_capacity(spark.createDataFrame([], POINTS), [Hub(1, 0.0, 0.0)], 5).count() == 0


def test_refinement_keeps_hubs_on_convergence(spark):
    rows = make(90, 3)
    df = spark.createDataFrame(rows, POINTS)
    run = siting.refine_hubs(df, 4)
    assert run.converged and run.trail[-1] < 100
    by_id = {r[0]: r for r in rows}
    hubs = siting.initial_hubs(df, 4)
    assert [h.x for h in hubs] == [
        r[2] for r in sorted(sorted(rows, key=lambda r: (-r[1], r[0]))[:4], key=lambda r: (r[1], -r[0]))
    ]
    capacity = siting.default_capacity(df, 4)
    for _ in range(20):
        pick = serial(rows, hubs, capacity)
        moved = []
        for h in hubs:
            mine = [by_id[i] for i, k in pick.items() if k == h.site_id]
            moved.append(
                Hub(h.site_id, sum(r[2] for r in mine) / len(mine), sum(r[3] for r in mine) / len(mine))
                if mine else h
            )
        move = math.sqrt(sum((a.x - b.x) ** 2 + (a.y - b.y) ** 2 for a, b in zip(hubs, moved)))
        if move < 100:
            break
        hubs = moved
    for got, want in zip(run.hubs, hubs):
        assert (got.x, got.y) == (pytest.approx(want.x), pytest.approx(want.y))


@pytest.mark.parametrize("slack", [1.1, 0.8])
def test_batched_runs_equal_single_ones(spark, slack):
    """Scenarios share their passes and settle one by one; tight hubs leave facilities out."""
    rows = make(120, 5)
    df = spark.createDataFrame(rows, POINTS)
    room = sum(r[1] for r in rows) * slack / 5
    many = siting.refine_many(df, [3, 5, 7], room, max_rounds=6)
    for p in (3, 5, 7):
        alone, run = siting.refine_hubs(df, p, room, max_rounds=6), many.runs[p]
        assert (run.rounds, run.converged) == (alone.rounds, alone.converged) and len(run.settling) == run.rounds
        assert [(h.site_id, h.x, h.y) for h in run.hubs] == [(h.site_id, pytest.approx(h.x), pytest.approx(h.y)) for h in alone.hubs]
        table = {r["permit_id"]: r["assigned_site_idx"] for r in many.table.filter(F.col("run") == p).collect()}
        assert table == {r["permit_id"]: r["assigned_site_idx"] for r in run.assigned.collect()}
        hubs = siting.initial_hubs(df, p)
        for _ in range(run.rounds):
            pick = serial(rows, hubs, room)
            before, hubs = hubs, moved_hubs(rows, pick, hubs)
        assert table == pick
    assert slack > 1 or -1 in {r["assigned_site_idx"] for r in many.table.select("assigned_site_idx").distinct().collect()}


def moved_hubs(rows, pick, hubs):
    out = []
    for h in hubs:
        mine = [r for r in rows if pick[r[0]] == h.site_id]
        out.append(Hub(h.site_id, sum(r[2] for r in mine) / len(mine), sum(r[3] for r in mine) / len(mine)) if mine else h)
    return out


def test_scenarios_are_stored_once(spark, sf):
    from fieldhub.fixtures import tables as T
    from fieldhub.plans import scenarios
    from fieldhub.session import drop_scratch

    done = scenarios.run(T.permit(spark, sf), [2, 3], capacity=None, max_rounds=3)
    assert done.stored()
    assert sorted((r["n_hubs"], r["count"]) for r in done.assignments.groupBy("n_hubs").count().collect())[0][1] == siting.project(
        T.permit(spark, sf)).count()
    assert sorted((r["n_hubs"], r["site_id"]) for r in done.sites.collect()) == [(2, 0), (2, 1), (3, 0), (3, 1), (3, 2)]
    drop_scratch(spark)
    assert not done.stored()


def test_empty_hub_keeps_place(spark):
    df = spark.createDataFrame([(1, 5, 0.0, 0.0, 0)], POINTS + ", assigned_site_idx int")
    hubs = [Hub(0, 3.0, 4.0), Hub(1, 9.0, 9.0)]
    assert siting.centroids(df, hubs) == [Hub(0, 0.0, 0.0), Hub(1, 9.0, 9.0)]


def test_running_load(spark):
    rows = make(200, 12)
    hubs = [Hub(k, r[2], r[3]) for k, r in enumerate(rows[:3])]
    got = {r["permit_id"]: (r["site_id"], r["load_before"]) for r in
           siting.running_load(spark.createDataFrame(rows, POINTS), hubs).collect()}
    load, want = [0] * 3, {}
    for pid, w, x, y in sorted(rows, key=lambda r: (-r[1], r[0])):
        k = min(range(3), key=lambda k: (math.dist((x, y), (hubs[k].x, hubs[k].y)), k))
        want[pid] = (k, load[k])
        load[k] += w
    assert got == want


@pytest.mark.parametrize("seed", [1, 2])
def test_p_median(spark, seed):
    rng = random.Random(seed)
    rows = make(150, seed, same=0.0)
    sites = [(j, rng.uniform(0, 1e5), rng.uniform(0, 1e5)) for j in range(70)]
    sources = spark.createDataFrame(rows, POINTS)
    cands = spark.createDataFrame(sites, "site_id bigint, x double, y double")
    at = {j: (x, y) for j, x, y in sites}
    cost = lambda chosen: sum(
        w * min(math.dist((x, y), at[j]) for j in chosen) for _, w, x, y in rows
    ) * siting.geo.METRES_PER_US_FOOT / 1000
    one = siting.p_median(sources, cands, 1)
    assert one.sites[0].site_id == min(at, key=lambda j: (cost([j]), j))
    assert one.objective == pytest.approx(cost([one.sites[0].site_id]))

    greedy: list[int] = []
    for _ in range(3):
        greedy.append(min((j for j in at if j not in greedy), key=lambda j: (cost([*greedy, j]), j)))
    got = siting.p_median(sources, cands, 3, swap=False)
    assert [s.site_id for s in got.sites] == sorted(greedy)
    swapped = siting.p_median(sources, cands, 2)
    best = min(cost(pair) for pair in itertools.combinations(at, 2))
    assert swapped.objective >= best - 1e-6
    chosen = [s.site_id for s in swapped.sites]
    assert swapped.objective == pytest.approx(cost(chosen))
    for old in chosen:  # no single swap improves
        rest = [j for j in chosen if j != old]
        assert all(cost([*rest, j]) >= swapped.objective - 1e-6 for j in at)


def test_too_many_hubs_is_refused(spark):
    sites = spark.range(siting.MAX_HUBS + 1).select(
        F.col("id").alias("site_id"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")
    )
    with pytest.raises(ValueError):
        siting.hubs_of(sites)


def test_siting_run_plan(spark, sf):
    from fieldhub.fixtures import tables as T

    done = siting_run.run(T.permit(spark, sf), "full-state", 4, capacity=None)
    hubs = done.hubs.collect()
    assert len(hubs) == 4
    total = done.assignments.agg(F.sum("headcount")).first()[0]
    assert sum(h["zone_animals"] for h in hubs) <= total
    assert done.assignments.filter("assigned_site_idx < 0").count() + sum(
        h["zone_afos"] for h in hubs
    ) == done.assignments.count()


def test_embeddings(spark):
    df = spark.createDataFrame(
        [(1, [1.0, 0.0], "a"), (2, [3.0, 0.0], "a"), (3, [0.0, 0.0], "b"), (4, None, "b"), (5, [1.0, 1.0], "b")],
        "id int, vector array<float>, kind string",
    )
    means = embeddings.mean_vectors(df, "kind", "vector")
    ref = embeddings.reference_vector(means, "kind", "a")
    assert ref == [2.0, 0.0] and embeddings.reference_vector(means, "kind", "zzz") is None
    got = {r["id"]: (round(r["ae_score"], 6), r["ae_is_afo"], r["ae_filtered"])
           for r in embeddings.classify(df, ref).collect()}
    assert got == {
        1: (1.0, True, False), 2: (1.0, True, False), 3: (0.0, False, True),
        4: (0.5, False, True), 5: (round(math.sqrt(0.5), 6), True, False),
    }
    bands = spark.createDataFrame([(0.5, 7.0)], "b0 double, embedding_1 double")
    assert bands.select(embeddings.from_bands(bands, 3)).first()[0] == [0.5, 7.0, 0.0]


@pytest.mark.parametrize("size", [8, 128])
def test_vectors_of_any_length(spark, size):
    rows = [("a", [float(i) for i in range(size)]), ("a", [float(i + 2) for i in range(size)]), ("b", None), ("b", [1.0]), ("b", [1.0, 2.0])]
    df = spark.createDataFrame(rows, "kind string, vector array<float>")
    means = embeddings.mean_vectors(df, "kind", "vector")
    assert {r["kind"]: r["mean"] for r in means.collect()} == {"a": [i + 1.0 for i in range(size)], "b": None}
    reference = embeddings.reference_vector(means, "kind", "a")
    same = df.filter("kind = 'a'").select(embeddings.cosine(F.col("vector"), reference).alias("c")).collect()
    assert all(r["c"] > 0.99 for r in same)
    with pytest.raises(Exception, match="numbers is needed"):
        df.filter("kind = 'b'").select(embeddings.cosine(F.col("vector"), reference)).collect()


def test_median_says_whether_swaps_came_to_an_end(spark):
    rows = make(40, 12)
    sources = spark.createDataFrame(rows, POINTS)
    sites = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows], "site_id bigint, x double, y double")
    assert not siting.p_median(sources, sites, 2, max_sweeps=0).converged
    assert siting.p_median(sources, sites, 2).converged


def test_an_addition_evaluates_few_of_many_candidates(spark, monkeypatch):
    """Also with several candidates on one spot, of which the lowest id counts."""
    import numpy as np

    draw = np.random.default_rng(4)
    demand = [(int(w), float(x), float(y)) for w, x, y in zip(
        draw.integers(1, 900, 2_000), draw.uniform(0, 1e5, 2_000), draw.uniform(0, 1e5, 2_000), strict=True)]
    spots = [(float(x), float(y)) for x, y in draw.uniform(0, 1e5, (60_000, 2))]
    sites = [(j, *spots[j % 60_000]) for j in range(60_100)]
    evaluated = []
    plain = siting._exact_totals
    monkeypatch.setattr(siting, "_exact_totals", lambda s, o, batch: evaluated.append(len(batch)) or plain(s, o, batch))
    got = siting.p_median(
        spark.createDataFrame(demand, "headcount int, x double, y double"),
        spark.createDataFrame(sites[::-1], "site_id bigint, x double, y double"), 2, unit="raw", swap=False)

    w, xy, at = np.array(demand)[:, 0], np.array(demand)[:, 1:], np.array(spots)
    now, want = np.full(len(w), np.inf), []
    for _ in range(2):
        cost = [float((w * np.minimum(now, np.hypot(*(xy - p).T))).sum()) for p in at]
        want.append(int(np.argmin(cost)))
        now = np.minimum(now, np.hypot(*(xy - at[want[-1]]).T))
    assert [s.site_id for s in got.sites] == sorted(want)
    assert got.objective == pytest.approx(min(cost) * siting.geo.distance_scale("raw"))
    assert sum(evaluated) <= 150, evaluated
