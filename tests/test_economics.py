"""Published result values from their aggregate inputs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fieldhub.operators import economics as E

# fixed values: facilities, animals and yearly transport cost of the published scenarios
FACILITIES, ANIMALS = 334, 41_180_619
TRANSPORT = {8: 8_659_650.306368943, 10: 6_032_374.144674218, 15: 4_732_682.928927628}
MAX_CAPACITY = {8: 99.9908, 10: 99.65, 15: 88.844}
ROUNDED_KM = {8: 40.44, 10: 28.17, 15: 22.10}


@pytest.fixture
def base(spark):
    rows = [
        (n, FACILITIES, ANIMALS, cost / 52 / 2.5 * 25_000, n) for n, cost in TRANSPORT.items()
    ]
    return spark.createDataFrame(
        rows, "n_hubs int, afos_served bigint, animals bigint, effort double, hubs bigint"
    )


def by_hubs(df):
    return {r["n_hubs"]: r for r in df.collect()}


def test_costs(base):
    got = by_hubs(E.economics(base))
    assert got[10]["total_5yr_cost"] == pytest.approx(50_161_870.72337109)
    assert got[10]["avg_distance_km"] == pytest.approx(28.17033786934791)
    assert got[8]["cost_per_animal_per_year"] == pytest.approx(0.21028460758127368)
    assert got[15]["truckloads_per_year"] == pytest.approx(85_655.68752)


def test_cash_flow(base):
    got = by_hubs(E.cash_flow(base))
    want = {8: (132_539_953.08396676, 0.5385756379953718), 10: (141_676_333.89244038, 0.6185197152387667),
            15: (138_174_789.97117335, 0.8919291650413914)}
    for n, (npv, years) in want.items():
        assert got[n]["npv_5yr"] == pytest.approx(npv)
        assert got[n]["payback_years"] == pytest.approx(years)
        assert got[n]["total_annual_revenue"] == pytest.approx(38_367_640.9231623)
    discounted = by_hubs(E.cash_flow(base, 0.05))
    assert discounted[10]["npv_5yr"] == pytest.approx(120.0e6, rel=2e-3)


def test_no_profit_never_pays_back(spark):
    poor = spark.createDataFrame(
        [(1, 1, 10, 1e12, 1)], "n_hubs int, afos_served bigint, animals bigint, effort double, hubs bigint"
    )
    assert E.cash_flow(poor).first()["payback_years"] == float("inf")


def test_grids(base):
    ten = base.filter("n_hubs = 10")
    rates = {r["transport_cost_per_km"]: r for r in E.transport_grid(ten).collect()}
    assert rates[1.5]["total_5yr_cost"] == pytest.approx(38_097_122.43402265) and len(rates) == 6
    costs = {r["construction_cost_per_hub"]: r for r in E.construction_grid(ten).collect()}
    assert costs[2_500_000]["total_5yr_cost"] == pytest.approx(55_161_870.72337109) and len(costs) == 4
    grid = E.revenue_grid(ten)
    cells = {(r["energy_price_per_kwh"], r["digestate_price_per_ton"]): r["total_annual_revenue"]
             for r in grid.collect()}
    assert len(cells) == 20
    assert cells[0.08, 10] == pytest.approx(25_578_427.282108195)
    assert cells[0.12, 15] == pytest.approx(38_367_640.9231623)
    summary = E.revenue_summary(grid).first()
    assert summary["low"] == pytest.approx(25.58e6, rel=1e-3)
    assert summary["high"] == pytest.approx(60.76e6, rel=1e-3)


def test_scores(spark):
    rows = [
        (n, FACILITIES, ANIMALS / 1e6, n * 2.0, TRANSPORT[n] / 1e6, TRANSPORT[n] / 1e6 * 5 + n * 2.0,
         0.1, ROUNDED_KM[n], MAX_CAPACITY[n], 0.0, 100.0)
        for n in TRANSPORT
    ]
    table = spark.createDataFrame(
        rows,
        "n_hubs int, afos_served bigint, animals_m double, construction_m double, annual_transport_m double, "
        "total_5yr_m double, cost_per_animal_per_year double, avg_distance_km double, "
        "max_capacity_pct double, min_capacity_pct double, coverage_pct double",
    )
    scored = E.score(table)
    got = by_hubs(scored)
    assert got[8]["score"] == pytest.approx(2.000092, abs=1e-6)
    assert got[10]["score"] == pytest.approx(1.5460125, abs=1e-6)
    assert got[15]["score"] == pytest.approx(1.5630233, abs=1e-6)
    best = E.best(scored).first()
    assert (best["lowest_cost"], best["lowest_transport"], best["shortest_distance"], best["recommended"]) == (
        10, 15, 15, 10)
    lines = [r["line"] for r in E.recommendation(scored).orderBy("ord").collect()]
    assert lines[0] == "OPTIMAL SOLUTION: 10 regional hubs" and lines[5] == "5-year total: $50.2M"
    assert lines[8:12] == [
        "Hub capacity range: 0%-100%", "Facilities with a hub: 100.0%", "Budget-constrained: 8 hubs ($16M construction)",
        f"Distance-optimized: 15 hubs ({ROUNDED_KM[15]:.1f} km avg)"]
    assert lines[-2:] == ["8 hubs: at least one hub at 100% capacity", "10 hubs: at least one hub at 100% capacity"]


def test_siting_economics_without_animals(spark):
    none = spark.createDataFrame([], "headcount bigint, distance_to_hub_km double")
    row = E.siting_economics(none.withColumn("x", F.lit(1)), 3).first()
    assert row["avg_distance_km"] in (0.0, None) and row["cost_per_animal_per_year"] is None
    assert row["total_construction_cost"] == 6_000_000
