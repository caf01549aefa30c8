"""Transport, construction, revenue, NPV, scenario scores and run comparison."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldhub import constants as K
from fieldhub.functions.text import fixed


def _d(value: float) -> Column:
    return F.lit(float(value))


# --- building blocks -------------------------------------------------------------
def effort() -> Column:
    """Animal-kilometres of the assigned rows."""
    return F.sum(F.col("headcount") * F.col("distance_to_hub_km"))


def transport_cost(animal_km: Column, rate: Column) -> Column:
    """Yearly transport cost of an effort in animal-kilometres."""
    return animal_km / _d(K.ANIMALS_PER_TRUCKLOAD) * _d(K.TRIPS_PER_YEAR) * rate


def scenario_base(assignments: DataFrame, sites: DataFrame) -> DataFrame:
    """Per scenario: hubs, facilities (all, and those with a hub), animals, effort.

    One aggregation per input, joined on ``n_hubs`` (one row per scenario).
    """
    loads = assignments.groupBy("n_hubs").agg(
        F.count(F.lit(1)).alias("afos_served"),
        F.count_if(F.col("assigned_site_idx") >= 0).alias("with_hub"),
        F.sum("headcount").alias("animals"),
        effort().alias("effort"),
    )
    hubs = sites.groupBy("n_hubs").agg(F.count(F.lit(1)).alias("hubs"))
    return loads.join(hubs, "n_hubs")


def economics(
    base: DataFrame, rate: Column | None = None, hub_cost: Column | None = None
) -> DataFrame:
    """Costs per row of ``scenario_base`` (or of a grid built on it)."""
    rate = _d(K.COST_PER_KM) if rate is None else rate
    hub_cost = _d(K.HUB_COST) if hub_cost is None else hub_cost
    per = lambda x: x / F.nullif(F.col("animals"), F.lit(0))
    return (
        base.withColumns({
            "construction_cost": F.col("hubs") * hub_cost,
            "annual_transport_cost": transport_cost(F.col("effort"), rate),
            "avg_distance_km": per(F.col("effort")),
            "truckloads_per_year": F.col("animals") / _d(K.ANIMALS_PER_TRUCKLOAD)
            * _d(K.TRIPS_PER_YEAR),
        })
        .withColumns({
            "total_5yr_cost": F.col("construction_cost")
            + F.col("annual_transport_cost") * _d(K.HORIZON_YEARS),
            "cost_per_animal_per_year": per(F.col("annual_transport_cost")),
        })
    )


def siting_economics(assigned: DataFrame, hubs: int) -> DataFrame:
    """Costs of a siting run; unassigned facilities count in the animals but not the effort.

    ``effort_trips_per_year`` is the effort-based trip count of the run report, which is not
    the same figure as ``truckloads_per_year`` of a scenario.
    """
    animals, km = F.col("animals"), F.col("effort")
    cost = transport_cost(km, _d(K.COST_PER_KM))
    return assigned.agg(
        F.sum("headcount").alias("animals"), F.coalesce(effort(), _d(0)).alias("effort")
    ).select(
        cost.alias("annual_transport_cost"),
        _d(hubs * K.HUB_COST).alias("total_construction_cost"),
        (cost * _d(K.HORIZON_YEARS) + _d(hubs * K.HUB_COST)).alias("total_cost_5yr"),
        (cost / F.nullif(animals, F.lit(0))).alias("cost_per_animal_per_year"),
        (km / _d(K.ANIMALS_PER_TRUCKLOAD) * _d(K.TRIPS_PER_YEAR)).alias("effort_trips_per_year"),
        F.when(animals > 0, km / animals).otherwise(_d(0)).alias("avg_distance_km"),
    )


def revenue(df: DataFrame, energy: Column, digestate: Column) -> DataFrame:
    """Yearly biogas and digestate revenue of ``animals``."""
    kg = F.col("animals") * _d(K.MANURE_KG_PER_DAY) * _d(K.DAYS_PER_YEAR)
    return (
        df.withColumn("_kg", kg)
        .withColumns({
            "annual_manure_tons": F.col("_kg") / _d(1000),
            "annual_biogas_m3": F.col("_kg") * _d(K.VOLATILE_SOLIDS) * _d(K.BIOGAS_M3_PER_KG),
        })
        .withColumns({
            "annual_kwh": F.col("annual_biogas_m3") * _d(K.KWH_PER_M3) * _d(K.ELECTRIC_EFFICIENCY),
            "annual_digestate_tons": F.col("annual_manure_tons") * _d(K.DIGESTATE_FRACTION),
        })
        .withColumns({
            "annual_energy_revenue": F.col("annual_kwh") * energy,
            "annual_digestate_revenue": F.col("annual_digestate_tons") * digestate,
        })
        .withColumn(
            "total_annual_revenue",
            F.col("annual_energy_revenue") + F.col("annual_digestate_revenue"),
        )
        .withColumn(
            "revenue_per_animal_per_year",
            F.col("total_annual_revenue") / F.nullif(F.col("animals"), F.lit(0)),
        )
        .drop("_kg")
    )


def base_revenue(df: DataFrame) -> DataFrame:
    return revenue(df, _d(K.BASE_ENERGY_PRICE), _d(K.BASE_DIGESTATE_PRICE))


# --- grids ---------------------------------------------------------------------------
def _grid(df: DataFrame, name: str, values: Iterable[float]) -> DataFrame:
    """Every row once per parameter value: an explode of a literal array, not a join."""
    return df.withColumn(name, F.explode(F.array(*[_d(v) for v in values])))


def transport_grid(base: DataFrame, rates: Iterable[float] = K.TRANSPORT_RATES) -> DataFrame:
    grid = _grid(base, "transport_cost_per_km", rates)
    return economics(grid, rate=F.col("transport_cost_per_km"))


def construction_grid(base: DataFrame, costs: Iterable[float] = K.CONSTRUCTION_COSTS) -> DataFrame:
    grid = _grid(base, "construction_cost_per_hub", costs)
    return economics(grid, hub_cost=F.col("construction_cost_per_hub"))


def revenue_grid(
    base: DataFrame,
    energy: Iterable[float] = K.ENERGY_PRICES,
    digestate: Iterable[float] = K.DIGESTATE_PRICES,
) -> DataFrame:
    grid = _grid(_grid(base, "energy_price_per_kwh", energy), "digestate_price_per_ton", digestate)
    return revenue(grid, F.col("energy_price_per_kwh"), F.col("digestate_price_per_ton"))


def revenue_summary(grid: DataFrame) -> DataFrame:
    r = F.col("total_annual_revenue")
    return grid.groupBy("n_hubs").agg(
        F.min(r).alias("low"), F.percentile(r, 0.5).alias("mid"), F.max(r).alias("high")
    )


# --- cash flow ---------------------------------------------------------------------------
def cash_flow(base: DataFrame, discount_rate: float = 0.0) -> DataFrame:
    """Costs, revenue, net flow, NPV over the horizon and payback (infinite without profit)."""
    both = base_revenue(economics(base)).withColumn(
        "annual_net_cash_flow", F.col("total_annual_revenue") - F.col("annual_transport_cost")
    )
    net, built = F.col("annual_net_cash_flow"), F.col("construction_cost")
    if discount_rate == 0:
        present = net * _d(K.HORIZON_YEARS)
    else:
        present = F.aggregate(
            F.sequence(F.lit(1), F.lit(K.HORIZON_YEARS)),
            _d(0),
            lambda acc, year: acc + net / F.pow(_d(1 + discount_rate), year),
        )
    return both.withColumns({
        "npv_5yr": present - built,
        "payback_years": F.when(net > 0, built / net).otherwise(_d(float("inf"))),
    })


# --- scenarios ---------------------------------------------------------------------------
def comparison(base: DataFrame, zones: DataFrame, capacity: float = K.HUB_CAPACITY) -> DataFrame:
    """One row per scenario with its costs in millions and hub capacity range in percent.

    ``zones`` has (n_hubs, zone_animals), one row per hub.
    """
    used = F.col("zone_animals") / _d(capacity) * 100
    caps = zones.groupBy("n_hubs").agg(
        F.max(used).alias("max_capacity_pct"), F.min(used).alias("min_capacity_pct")
    )
    m = lambda c: F.col(c) / 1_000_000
    return economics(base).join(caps, "n_hubs").select(
        "n_hubs",
        "afos_served",
        m("animals").alias("animals_m"),
        m("construction_cost").alias("construction_m"),
        m("annual_transport_cost").alias("annual_transport_m"),
        m("total_5yr_cost").alias("total_5yr_m"),
        "cost_per_animal_per_year",
        "avg_distance_km",
        "max_capacity_pct",
        "min_capacity_pct",
        (F.col("with_hub") * 100.0 / F.nullif(F.col("afos_served"), F.lit(0))).alias("coverage_pct"),
    )


def score(scenarios: DataFrame) -> DataFrame:
    """Add ``score`` (lower is better): cost and distance against the worst scenario, plus
    the headroom of the fullest hub (a fuller hub scores better)."""
    top = scenarios.agg(
        F.struct(F.max("total_5yr_m").alias("cost"), F.max("avg_distance_km").alias("km"))
    ).scalar()
    return scenarios.withColumn("_top", top).withColumn(
        "score",
        F.col("total_5yr_m") / F.nullif(F.col("_top.cost"), _d(0))
        + F.abs(F.lit(100.0) - F.col("max_capacity_pct")) / 100
        + F.col("avg_distance_km") / F.nullif(F.col("_top.km"), _d(0)),
    ).drop("_top")


def best(scored: DataFrame) -> DataFrame:
    """The winning hub count per criterion; the smaller hub count wins ties (to 9 decimals,
    so the order in which sums were added cannot decide)."""
    win = lambda c: F.min(F.struct(F.round(c, 9).alias("v"), F.col("n_hubs")))["n_hubs"]
    return scored.agg(
        win("total_5yr_m").alias("lowest_cost"),
        win("annual_transport_m").alias("lowest_transport"),
        win("avg_distance_km").alias("shortest_distance"),
        win("score").alias("recommended"),
    )


def recommendation(scored: DataFrame, full_pct: float = 99.0) -> DataFrame:
    """Report lines: the recommended scenario's figures, the cheapest and the nearest alternative,
    then over-capacity warnings."""
    rank = F.row_number().over(Window.orderBy(F.round("score", 9), "n_hubs"))  # one row per scenario
    top = scored.withColumn("_rank", rank).filter("_rank = 1")
    line = lambda ord_, fmt, *c: F.struct(F.lit(ord_).alias("ord"), F.format_string(fmt, *c).alias("line"))
    lines = F.array(
        line(1, "OPTIMAL SOLUTION: %d regional hubs", F.col("n_hubs")),
        line(2, "Facilities served: %d", F.col("afos_served")),
        line(3, "Animals processed: %sM", fixed(F.col("animals_m"), 1)),
        line(4, "Construction cost: $%sM", fixed(F.col("construction_m"), 1)),
        line(5, "Annual transport: $%sM", fixed(F.col("annual_transport_m"), 1)),
        line(6, "5-year total: $%sM", fixed(F.col("total_5yr_m"), 1)),
        line(7, "Average distance: %s km", fixed(F.col("avg_distance_km"), 1)),
        line(8, "Cost per animal: $%s/year", fixed(F.col("cost_per_animal_per_year"), 2)),
        line(9, "Hub capacity range: %s%%-%s%%", fixed(F.col("min_capacity_pct"), 0), fixed(F.col("max_capacity_pct"), 0)),
        line(10, "Facilities with a hub: %s%%", fixed(F.col("coverage_pct"), 1)),
    )
    chosen = top.select(F.explode(lines).alias("l")).select("l.ord", "l.line")
    warnings = scored.filter(F.col("max_capacity_pct") >= full_pct).select(
        (F.lit(100) + F.col("n_hubs")).cast("int").alias("ord"),
        F.format_string(
            "%d hubs: at least one hub at %s%% capacity", F.col("n_hubs"),
            fixed(F.col("max_capacity_pct"), 0),
        ).alias("line"),
    )
    first = lambda *order: F.min_by(F.struct("n_hubs", "construction_m", "avg_distance_km"), F.struct(*order))
    others = scored.agg(
        first("construction_m", "n_hubs").alias("cheap"), first(F.round("avg_distance_km", 9), "n_hubs").alias("near"))
    alternatives = others.filter("cheap is not null").select(F.explode(F.array(
        line(11, "Budget-constrained: %d hubs ($%sM construction)", F.col("cheap.n_hubs"), fixed(F.col("cheap.construction_m"), 0)),
        line(12, "Distance-optimized: %d hubs (%s km avg)", F.col("near.n_hubs"), fixed(F.col("near.avg_distance_km"), 1)),
    )).alias("l")).select("l.ord", "l.line")
    return chosen.unionByName(alternatives).unionByName(warnings)


# --- run comparison ------------------------------------------------------------------------
METRICS = ["AFOs", "Animals", "Hubs", "Counties", "Avg Animals/Hub", "Coverage %"]


def run_metrics(assignments: DataFrame, hubs: Column, total_facilities: Column) -> DataFrame:
    """The six comparison metrics of a run as (metric, value) rows."""
    one = assignments.agg(
        F.count(F.lit(1)).cast("double").alias("AFOs"),
        F.sum("headcount").cast("double").alias("Animals"),
        F.countDistinct("county").cast("double").alias("Counties"),
    ).withColumns({"Hubs": hubs.cast("double"), "_total": total_facilities.cast("double")})
    one = one.withColumns({
        "Avg Animals/Hub": F.col("Animals") / F.col("Hubs"),
        "Coverage %": F.col("AFOs") / F.col("_total") * 100,
    })
    return one.unpivot([], METRICS, "metric", "value")


def compare_runs(baseline: DataFrame, updated: DataFrame) -> DataFrame:
    """Metrics of two runs side by side with change and change percent."""
    b = baseline.withColumnRenamed("value", "baseline")
    u = updated.withColumnRenamed("value", "updated")
    change = F.col("updated") - F.col("baseline")
    return b.join(u, "metric", "full").withColumns({
        "change": change,
        "change_pct": F.bround(change / F.nullif(F.col("baseline"), _d(0)) * 100, 1),
    })
