"""Permits to hubs: the whole siting run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldhub import constants as K
from fieldhub.operators import economics, profiles, registry, siting


@dataclass
class SitingResult:
    hubs: DataFrame
    assignments: DataFrame
    totals: DataFrame
    rounds: int
    converged: bool


def run(
    permits: DataFrame,
    region: str = "eastern-shore",
    hubs: int = 10,
    capacity: float | None = K.HUB_CAPACITY,
    unit: str = "km",
) -> SitingResult:
    """Filter, locate, assign, refine, snap, cost.

    ``capacity=None`` sizes hubs from the total headcount.
    """
    chosen = registry.located(registry.in_region(permits, region))
    done = siting.refine_hubs(siting.project(chosen), hubs, capacity, unit)
    attrs = chosen.select(
        "permit_id", F.trim("farm_name").alias("farm_name"), "county", "longitude", "latitude"
    )
    snapped = siting.snap_hubs(done.assigned, done.hubs)
    # one row per hub, hence the broadcast
    table = profiles.zone_totals(done.assigned, attrs.join(F.broadcast(snapped), "permit_id"))
    return SitingResult(
        hubs=table,
        assignments=done.assigned.join(attrs, "permit_id"),
        totals=economics.siting_economics(done.assigned, hubs),
        rounds=done.rounds,
        converged=done.converged,
    )
