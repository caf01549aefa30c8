"""Siting runs for several numbers of hubs over one registry, and their stored assignments."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldhub import constants as K
from fieldhub.operators import registry, siting
from fieldhub.session import Scratch, small_table

ATTRIBUTES = ("farm_name", "animal_type", "county", "longitude", "latitude")


@dataclass(frozen=True)
class Scenarios:
    assignments: DataFrame  # (n_hubs, permit_id, attributes, headcount, assigned_site_idx, distance_to_hub_km)
    sites: DataFrame  # (n_hubs, site_id, x, y)
    runs: dict[int, siting.SitingRun]
    scratch: Scratch

    def stored(self) -> bool:
        """Whether the assignments have not been dropped yet."""
        return self.scratch.stored()


def run(
    permits: DataFrame, sizes: Sequence[int], capacity: float | None = K.HUB_CAPACITY, unit: str = "km",
    max_rounds: int = K.MAX_SITING_ROUNDS,
) -> Scenarios:
    """One batch of siting runs: the same facilities and room per hub, ``sizes`` numbers of hubs.

    The assignments are written once and read by whatever compares scenarios.  A facility
    that no hub has room for has the hub -1 and no distance.  ``capacity=None`` sizes the hubs
    of each scenario from the total headcount.
    """
    located = registry.located(permits)
    many = siting.refine_many(siting.project(located), sizes, capacity, unit, max_rounds)
    scratch = Scratch(permits.sparkSession, "scenarios")
    attributes = located.select("permit_id", *ATTRIBUTES)
    assigned = many.table.select(
        F.col("run").alias("n_hubs"), "permit_id", "headcount", "assigned_site_idx", "distance_to_hub_km")
    hubs = [(p, h.site_id, float(h.x), float(h.y)) for p, done in many.runs.items() for h in done.hubs]
    return Scenarios(
        scratch.cut(assigned.join(attributes, "permit_id")),
        small_table(permits.sparkSession, hubs, {"n_hubs": "int", "site_id": "int", "x": "double", "y": "double"}),
        many.runs, scratch,
    )
