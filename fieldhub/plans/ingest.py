"""Registry download to permit layer."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fieldhub.operators import registry as R


def permit_layer(
    raw: DataFrame,
    id_column: str | None = None,
    geocodes: DataFrame | None = None,
    county: str | None = None,
    limit: int | None = None,
    active_only: bool = True,
    assume_standard: bool | None = None,
) -> DataFrame:
    """Clean, geocode the placeholder rows, filter; lazy from end to end."""
    permits = R.parse_permits(raw, id_column, assume_standard)
    if geocodes is not None:
        permits = R.apply_geocodes(permits, geocodes, only=R.is_placeholder()).drop("geocoded")
    if active_only:
        permits = R.active(permits)
    if county:
        permits = R.in_county(permits, county)
    if limit is not None:
        permits = R.first_rows(permits, limit, "permit_id" if id_column else "farm_name")
    return permits
