"""Named queries over the driver tables, grouped by area."""

from __future__ import annotations

from importlib import import_module

from fieldhub.catalog.registry import CATALOG, Entry

_AREAS = ["ingest", "geometry", "spatial", "siting", "reports", "economics", "planned", "environment", "parsing"]


def all_entries() -> dict[str, Entry]:
    for area in _AREAS:
        import_module(f"fieldhub.catalog.{area}")
    return CATALOG
