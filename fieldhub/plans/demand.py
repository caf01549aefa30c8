"""Crop raster and setbacks to the demand map."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fieldhub.operators import raster
from fieldhub.sources import writers


def build(
    pixels: DataFrame,
    setbacks: DataFrame | None,
    rows: int,
    cols: int,
    output: str | None = None,
) -> DataFrame:
    """Demand pixels with demand 0 inside setbacks; written per tile when asked."""
    out = raster.demand_map(pixels, setbacks, rows, cols)
    if output:
        writers.demand(out, output)
    return out
