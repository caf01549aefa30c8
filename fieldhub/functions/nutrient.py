"""Column functions for nutrient supply and size classes."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldhub import constants as K


def _per_head(position: int) -> dict[str, Decimal]:
    """Pounds per head and year including flocks, in exact decimals."""
    return {
        animal: Decimal(c[position]) * Decimal(c[2])
        for animal, c in K.NUTRIENT_COEFFICIENTS.items()
    }


def _supply(animal: Column, headcount: Column, position: int) -> Column:
    rates = F.create_map(*[
        F.lit(x) if isinstance(x, str) else F.lit(x).cast("decimal(12,4)")
        for kv in _per_head(position).items()
        for x in kv
    ])
    pounds = headcount.cast("decimal(18,0)") * F.try_element_at(rates, animal)
    rounded = F.bround(pounds, 1).cast("double")
    return F.when(headcount > 0, F.coalesce(rounded, F.lit(0.0))).otherwise(F.lit(0.0))


def nitrogen_lbs(animal: Column, headcount: Column) -> Column:
    """Annual N for a canonical animal type; 0 without coefficient or headcount."""
    return _supply(animal, headcount, 0)


def phosphate_lbs(animal: Column, headcount: Column) -> Column:
    return _supply(animal, headcount, 1)


def acres(m2: Column) -> Column:
    return m2 / F.lit(K.SQ_M_PER_ACRE)


def square_metres(ac: Column) -> Column:
    return ac * F.lit(K.SQ_M_PER_ACRE)


def size_label(headcount: Column) -> Column:
    """Right-closed size classes; a headcount of 0 (or null) is in none of them."""
    out = F.when(headcount > K.SIZE_EDGES[-1], K.SIZE_LABELS[-1])
    for low, label in reversed(list(zip(K.SIZE_EDGES[:-1], K.SIZE_LABELS[:-1]))):
        out = out.when(headcount > low, label)
    return out


def marker_radius(headcount: Column) -> Column:
    return (
        F.when(headcount == 0, 2)
        .when(headcount < 10_000, 3)
        .when(headcount < 100_000, 5)
        .when(headcount < 1_000_000, 8)
        .otherwise(12)
    )


def simple_radius(headcount: Column) -> Column:
    return F.when(headcount < 100_000, 5).otherwise(8)


def hub_colour(site: Column) -> Column:
    n = len(K.HUB_COLOURS)
    return F.get(F.array(*[F.lit(c) for c in K.HUB_COLOURS]), F.pmod(site, F.lit(n)).cast("int"))
