"""A certificate for p-median solutions: a lower bound by Lagrangian relaxation.

Every source pays a price for being served; a site is worth what its sources save against
their prices, and the p sites worth most give a bound below every solution.  Prices move
by subgradient steps towards the sources that are served too rarely or too often.  A price follows
from the source's own place, the sites chosen so far and the steps taken, so it is worked out where
it is needed: nothing is stored between rounds, and a round is two passes over the sources that
return one number per site and a few sums.  No table of sources by sites exists.

Only the p sites worth most count.  Many candidates are therefore cut in cells.  A pass gives each cell a plane
that no site of it is worth more than: what a site saves of one source follows from their distance, which is convex,
and a saving that ends somewhere in the cell lies above its chord.  So the error shrinks with the square of a cell's size.
Sites that may still be among the best are cut in finer cells, and what is then left is worked out over all sources.
Sources on one spot are one source.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldhub.functions import geo
from fieldhub.operators.siting import Hub, Median, p_median
from fieldhub.session import Scratch

MAX_SITES = 65_536  # candidates whose places go along with the tasks
CELLS = 1 << 16  # distances that a task holds at once, few enough for a core's cache
AT_ONCE = 2_048  # sites worked out in a pass; up to so many candidates need no cells
FIRST = 64  # sites of the best planes, worked out before finer cells
SIDES = (32, 128, 512)  # cells of candidates along a side


@dataclass(frozen=True)
class Bound:
    lower: float
    upper: float  # of the best solution seen
    sites: list[Hub]
    rounds: int
    trail: list[float] = field(default_factory=list)  # the bound of each round

    @property
    def gap(self) -> float:
        """How far the solution may be from the best one, as a part of its value."""
        return 0.0 if self.upper <= 0 else max(0.0, self.upper - self.lower) / self.upper


@dataclass(frozen=True)
class _Prices:
    """What prices follow from: the sites they start at, and (sites, step) of the rounds."""

    first: np.ndarray
    moves: list[tuple[np.ndarray, float]]

    def of(self, xy: np.ndarray, weight: np.ndarray) -> np.ndarray:
        near = np.sort(_costs(xy, weight, self.first), axis=1)
        price = near[:, 0] * 1.5 if near.shape[1] == 1 else (near[:, 0] + near[:, 1]) / 2
        for sites, step in self.moves:
            served = (_costs(xy, weight, sites) < price[:, None]).sum(axis=1)
            price = price + step * (1 - served)
        return price


def _costs(xy: np.ndarray, weight: np.ndarray, sites: np.ndarray) -> np.ndarray:
    dx, dy = xy[:, :1] - sites[:, 0], xy[:, 1:] - sites[:, 1]
    return weight[:, None] * np.sqrt(dx * dx + dy * dy)


def _batches(batches: Iterator[pa.RecordBatch], wide: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, weights), so many rows at once that ``wide`` numbers a row fit."""
    step = max(1, CELLS // max(1, wide))
    for batch in batches:
        weight, x, y = (c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns)
        xy = np.column_stack((x, y))
        for at in range(0, len(weight), step):
            yield xy[at : at + step], weight[at : at + step]


def _worth(prices: _Prices, sites: np.ndarray) -> Callable:
    """Per site what its sources save; at -1 the sum of all prices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        saved, total = np.zeros(len(sites)), 0.0
        for xy, weight in _batches(batches, len(sites)):
            price = prices.of(xy, weight)
            total += price.sum()
            saved += np.minimum(_costs(xy, weight, sites) - price[:, None], 0).sum(axis=0)
        found = np.append(np.flatnonzero(saved), -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found.astype(np.int32)), pa.array(np.append(saved[found[:-1]], total))], ["at", "worth"])

    return run


def _planes(prices: _Prices, centres: np.ndarray, half: np.ndarray) -> Callable:
    """Per disc of sites (centre and radius) a plane under what its sites are worth: at the centre, and
    its slopes; at -1 the sum of all prices.  A disc of radius 0 gets the worth itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ones, across, along, total = np.zeros(len(half)), np.zeros(len(half)), np.zeros(len(half)), np.zeros(len(half)), 0.0
        for xy, weight in _batches(batches, len(half)):
            price = prices.of(xy, weight)
            total += price.sum()
            dx, dy = xy[:, :1] - centres[:, 0], xy[:, 1:] - centres[:, 1]
            far = np.sqrt(dx * dx + dy * dy)
            net = weight[:, None] * far - price[:, None]  # at the centre; in the disc it is within ``reach`` of that
            reach = weight[:, None] * half
            most = np.maximum(net + reach, 0)
            part = np.clip((reach - net) / np.maximum(2 * reach, 1e-9), 0, 1)  # the chord's slope
            part[net + reach <= 0] = 1
            at += (part * (net - most)).sum(axis=0)
            part *= weight[:, None] / np.maximum(far, 1e-9)
            across -= (part * dx).sum(axis=0)
            along -= (part * dy).sum(axis=0)
        rows = [np.append(np.arange(len(half)), -1).astype(np.int32), np.append(at, total), np.append(across, 0), np.append(along, 0)]
        yield pa.RecordBatch.from_arrays([pa.array(r) for r in rows], ["at", "worth", "across", "along"])

    return run


def _cells(sites: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each site's cell, and the cells' centres and radii."""
    low = sites.min(axis=0)
    size = max((sites.max(axis=0) - low).max(), 1e-9) / (side - 1)
    at = np.floor((sites - low) / size).astype(int)
    _, cell = np.unique(at[:, 0] * side + at[:, 1], return_inverse=True)
    ends = np.full((2, cell.max() + 1, 2), np.inf)
    np.minimum.at(ends[0], cell, sites)
    np.minimum.at(ends[1], cell, -sites)
    centres = (ends[0] - ends[1]) / 2
    half = np.zeros(len(centres))
    np.maximum.at(half, cell, np.hypot(*(sites - centres[cell]).T))
    return cell, centres, half * (1 + 1e-9)


def _sums(places: DataFrame, run: Callable) -> DataFrame:
    return places.mapInArrow(run, "at int, worth double").groupBy("at").agg(F.sum("worth").alias("worth"))


def _under(places: DataFrame, prices: _Prices, sites: np.ndarray, known: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray, float]:
    """What each site is worth at most (by its cell's plane), what the sites known are worth, and the sum of all prices."""
    cell, centres, half = _cells(sites, side)
    given = np.vstack((centres, known)), np.append(half, np.zeros(len(known)))
    sums = places.mapInArrow(_planes(prices, *given), "at int, worth double, across double, along double").groupBy("at").agg(
        *(F.sum(c).alias(c) for c in ("worth", "across", "along")))
    planes = np.zeros((len(half) + len(known) + 1, 3))  # the last row is that of -1
    for r in sums.collect():  # cells, p sites and the total
        planes[r["at"]] = r["worth"], r["across"], r["along"]
    off = sites - centres[cell]
    return planes[cell, 0] + (planes[cell, 1:] * off).sum(axis=1), planes[len(half) : -1, 0], float(planes[-1, 0])


def _most_worth(
    places: DataFrame, prices: _Prices, sites: np.ndarray, p: int, known: Sequence[int],
) -> tuple[float, list[tuple[float, int]]]:
    """The sum of all prices, and the p sites worth most: (worth, number), sites of no worth left out."""
    if len(sites) <= AT_ONCE:
        rows = _sums(places, _worth(prices, sites)).orderBy(F.col("at") >= 0, "worth", "at").limit(p + 1).collect()
        return sum(r["worth"] for r in rows if r["at"] < 0), [(r["worth"], r["at"]) for r in rows if r["at"] >= 0]
    # the sites of the last round go along as discs of one point: at least p sites are worth as much
    under, now, total = _under(places, prices, sites, sites[list(known)], SIDES[0])
    least = now.max() * (1 - 1e-9)
    left = np.arange(len(sites))
    best: list[tuple[float, int]] = []

    def possible() -> None:
        nonlocal left, under
        kept = (under < 0) & (under * (1 + 1e-9) <= least)
        left, under = left[kept], under[kept]

    def work_out(many: int) -> None:
        """The sites of the best planes over all sources."""
        nonlocal left, under, best, least
        order = np.argsort(under, kind="stable")
        ids, rest = np.sort(left[order[:many]]), np.sort(order[many:])
        rows = _sums(places, _worth(prices, sites[ids])).filter("at >= 0").orderBy("worth", "at").limit(p).collect()
        best = sorted(best + [(r["worth"], int(ids[r["at"]])) for r in rows])[:p]
        if len(best) == p:
            least = min(least, best[-1][0])
        left, under = left[rest], under[rest]
        possible()

    possible()
    for side in SIDES[1:]:
        if len(left) <= 2 * FIRST:
            break
        work_out(FIRST)
        if len(left) <= 2 * FIRST:
            break
        finer, _, _ = _under(places, prices, sites[left], sites[:0], side)
        under = np.maximum(under, finer)
        possible()
    while len(left):
        work_out(AT_ONCE)
    return total, best


def _served(prices: _Prices, chosen: np.ndarray) -> Callable:
    """Sums over the sources: squared misses, and the cost of the chosen sites."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        missed = cost = 0.0
        for xy, weight in _batches(batches, len(chosen)):
            costs = _costs(xy, weight, chosen)
            times = (costs < prices.of(xy, weight)[:, None]).sum(axis=1)
            missed += float(((1 - times) ** 2).sum())
            cost += costs.min(axis=1).sum()
        yield pa.RecordBatch.from_arrays([pa.array([missed]), pa.array([cost])], ["missed", "cost"])

    return run


def median_bound(
    sources: DataFrame, candidates: DataFrame, p: int, unit: str = "km", start: Median | None = None,
    rounds: int = 60, tolerance: float = 1e-4,
) -> Bound:
    """Bounds of the best Σ headcount·distance over p of the candidates.

    ``start`` is a known solution (greedy additions and swaps if not given); better ones met on the way are kept.
    The lower bound holds after any number of rounds; they end early once the gap is at most ``tolerance``.  Sources and
    candidates without a place are left out, negative headcounts count as 0.
    """
    scale = geo.distance_scale(unit)
    known = start or p_median(sources, candidates, p, unit)
    rows = candidates.select("site_id", "x", "y").dropna().limit(MAX_SITES + 1).collect()
    if len(rows) > MAX_SITES:
        raise ValueError(f"more than {MAX_SITES} candidates")
    hubs = [Hub(r[0], r[1], r[2]) for r in sorted(rows)]
    if p > len(hubs):
        raise ValueError(f"{p} sites of {len(hubs)} candidates")
    sites = np.array([(h.x, h.y) for h in hubs], dtype=float).reshape(-1, 2)
    places = Scratch(sources.sparkSession, "bound").cut(
        sources.filter("headcount > 0").select(F.col("headcount").cast("double").alias("w"), "x", "y").dropna()
        .groupBy("x", "y").agg(F.sum("w").alias("w")).select("w", "x", "y")
        .repartition(sources.sparkSession.sparkContext.defaultParallelism))  # a file of one split would be one task
    best, upper, lower = known.sites, known.objective / scale, 0.0
    numbers = {h.site_id: k for k, h in enumerate(hubs)}
    picked = [numbers[h.site_id] for h in best if h.site_id in numbers] if len(best) == p else list(range(p))
    picked = picked if len(picked) == p else list(range(p))
    prices, trail, pace, idle = _Prices(_xy(best), []), [], 1.0, 0
    for _ in range(rounds):
        total, worth = _most_worth(places, prices, sites, p, picked)
        picked = [k for _, k in worth]
        picked += [k for k in range(len(sites)) if k not in set(picked)][: p - len(picked)]  # of no worth
        value = total + sum(w for w, _ in worth)
        trail.append(value * scale)
        idle = 0 if value > lower * (1 + 1e-6) else idle + 1
        lower = max(lower, value)
        pace, idle = (pace / 2, 0) if idle >= 4 else (pace, idle)
        chosen = sites[picked]
        sums = places.mapInArrow(_served(prices, chosen), "missed double, cost double").agg(
            F.sum("missed").alias("missed"), F.sum("cost").alias("cost")).first()
        if sums["cost"] is not None and sums["cost"] < upper:
            best, upper = [hubs[k] for k in sorted(picked)], sums["cost"]
        if not sums["missed"] or upper - lower <= tolerance * upper:
            break
        prices.moves.append((chosen, pace * (upper - value) / sums["missed"]))
    return Bound(min(lower, upper) * scale, upper * scale, sorted(best, key=lambda h: h.site_id), len(trail), trail)


def _xy(hubs: Sequence[Hub]) -> np.ndarray:
    return np.array([(h.x, h.y) for h in hubs], dtype=float).reshape(-1, 2)
