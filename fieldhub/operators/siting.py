"""Hub siting: distances, capacity-constrained assignment, refinement, p-median.

Hubs are a handful of rows given by a run parameter, so their coordinates live on the
driver and enter the plans as literals; facilities stay distributed.  A facility table
here has (permit_id, headcount, x, y) with planar coordinates.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from fieldhub import constants as K
from fieldhub.functions import geo
from fieldhub.operators.capacity import (  # noqa: F401
    assign_with_capacity, assigned_many, bucketed, packed, settle, settle_many,
)
from fieldhub.session import Scratch, small_table

MAX_HUBS = 256  # more hubs than this is not a run parameter any more


@dataclass(frozen=True)
class Hub:
    site_id: int
    x: float
    y: float


def hubs_of(sites: DataFrame, key: str = "site_id") -> list[Hub]:
    """Read a small site table (key, x, y); refuses tables that are no parameter list."""
    rows = sites.select(key, "x", "y").limit(MAX_HUBS + 1).collect()
    if len(rows) > MAX_HUBS:
        raise ValueError(f"more than {MAX_HUBS} hubs")
    return [Hub(r[0], r[1], r[2]) for r in sorted(rows)]


def project(permits: DataFrame, *keep: str) -> DataFrame:
    """Located facilities with state-plane coordinates."""
    x, y = geo.state_plane(F.col("longitude"), F.col("latitude"))
    return permits.filter(
        F.col("longitude").isNotNull() & F.col("latitude").isNotNull()
    ).select("permit_id", "headcount", x.alias("x"), y.alias("y"), *keep)


# --- distances -----------------------------------------------------------------
def _dist(hub: Hub, scale: float) -> Column:
    return geo.distance(F.col("x"), F.col("y"), F.lit(hub.x), F.lit(hub.y)) * F.lit(scale)


def _nearest(hubs: Sequence[Hub], scale: float, allowed: Sequence[Column] | None = None) -> Column:
    """struct(d, k) of the nearest hub (lower k wins ties), null when none is allowed."""
    options = [
        F.struct(_dist(h, scale).alias("d"), F.lit(h.site_id).alias("k")) for h in hubs
    ]
    if allowed is not None:
        options = [F.when(a, o) for a, o in zip(allowed, options)]
    return F.least(*options) if len(options) > 1 else options[0]


def distance_table(
    facilities: DataFrame, hubs: Sequence[Hub], unit: str = "km", missing: float | None = None
) -> DataFrame:
    """Long (permit_id, site_id, dist) table for a list of hubs.

    ``missing`` keeps facilities without a location and gives them that distance.
    """
    scale = geo.distance_scale(unit)
    cells = F.array(*[
        F.struct(F.lit(h.site_id).alias("site_id"), _dist(h, scale).alias("dist")) for h in hubs
    ])
    known = facilities if missing is not None else facilities.filter("x is not null and y is not null")
    out = known.select("permit_id", F.explode(cells).alias("c")).select("permit_id", "c.*")
    return out if missing is None else out.withColumn("dist", F.coalesce("dist", F.lit(missing)))


def hub_preferences(facilities: DataFrame, hubs: Sequence[Hub], unit: str = "km") -> DataFrame:
    """Hubs of each facility from near to far: an in-row sort of a short array."""
    scale = geo.distance_scale(unit)
    order = F.sort_array(F.array(*[
        F.struct(_dist(h, scale).alias("d"), F.lit(h.site_id).alias("k")) for h in hubs
    ]))
    return facilities.select("permit_id", F.posexplode(order).alias("pos", "o")).select(
        "permit_id", (F.col("pos") + 1).alias("rank"), F.col("o.k").alias("site_id")
    )


def nearest_site(
    facilities: DataFrame, hubs: Sequence[Hub], unit: str = "km", column: str = "assigned_site_idx"
) -> DataFrame:
    """Uncapacitated assignment."""
    near = facilities.withColumn("_n", _nearest(hubs, geo.distance_scale(unit)))
    return near.withColumns({
        column: F.col("_n.k"), "distance_to_hub_km": F.col("_n.d"),
    }).drop("_n")


def initial_hubs(facilities: DataFrame, p: int) -> list[Hub]:
    """The p largest facilities; the largest gets the highest hub number."""
    if p > MAX_HUBS:
        raise ValueError(f"more than {MAX_HUBS} hubs")
    rows = facilities.orderBy(F.desc("headcount"), "permit_id").limit(p).select("x", "y").collect()
    return [Hub(k, r["x"], r["y"]) for k, r in enumerate(reversed(rows))]


def default_capacity(facilities: DataFrame, p: int) -> int:
    """Total headcount per hub plus a tenth."""
    total = facilities.agg(F.sum("headcount")).first()[0] or 0
    return -(-total * 11 // (10 * p))


# --- running loads -----------------------------------------------------------------
def _choice_sums(state: DataFrame, hubs: Sequence[Hub]) -> list[Column]:
    return [
        F.coalesce(F.sum(F.when(F.col("choice") == h.site_id, F.col("headcount"))), F.lit(0))
        .cast("double").alias(f"s{h.site_id}")
        for h in hubs
    ]


def _with_loads_before(
    state: DataFrame, hubs: Sequence[Hub], offsets: DataFrame
) -> DataFrame:
    """Add b<k>: load of hub k from rows of higher priority.

    Prefix sums in two levels: a window inside each bucket plus the loads of the buckets
    before it (``offsets``: one row per bucket, so the broadcast is bounded).
    """
    before = (
        Window.partitionBy("bucket").orderBy(F.desc("headcount"), "permit_id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    run = {
        f"b{h.site_id}": F.col(f"o{h.site_id}") + F.coalesce(
            F.sum(F.when(F.col("choice") == h.site_id, F.col("headcount"))).over(before), F.lit(0)
        )
        for h in hubs
    }
    return state.join(F.broadcast(offsets), "bucket").withColumns(run)


def running_load(facilities: DataFrame, hubs: Sequence[Hub], unit: str = "km") -> DataFrame:
    """Load of the nearest hub from larger facilities, per facility (size order)."""
    scratch = Scratch(facilities.sparkSession, "running")
    ranged = bucketed(facilities, scratch)
    near = nearest_site(ranged, hubs, unit).withColumnRenamed(
        "assigned_site_idx", "choice"
    )
    sums = near.groupBy("bucket").agg(*_choice_sums(near, hubs))
    order = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(  # one row per bucket
        "bucket",
        *[F.coalesce(F.sum(f"s{h.site_id}").over(order), F.lit(0.0)).alias(f"o{h.site_id}") for h in hubs],
    )
    loaded = _with_loads_before(near, hubs, offsets)
    own = F.coalesce(*[
        F.when(F.col("choice") == h.site_id, F.col(f"b{h.site_id}")) for h in hubs
    ])
    return loaded.select(
        "permit_id", F.col("choice").alias("site_id"), "headcount",
        own.cast("bigint").alias("load_before"),
    )


# --- refinement ------------------------------------------------------------------
@dataclass
class SitingRun:
    hubs: list[Hub]
    assigned: DataFrame
    rounds: int
    converged: bool
    trail: list[float] = field(default_factory=list)
    settling: list[int] = field(default_factory=list)  # rounds of each assignment


@dataclass(frozen=True)
class SitingRuns:
    runs: dict[int, SitingRun]  # by number of hubs
    table: DataFrame  # run (that number) and the assigned facilities, of all runs


def centroids(assigned: DataFrame, hubs: Sequence[Hub]) -> list[Hub]:
    """Mean position of each hub's facilities; an empty hub keeps its place."""
    means = {
        r["k"]: (r["x"], r["y"])
        for r in assigned.filter("assigned_site_idx >= 0")
        .groupBy(F.col("assigned_site_idx").alias("k"))
        .agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
        .collect()
    }
    return [Hub(h.site_id, *means.get(h.site_id, (h.x, h.y))) for h in hubs]


def refine_many(
    facilities: DataFrame,
    sizes: Sequence[int],
    capacity: float | None = None,
    unit: str = "km",
    max_rounds: int = K.MAX_SITING_ROUNDS,
    tolerance: float = K.CONVERGED_MOVE,
) -> SitingRuns:
    """Siting runs for several numbers of hubs, together.

    Each run assigns, moves its hubs to the centroids and repeats until the joint move is
    small.  On convergence the hubs stay where the last assignment saw them; when the rounds
    run out they have moved once more.  The facilities are cut in buckets once for all runs,
    a pass works on all runs that still move, and each assignment begins with the loads
    of the one before.  The pass that settles an assignment also sums its positions, so the
    centroids take no other.  The assignments are written once; ``assigned`` reads them.
    """
    scratch = Scratch(facilities.sparkSession, "points", keep=len(sizes) + 2)
    points = bucketed(facilities, scratch)
    rows = packed(points, Scratch(facilities.sparkSession, "packed"))
    first = initial_hubs(points, max(sizes))
    runs, room, at, found = {}, {}, {}, {}
    for p in sizes:
        hubs = [Hub(k, h.x, h.y) for k, h in enumerate(first[max(0, len(first) - p):])]
        runs[p] = SitingRun(hubs, points, 0, False)
        room[p] = default_capacity(points, p) if capacity is None else capacity
    active = list(runs)
    for _ in range(max(1, max_rounds)):
        at |= {p: runs[p].hubs for p in active}
        now = settle_many(
            rows, {p: (at[p], room[p]) for p in active}, unit, {p: found[p].starts for p in active if p in found})
        found |= now
        still = []
        for p in active:
            run, done = runs[p], now[p]
            run.settling.append(done.rounds)
            ordered = sorted(run.hubs, key=lambda h: h.site_id)
            moved = [
                Hub(h.site_id, float(x), float(y)) if n else h
                for h, n, x, y in zip(ordered, done.count, done.x, done.y, strict=True)
            ]
            move = math.sqrt(sum((a.x - b.x) ** 2 + (a.y - b.y) ** 2 for a, b in zip(moved, ordered, strict=True)))
            run.rounds += 1
            run.trail.append(move)
            if move < tolerance:
                run.converged = True
            else:
                run.hubs = moved
                still.append(p)
        active = still
        if not active:
            break
    table = scratch.cut(assigned_many(points, {p: (at[p], room[p]) for p in found}, found, unit))
    for p in found:
        runs[p].assigned = table.filter(F.col("run") == p).drop("run")
    return SitingRuns(runs, table)


def refine_hubs(
    facilities: DataFrame, p: int, capacity: float | None = None, unit: str = "km",
    max_rounds: int = K.MAX_SITING_ROUNDS, tolerance: float = K.CONVERGED_MOVE,
) -> SitingRun:
    """One siting run of ``refine_many``."""
    return refine_many(facilities, [p], capacity, unit, max_rounds, tolerance).runs[p]


def snap_hubs(facilities: DataFrame, hubs: Sequence[Hub]) -> DataFrame:
    """(site_id, permit_id) of the facility nearest to each hub.

    One pass with one running minimum per hub; nothing is paired up.
    """
    best = facilities.agg(*[
        F.min(F.struct(_dist(h, 1.0).alias("d"), F.col("permit_id").alias("id"))).alias(f"h{h.site_id}")
        for h in hubs
    ])
    rows = F.array(*[
        F.struct(F.lit(h.site_id).alias("site_id"), F.col(f"h{h.site_id}.id").alias("permit_id"))
        for h in hubs
    ])
    return best.select(F.explode(rows).alias("r")).select("r.*")


def transport_effort(assigned: DataFrame) -> DataFrame:
    served = F.col("assigned_site_idx") >= 0
    return assigned.agg(
        F.coalesce(
            F.sum(F.when(served, F.col("headcount") * F.col("distance_to_hub_km"))), F.lit(0.0)
        ).alias("effort")
    )


# --- p-median --------------------------------------------------------------------
SIDES = (32, 128, 512)  # cells of the demand along a side: of all candidates' bounds, then of those still possible
RATED_AT_ONCE = 4_096  # candidates that are rated on finer cells together
EVALUATED_AT_ONCE = 16  # and evaluated over all sources; fourfold from pass to pass
MOST_EVALUATED = 1_024
FEW = 64  # so many candidates need no finer cells
DISTANCES = 1 << 18  # that a task holds at once
_CELL = ("w", "cx", "cy", "x0", "x1", "y0", "y1", "b0", "b1", "wb")


def _to_open(open_sites: Sequence[Hub]) -> Column | None:
    """Distance to the nearest open site, null-free; None without open sites."""
    ds = [_dist(s, 1.0) for s in open_sites]
    if not ds:
        return None
    return F.least(*ds) if len(ds) > 1 else ds[0]


def _places(sites: Sequence[Hub]) -> np.ndarray:
    return np.array([(s.x, s.y) for s in sites], dtype=float).reshape(-1, 2)


def _numbers(batches: Iterator[pa.RecordBatch], wide: int) -> Iterator[np.ndarray]:
    """Rows of numbers, so many at once that ``wide`` distances a row fit."""
    step = max(1, DISTANCES // max(1, wide))
    for batch in batches:
        rows = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
        for at in range(0, len(rows), step):
            yield rows[at : at + step]


def _by_site(rows: DataFrame, sites: Sequence[Hub], value: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list[float]:
    """Sum over the rows of ``value`` (a site each) for every site: one pass, one running sum per site."""
    xy = _places(sites)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(xy))
        for part in _numbers(batches, len(xy)):
            sums += value(part, xy).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(xy)), pa.int32()), pa.array(sums)], ["at", "value"])

    sums = {r["at"]: r["value"] for r in rows.mapInArrow(run, "at int, value double").groupBy("at").agg(
        F.sum("value").alias("value")).collect()}
    return [sums.get(i, 0.0) for i in range(len(xy))]


def _exact_totals(sources: DataFrame, open_sites: Sequence[Hub], batch: Sequence[Hub]) -> list[float]:
    """Objective after opening each site of a batch."""
    opened = _places(open_sites)

    def cost(rows: np.ndarray, xy: np.ndarray) -> np.ndarray:
        far = _apart(xy, rows[:, 1], rows[:, 2])
        if len(opened):
            far = np.minimum(far, _apart(opened, rows[:, 1], rows[:, 2]).min(axis=0))
        return far * rows[:, 0]

    return _by_site(sources, batch, cost)


def _apart(xy: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances (place, row)."""
    dx, dy = xy[:, :1] - x, xy[:, 1:] - y
    return np.sqrt(dx * dx + dy * dy)


def _demand_cells(sources: DataFrame, open_sites: Sequence[Hub], box: Row, side: int) -> DataFrame:
    """The demand by cells of a grid of ``side`` by ``side``, as rows of ``_CELL``."""
    x0, y0 = box["x0"] or 0.0, box["y0"] or 0.0
    size = max((box["x1"] or 0.0) - x0, (box["y1"] or 0.0) - y0, 1e-9) / (side - 1)
    w = F.col("headcount").cast("double")
    now = _to_open(open_sites)
    b = F.lit(0.0) if now is None else now
    cells = (
        sources.filter("headcount > 0")
        .groupBy(F.floor((F.col("x") - x0) / size).alias("_i"), F.floor((F.col("y") - y0) / size).alias("_j"))
        .agg(
            F.sum(w).alias("w"), (F.sum(w * F.col("x")) / F.sum(w)).alias("cx"),
            (F.sum(w * F.col("y")) / F.sum(w)).alias("cy"),
            F.min("x").alias("x0"), F.max("x").alias("x1"),
            F.min("y").alias("y0"), F.max("y").alias("y1"),
            F.min(b).alias("b0"), F.max(b).alias("b1"), F.sum(w * b).alias("wb"),
        )
    )
    return cells.select(*_CELL)


def _least_cost(first: bool) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Lower bound (site, cell) of what a cell costs if the site opened.

    A cell's demand is at least as far as its weighted centre (distance is convex).  With
    sites already open, a cell out of the new site's range keeps its present cost exactly.
    """

    def bound(cells: np.ndarray, xy: np.ndarray) -> np.ndarray:
        w, cx, cy, x0, x1, y0, y1, b0, b1, wb = cells.T
        to_center = w * _apart(xy, cx, cy)
        if first:
            return to_center
        x, y = xy[:, :1], xy[:, 1:]
        gx, gy = np.maximum(0, np.maximum(x0 - x, x - x1)), np.maximum(0, np.maximum(y0 - y, y - y1))
        fx, fy = np.maximum(np.abs(x - x0), np.abs(x - x1)), np.maximum(np.abs(y - y0), np.abs(y - y1))
        near2, far2 = gx * gx + gy * gy, fx * fx + fy * fy
        between = w * np.minimum(b0, np.sqrt(near2))
        return np.where(near2 >= b1 * b1, wb, np.where(far2 <= b0 * b0, to_center, between))

    return bound


def _bounds(candidates: DataFrame, cells: np.ndarray, first: bool) -> DataFrame:
    """(site_id, x, y, bound): lower bounds of the objective by at most SIDES[0]² cells."""
    kind, value = candidates.schema["site_id"].dataType.simpleString(), _least_cost(first)
    step = max(1, DISTANCES // max(1, len(cells)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xy = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2)])
            sums = [value(cells, xy[at : at + step]).sum(axis=1) for at in range(0, len(xy), step)]
            bound = np.concatenate(sums) if sums else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bound * (1 - 1e-9))], ["site_id", "x", "y", "bound"])

    return candidates.mapInArrow(run, f"site_id {kind}, x double, y double, bound double")


def best_addition(
    sources: DataFrame, candidates: DataFrame, open_sites: Sequence[Hub]
) -> tuple[Hub, float]:
    """The candidate (site_id, x, y) whose opening gives the least total, found exactly.

    Every candidate gets a lower bound from a few demand cells.  The best by it are evaluated over
    all sources; the bounds of those that may still be better are worked out on finer and finer cells, and what these
    leave is evaluated, best bound first, until no bound is below the best total.  Of candidates on one spot the
    lowest id stands for all.  No source × candidate table exists at any point.
    """
    spark = sources.sparkSession
    scratch, finer = Scratch(spark, "bounds"), Scratch(spark, "cells", keep=len(SIDES))
    box = sources.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    coarse = _demand_cells(sources, open_sites, box, SIDES[0]).collect()  # SIDES[0]² rows at most
    first = not open_sites
    left = candidates.select("site_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    if open_sites:
        left = left.filter(~F.col("site_id").isin(*[s.site_id for s in open_sites]))
    spots = left.groupBy("x", "y").agg(F.min("site_id").alias("site_id")).select("site_id", "x", "y")
    bounds = scratch.cut(_bounds(
        spots.repartition(spark.sparkContext.defaultParallelism),
        np.array([tuple(r) for r in coarse], dtype=float).reshape(-1, len(_CELL)), first))
    cells: dict[int, DataFrame] = {}
    best: tuple[float, int, Hub] | None = None

    def possible(rated: list[tuple[float, Hub]]) -> list[tuple[float, Hub]]:
        """Those whose bound is below the best total, or equal to it with a lower id; best bound first."""
        return sorted(
            ((b, s) for b, s in rated if best is None or (b, s.site_id) < best[:2]), key=lambda r: (r[0], r[1].site_id))

    def evaluate(rated: list[tuple[float, Hub]], passes: int | None = None) -> list[tuple[float, Hub]]:
        """Evaluate over all sources until no bound is below the best total; what remains after ``passes``."""
        nonlocal best
        many = EVALUATED_AT_ONCE
        while rated and passes != 0:
            batch, rated = [s for _, s in rated[:many]], rated[many:]
            for total, site in zip(_exact_totals(sources, open_sites, batch), batch, strict=True):
                if best is None or (total, site.site_id) < best[:2]:
                    best = (total, site.site_id, site)
            rated = possible(rated)
            many = min(many * 4, MOST_EVALUATED)
            passes = passes and passes - 1
        return rated

    last = None
    while True:
        todo = bounds if last is None else bounds.filter(
            (F.col("bound") > last[0]) | ((F.col("bound") == last[0]) & (F.col("site_id") > last[1]))
        )
        if best is not None:
            todo = todo.filter(F.col("bound") <= best[0])
        rows = todo.orderBy("bound", "site_id").limit(RATED_AT_ONCE).collect()
        if not rows:
            break
        rated = [(r["bound"], Hub(r["site_id"], r["x"], r["y"])) for r in rows]
        if best is None:
            rated = evaluate(rated, 1)
        for side in SIDES[1:]:
            if len(rated) <= FEW:
                break
            if side not in cells:
                cells[side] = finer.cut(_demand_cells(sources, open_sites, box, side))
            sites = [s for _, s in rated]
            now = _by_site(cells[side].repartition(spark.sparkContext.defaultParallelism), sites, _least_cost(first))
            rated = possible([(b * (1 - 1e-9), s) for b, s in zip(now, sites, strict=True)])
            rated = evaluate(rated, 1) if len(rated) > FEW else rated
        evaluate(rated)
        if len(rows) < RATED_AT_ONCE:
            break
        last = (rows[-1]["bound"], rows[-1]["site_id"])
    if best is None:
        raise ValueError("no candidate sites left")
    return best[2], best[0]


@dataclass
class Median:
    sites: list[Hub]
    objective: float
    converged: bool  # no swap improves any more; False if the sweeps ran out or none was asked for


def p_median(
    sources: DataFrame,
    candidates: DataFrame,
    p: int,
    unit: str = "km",
    swap: bool = True,
    max_sweeps: int = 20,
) -> Median:
    """Sites minimising Σ headcount·distance: greedy additions, then vertex swaps.

    Each addition and each swap is the exact best one; p = 1 is optimal.  ``max_sweeps``
    bounds the rounds of swaps; the result says whether they came to an end by themselves.
    """
    spark = sources.sparkSession
    scratch = Scratch(spark, "pmedian", keep=3)
    spread = lambda df: df.repartition(spark.sparkContext.defaultParallelism)
    spots = sources.dropna(subset=["headcount", "x", "y"]).groupBy("x", "y").agg(F.sum("headcount").alias("headcount"))
    sources = scratch.cut(spread(spots.select("headcount", "x", "y")))
    candidates = scratch.cut(spread(candidates.select("site_id", "x", "y").dropna()))
    known: dict[frozenset[int], tuple[Hub, float]] = {}

    def addition(open_sites: list[Hub]) -> tuple[Hub, float]:
        key = frozenset(s.site_id for s in open_sites)
        if key not in known:
            known[key] = best_addition(sources, candidates, open_sites)
        return known[key]

    chosen: list[Hub] = []
    total = float("inf")
    for _ in range(p):
        site, total = addition(chosen)
        chosen.append(site)
    improved = p > 1
    for _ in range(max_sweeps if swap else 0):
        if not improved:
            break
        improved = False
        for old in list(chosen):
            others = [s for s in chosen if s != old]
            site, better = addition(others)
            if site != old and better < total * (1 - 1e-12):
                chosen, total, improved = [*others, site], better, True
    return Median(sorted(chosen, key=lambda s: s.site_id), total * geo.distance_scale(unit), not improved)


def sites_table(spark, sites: Sequence[Hub]) -> DataFrame:
    rows = [(s.site_id, float(s.x), float(s.y)) for s in sites]
    return small_table(spark, rows, {"site_id": "bigint", "x": "double", "y": "double"})
