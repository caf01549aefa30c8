"""Assignment of facilities to hubs with limited room, largest facility first.

The serial rule (each facility, in order of size, takes its nearest hub that still has
room) needs only the hubs' loads from one facility to the next.  The order is cut in
buckets of about ``BUCKET_ROWS`` facilities.  Every bucket is worked out exactly and in
parallel from assumed loads at its start; the loads that the buckets add up to then tell which
starts were wrong.  A bucket also says by how much each starting load may differ before any
of its choices does, so only buckets outside these margins are worked out again.  The first
bucket that was wrong is right in the next round, hence the result is the serial one.
The driver holds one row of sums per bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldhub.functions import geo
from fieldhub.session import Scratch

BUCKET_ROWS = 20_000  # facilities of a bucket, about
LEAST_BUCKETS = 8
STEP_ROWS = 4_096  # facilities that are looked at together

_POINTS = "permit_id bigint, headcount bigint, x double, y double"
_ASSIGNED = f"{_POINTS}, assigned_site_idx int, distance_to_hub_km double"
_SUMS = "run int, bucket int, " + ", ".join(f"{c} array<double>" for c in ("added", "up", "down", "n", "x", "y"))


def bucket_count(rows: int) -> int:
    return max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS))


def bucketed(facilities: DataFrame, scratch: Scratch, buckets: int | None = None) -> DataFrame:
    """Facilities with ``bucket``: contiguous ranges of the priority order.

    Ranges are cut on (headcount, id), so equal headcounts spread over buckets, and the
    numbering is written out once so that every later step sees the same one.
    """
    slim = facilities.select("permit_id", "headcount", "x", "y")
    buckets = buckets or bucket_count(slim.count())
    ranged = slim.repartitionByRange(buckets, F.desc("headcount"), F.asc("permit_id"))
    return scratch.cut(ranged.withColumn("bucket", F.spark_partition_id()))


def _in_order(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values(["headcount", "permit_id"], ascending=[False, True])


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    body = np.stack([_in_order(rows)[c].to_numpy(float) for c in ("headcount", "x", "y")]).tobytes()
    return pd.DataFrame({"bucket": [rows["bucket"].iloc[0]], "body": [body]})


def packed(ranged: DataFrame, scratch: Scratch) -> DataFrame:
    """Bucketed facilities as a row per bucket: headcounts, x and y in order, some 0.5 MB.

    Rounds read these rows where they are, without a shuffle, a sort or a row per facility.
    """
    buckets = ranged.agg(F.max("bucket")).first()[0]
    dealt = ranged.repartition(1 + (buckets or 0), "bucket")
    return scratch.cut(dealt.groupBy("bucket").applyInPandas(_pack, "bucket int, body binary"))


@dataclass(frozen=True)
class Filled:
    choice: np.ndarray  # position of the hub, -1 for none
    added: np.ndarray  # load by hub
    up: np.ndarray  # how far a starting load may rise without any other choice
    down: np.ndarray  # it may fall, too, if it stays above this


def _plain(w: np.ndarray, d: np.ndarray, load: np.ndarray, capacity: float, up: np.ndarray, down: np.ndarray):
    """(choice, load, up, down) after rows during which no hub fills up: each is open to all of them or to none.

    None if some hub is open to a part of the rows, or would be.
    """
    room = capacity - load
    if not len(w) or np.isnan(w).any():
        return None
    shut = w.min() > room
    if (~shut & (w.max() > room)).any():
        return None
    if shut.all():
        pick = np.full(len(w), -1)
    else:
        pick = np.where(shut, np.inf, d).argmin(axis=1) if shut.any() else d.argmin(axis=1)
    some = pick >= 0
    added = np.bincount(pick[some], w[some], len(load))
    if (added > np.where(shut, 0, room)).any():
        return None
    up = np.where(added > 0, np.minimum(up, room - added), np.minimum(up, np.where(np.bincount(pick[some], minlength=len(load)) > 0, room, np.inf)))
    if shut.any():
        at = np.arange(len(w))
        best = np.where(some, d[at, pick], np.inf)
        for hub in np.flatnonzero(shut):
            before = d[:, hub] < best
            before |= (d[:, hub] == best) & ((hub < pick) | ~some)
            if before.any():
                down = down.copy()
                down[hub] = max(down[hub], room[hub] - w[before].min())
    return pick, load + added, up, down


def fill(weights: np.ndarray, dist: np.ndarray, start: np.ndarray, capacity: float) -> Filled:
    """The serial rule on rows in order; ``dist`` is (row, hub), equal ones take the first hub.

    Steps of rows choose together as if no hub filled up; a step ends before the first row that
    its hub has no room for, and the next step knows that.
    """
    rows, hubs = dist.shape
    choice = np.full(rows, -1, np.int32)
    load, up, down = start.astype(float), np.full(hubs, np.inf), np.full(hubs, -np.inf)
    at, size = 0, STEP_ROWS
    while at < rows:
        end = min(rows, at + size)
        w, d = weights[at:end], dist[at:end]
        done = _plain(w, d, load, capacity, up, down)
        if done is not None:
            choice[at:end], load, up, down = done
            at, size = end, STEP_ROWS
            continue
        open_ = w[:, None] <= (capacity - load)[None, :]
        near = np.where(open_, d, np.inf)
        pick = near.argmin(axis=1)
        pick[~open_.any(axis=1)] = -1
        taken = np.where(pick[:, None] == np.arange(hubs), w[:, None], 0.0)
        before = load + np.cumsum(taken, axis=0) - taken
        slack = capacity - before - w[:, None]
        own = (pick >= 0) & (slack[np.arange(len(w)), pick] < 0)
        stop = int(own.argmax()) if own.any() else len(w)
        pick, slack = pick[:stop], slack[:stop]
        chosen = pick[:, None] == np.arange(hubs)
        up = np.minimum(up, np.where(chosen, slack, np.inf).min(axis=0, initial=np.inf))
        # refused: every closed hub that would have come before the chosen one
        best = np.where(pick >= 0, d[np.arange(stop), pick], np.inf)
        closed = ~open_[:stop] & (d[:stop] <= best[:, None])
        closed &= (d[:stop] < best[:, None]) | (np.arange(hubs) < pick[:, None]) | (pick[:, None] < 0)
        down = np.maximum(down, np.where(closed & ~np.isnan(slack), slack, -np.inf).max(axis=0, initial=-np.inf))
        load = load + taken[:stop].sum(axis=0)
        choice[at : at + stop] = pick
        at += stop
        size = STEP_ROWS if stop == len(w) else max(64, size // 4)
        size = min(STEP_ROWS, size * 2)
    return Filled(choice, load - start, up, down)


@dataclass(frozen=True)
class Hubs:
    """Hubs in the order that breaks ties, and the unit of their distances."""

    ids: np.ndarray
    x: np.ndarray
    y: np.ndarray
    scale: float
    capacity: float

    @staticmethod
    def of(hubs: Sequence, capacity: float, unit: str) -> Hubs:
        ordered = sorted(hubs, key=lambda h: h.site_id)
        return Hubs(
            np.array([h.site_id for h in ordered], dtype=np.int64), np.array([h.x for h in ordered], dtype=float),
            np.array([h.y for h in ordered], dtype=float), geo.distance_scale(unit), float(capacity),
        )

    def fill(self, rows: pd.DataFrame, start: np.ndarray) -> tuple[pd.DataFrame, np.ndarray, Filled]:
        rows = _in_order(rows)
        return rows, *self.choose(*(rows[c].to_numpy(float) for c in ("headcount", "x", "y")), start)

    def choose(self, weights: np.ndarray, x: np.ndarray, y: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, Filled]:
        dx, dy = x[:, None] - self.x, y[:, None] - self.y
        dist = np.sqrt(dx * dx + dy * dy) * self.scale
        return dist, fill(weights, dist, start, self.capacity)


@dataclass(frozen=True)
class Problem:
    """One assignment: hubs and room, and the loads that buckets are assumed to start with."""

    hubs: Hubs
    starts: np.ndarray


def _sums(problems: dict[int, Problem], todo: dict[int, set[int]]) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for bucket, body in zip(batch["bucket"].tolist(), batch["body"], strict=True):
                weights, x, y = np.frombuffer(body).reshape(3, -1)
                for key, problem in problems.items():
                    if bucket not in todo[key]:
                        continue
                    _, found = problem.hubs.choose(weights, x, y, problem.starts[bucket])
                    some = found.choice >= 0
                    at = found.choice[some]
                    moments = [np.bincount(at, v if v is None else v[some], len(problem.hubs.ids)) for v in (None, x, y)]
                    out.append((key, bucket, found.added, found.up, found.down, *(m.astype(float) for m in moments)))
            yield pd.DataFrame(out, columns=["run", "bucket", "added", "up", "down", "n", "x", "y"])

    return run


def _assigned(problems: dict[int, Problem]) -> Callable:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        bucket, parts = int(rows["bucket"].iloc[0]), []
        for key, problem in problems.items():
            ordered, dist, found = problem.hubs.fill(rows, problem.starts[bucket])
            some = found.choice >= 0
            km = pd.array(np.where(some, dist[np.arange(len(ordered)), found.choice], 0.0), dtype="Float64")
            km[~some] = pd.NA
            out = ordered[["permit_id", "headcount", "x", "y"]].copy()
            out.insert(0, "run", key)
            out["assigned_site_idx"] = np.where(some, problem.hubs.ids[found.choice], -1).astype(np.int32)
            out["distance_to_hub_km"] = km
            parts.append(out)
        return pd.concat(parts)

    return run


@dataclass(frozen=True)
class Settled:
    starts: np.ndarray  # (bucket, hub): loads when the bucket begins
    rounds: int
    worked: int  # buckets worked out in all rounds
    count: np.ndarray  # by hub, in the order of hub numbers: facilities, and their mean position
    x: np.ndarray
    y: np.ndarray


def settle_many(
    ranged: DataFrame, runs: dict[int, tuple[Sequence, float]], unit: str = "km",
    guesses: dict[int, np.ndarray] | None = None,
) -> dict[int, Settled]:
    """The assignments of bucketed facilities to several sets of hubs, worked out together.

    ``runs`` has (hubs, capacity) by a number.  A round is one pass for all of them; one that has settled
    drops out of the next.  ``ranged`` may be ``packed`` already.  ``guesses`` are starts to begin with, such as those of an
    assignment to hubs nearby.
    """
    if "body" not in ranged.columns:
        ranged = packed(ranged, Scratch(ranged.sparkSession, "packed"))
    buckets = ranged.agg(F.max("bucket")).first()[0]
    buckets = 0 if buckets is None else buckets + 1
    hubs = {key: Hubs.of(given, capacity, unit) for key, (given, capacity) in runs.items()}
    starts = {key: np.zeros((buckets, len(h.ids))) for key, h in hubs.items()}
    for key, guess in (guesses or {}).items():
        if guess.shape == starts[key].shape:
            starts[key] = guess.copy()
    blank = lambda key: np.zeros_like(starts[key])
    added, up, down = ({key: blank(key) for key in hubs} for _ in range(3))
    moments = {key: np.zeros((3, *starts[key].shape)) for key in hubs}
    assumed = {key: start.copy() for key, start in starts.items()}
    todo = {key: set(range(buckets)) for key in hubs}
    rounds, worked = dict.fromkeys(hubs, 0), dict.fromkeys(hubs, 0)
    while any(todo.values()):
        wanted = set().union(*todo.values())
        part = ranged if len(wanted) == buckets else ranged.filter(F.col("bucket").isin(sorted(wanted)))
        active = {key: Problem(hubs[key], starts[key]) for key in hubs if todo[key]}
        for r in part.mapInPandas(_sums(active, todo), _SUMS).collect():
            key, b = r["run"], r["bucket"]
            added[key][b], up[key][b], down[key][b], assumed[key][b] = r["added"], r["up"], r["down"], starts[key][b]
            moments[key][:, b] = r["n"], r["x"], r["y"]
        for key in active:
            rounds[key], worked[key] = rounds[key] + 1, worked[key] + len(todo[key])
            starts[key] = np.cumsum(added[key], axis=0) - added[key]
            moved = starts[key] - assumed[key]
            todo[key] = {int(b) for b in np.flatnonzero(((moved > up[key]) | (moved <= down[key])).any(axis=1))}
    out = {}
    for key in hubs:
        n, x, y = moments[key].sum(axis=1)
        with np.errstate(invalid="ignore"):
            out[key] = Settled(starts[key], rounds[key], worked[key], n, x / n, y / n)
    return out


def assigned_many(
    ranged: DataFrame, runs: dict[int, tuple[Sequence, float]], settled: dict[int, Settled], unit: str = "km",
) -> DataFrame:
    """``run`` and the assigned facilities of every run, worked out where it is used."""
    problems = {key: Problem(Hubs.of(*runs[key], unit), found.starts) for key, found in settled.items()}
    return ranged.groupBy("bucket").applyInPandas(_assigned(problems), f"run int, {_ASSIGNED}")


@dataclass(frozen=True)
class Assignment:
    table: DataFrame  # worked out where it is used, from the settled starts
    starts: np.ndarray
    rounds: int
    worked: int


def settle(
    ranged: DataFrame, hubs: Sequence, capacity: float, unit: str = "km", guess: np.ndarray | None = None,
) -> Assignment:
    """The assignment of bucketed facilities to one set of hubs.

    A facility that no hub has room for, or without a headcount, gets -1.
    """
    runs = {0: (hubs, capacity)}
    found = settle_many(ranged, runs, unit, {} if guess is None else {0: guess})
    done = found[0]
    return Assignment(assigned_many(ranged, runs, found, unit).drop("run"), done.starts, done.rounds, done.worked)


def assign_with_capacity(
    facilities: DataFrame, hubs: Sequence, capacity: float, unit: str = "km", buckets: int | None = None,
) -> DataFrame:
    """Each facility, largest first, takes its nearest hub with room; -1 if none has."""
    scratch = Scratch(facilities.sparkSession, "capacity")
    return settle(bucketed(facilities, scratch, buckets), hubs, capacity, unit).table
