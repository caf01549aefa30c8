"""Near-duplicate vectors by a pivot-permutation index.

Pivots are a bounded sample of the vectors of each length (``PER_PIVOT`` vectors per pivot, ``FEWEST`` at least,
``PIVOT_BYTES`` in all), of which those within a cosine of ``APART`` of another are dropped, so a crowded
place has as few as any other.  A vector is described by its nearest pivots in order, nearest first, down to
``MARGIN`` below the nearest one's cosine, and each pivot has an inverted list of the vectors that name it.
Two vectors are candidates if the pivots they share are at least one in ``SHARED`` of the shorter
description; shared pivots are counted in the list of their smallest common pivot and in no other, so no
pair is looked at twice and none is emitted.
Candidates are verified by their cosine in double precision.

A list is cut in blocks of about ``BLOCK`` vectors by hash, and each pair of blocks is one group: a pivot
that many vectors name becomes many groups of the same size.  Equal vectors are folded into one
before, with their number, so copies cost nothing.  A group gives link counts per vector and
links that span what it found.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldhub.llm.common import cut
from fieldhub.operators.components import connected_components

LEAST_COSINE = 0.95
PER_PIVOT, FEWEST = 100, 64
PIVOT_BYTES = 32 << 20  # of the sample of all lengths together, about
APART = 0.8  # cosine; a sampled pivot that is nearer to another one is dropped
MARGIN = 0.1  # a pivot's cosines to two vectors of cosine 0.95 differ by about 0.04 in 64 dimensions
SHARED = 3  # measured: strangers rarely pass, pairs above 0.95 hardly ever fail
BLOCK = 2048
STEP_CELLS = 4 << 20  # cosines that are held at once

_DESCRIBED = "_vec long, _n long, _values binary, _near array<int>"
_FOUND = "_a long, _b long, _links long"


def usable(values: Column) -> Column:
    """A vector that has a direction: finite numbers only, and not all 0."""
    size = values.cast("array<double>")
    odd = F.exists(size, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~odd & F.exists(size, lambda x: x != 0), F.lit(False))


def _units(values: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so squares neither overflow nor vanish."""
    scaled = values / np.abs(values).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _apart(pivots: np.ndarray) -> np.ndarray:
    """The pivots, in their order, without those nearer than ``APART`` to one that is kept."""
    kept = np.empty_like(pivots)
    n = 0
    for first in range(0, len(pivots), 512):
        block = pivots[first : first + 512]
        if n:
            block = block[(block @ kept[:n].T).max(axis=1) < APART]
        close = block @ block.T >= APART
        taken: list[int] = []
        for i in range(len(block)):
            if not close[i, taken].any():
                taken.append(i)
        kept[n : n + len(taken)] = block[taken]
        n += len(taken)
    return kept[:n]


def _ordered(cosines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, pivots) of the descriptions: each row's nearest pivots, nearest first."""
    order = np.argsort(-cosines, axis=1, kind="stable")
    ranked = np.take_along_axis(cosines, order, axis=1)
    named = ranked >= ranked[:, :1] - MARGIN
    return named.sum(axis=1), order[named]


def _describe(pivots: dict[int, tuple[int, np.ndarray]]):
    """The descriptions; ``pivots`` has (number of the first, unit rows) by vector length.  Vectors of a length without
    pivots name one that stands for it.  Batch: id, number of equal vectors, values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = pc.list_value_length(whole.column(2)).to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                first, known = pivots.get(int(size), (-int(size), None))
                rows = np.flatnonzero(sizes == size)
                step = max(16, STEP_CELLS // (1 if known is None else len(known)))
                for at in range(0, len(rows), step):
                    batch = whole.take(pa.array(rows[at : at + step]))
                    values = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
                    if known is None:
                        many, near = np.ones(len(values), np.int64), np.zeros(len(values), np.int64)
                    else:
                        many, near = _ordered(_units(values) @ known.T)
                    ends = np.concatenate(([0], np.cumsum(many))).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array((near + first).astype(np.int32)))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0), batch.column(1), pa.array([v.tobytes() for v in values], pa.binary()), lists],
                        ["_vec", "_n", "_values", "_near"],
                    )

    return run


def _roots(linked: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id that each row and column reaches within a matrix of links."""
    far = np.iinfo(np.int64).max
    left, right = rows.copy(), columns.copy()
    while True:
        new_left = np.minimum(left, np.where(linked, right[None, :], far).min(axis=1, initial=far))
        new_right = np.minimum(right, np.where(linked, new_left[:, None], far).min(axis=0, initial=far))
        if (new_left == left).all() and (new_right == right).all():
            return left, right
        left, right = new_left, new_right


def _verify(least: float):
    """Link counts and spanning links of one pair of blocks of a pivot's list."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        pivot, low, high = (k.as_py() for k in key)
        table = table.combine_chunks()
        ids = table.column("_vec").to_numpy()
        many = table.column("_n").to_numpy()
        side = table.column("_block").to_numpy()
        values = _units(np.array([np.frombuffer(v, np.float64) for v in table.column("_values").to_pylist()]))
        lists = table.column("_near").to_pylist()
        near = np.concatenate(lists)
        row = np.repeat(np.arange(len(ids)), list(map(len, lists)))
        names, place = np.unique(near, return_inverse=True)
        mark = np.zeros((len(ids), len(names)), np.float32)
        mark[row, place] = 1
        before = int(np.searchsorted(names, pivot))  # the smaller pivots are the first columns
        length = mark.sum(axis=1)
        a, b = np.flatnonzero(side == low), np.flatnonzero(side == high)
        shared = mark[a] @ mark[b].T
        here = mark[a, :before] @ mark[b, :before].T == 0
        enough = SHARED * shared >= np.minimum(length[a][:, None], length[b][None, :])
        linked = here & enough & (values[a] @ values[b].T >= least)
        if low == high:
            np.fill_diagonal(linked, False)
        links = np.zeros(len(ids), np.int64)
        links[a] += linked @ many[b]
        if low != high:
            links[b] += linked.T @ many[a]
        root_a, root_b = _roots(linked, ids[a], ids[b])
        roots = ids.copy()
        roots[b] = root_b
        roots[a] = np.minimum(root_a, roots[a])
        some = (links > 0) | (roots != ids)
        return pa.table({"_a": ids[some], "_b": roots[some], "_links": links[some]})

    return run


def _blocks(described: DataFrame) -> DataFrame:
    """Postings dealt to pairs of blocks of their pivot's list."""
    postings = described.select("*", F.explode("_near").alias("_pivot"))
    sizes = postings.groupBy("_pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_cuts"))
    dealt = postings.join(F.broadcast(sizes), "_pivot").withColumn(  # one row a pivot
        "_block", F.pmod(F.xxhash64("_vec", "_pivot"), F.col("_cuts"))
    )
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_cuts") - 1)).alias("_other")
    return dealt.select("*", other).select(
        "_pivot", F.least("_block", "_other").alias("_low"), F.greatest("_block", "_other").alias("_high"),
        "_block", "_vec", "_n", "_values", "_near",
    )


def _pivots(classes: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """(number of the first, unit rows) of the pivots of each vector length, from a sample by hash."""
    size = F.size("_vector")
    lengths = classes.groupBy(size.alias("_size")).agg(F.count(F.lit(1)).alias("_many"))
    wanted = F.least(F.col("_many"), F.greatest(F.lit(FEWEST), F.col("_many") / PER_PIVOT))
    total = lengths.agg(F.sum(wanted * F.col("_size") * 8)).first()[0] or 0
    rate = wanted / F.col("_many") * min(1.0, PIVOT_BYTES / max(total, 1))
    rates = lengths.select("_size", rate.alias("_rate"))  # one row a length
    draw = F.pmod(F.xxhash64("_vec"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = classes.withColumn("_size", size).join(F.broadcast(rates), "_size").filter(draw < F.col("_rate"))
    rows = sample.select("_size", "_vector").orderBy("_size", F.xxhash64("_vec"), "_vec").collect()
    out, first = {}, 0
    for length, group in groupby(rows, key=lambda r: r["_size"]):
        kept = _apart(_units(np.array([r["_vector"] for r in group])))
        out[length] = first, kept
        first += len(kept)
    return out


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                 least: float = LEAST_COSINE) -> DataFrame:
    """(_id, _links, _component, _kept) for every row of ``vectors``.

    ``_links`` counts the other ids whose vector's cosine is ``least`` or more, ``_component`` is the
    smallest id that links reach, the own included.  Vectors link with those of their own length.  Vectors that are
    null, empty, all 0 or hold null or non-finite numbers link with nothing, nor do rows without
    an id.  Rows that share an id are one vector, of which the smallest array counts; each of
    them is returned.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast("array<double>").alias("_vector"))
    sound = rows.filter(F.col("_id").isNotNull() & usable(F.col("_vector")))
    single = cut(sound.groupBy("_id").agg(F.min("_vector").alias("_vector")), "vectors")
    classes = cut(single.groupBy("_vector").agg(F.min("_id").alias("_vec"), F.count(F.lit(1)).alias("_n"))
                  .select("_vec", "_n", "_vector"), "classes")
    described = cut(classes.mapInArrow(_describe(_pivots(classes)), _DESCRIBED), "described")
    found = cut(_blocks(described).groupBy("_pivot", "_low", "_high").applyInArrow(_verify(least), _FOUND), "links")
    counts = found.groupBy(F.col("_a").alias("_vec")).agg(F.sum("_links").alias("_links"))
    roots = connected_components(found.filter("_a <> _b"), "_a", "_b").distinct().select(
        F.col("node").alias("_vec"), F.col("component").alias("_root"))
    named = (
        classes.join(counts, "_vec", "left").join(roots, "_vec", "left")
        .select("_vector", (F.coalesce("_links", F.lit(0)) + F.col("_n") - 1).alias("_links"),
                F.coalesce("_root", "_vec").alias("_component"))
    )
    members = single.join(named, "_vector").select(F.col("_id").alias("_of"), "_links", "_component")
    return rows.select("_id").join(members, F.col("_id") == F.col("_of"), "left").select(
        "_id", F.coalesce("_links", F.lit(0)).cast("long").alias("_links"), F.coalesce("_component", "_id").alias("_component"),
        F.coalesce(F.coalesce("_component", "_id") == F.col("_id"), F.lit(False)).alias("_kept"),
    )
