"""Best-fit packing planned on the histogram of lengths.

Only counts per length (at most ``SIZE`` of them) reach the driver.  The plan runs best fit
from the longest length down on groups of equal sequences: all sequences of a group have the
same room left, so one step places many items at once.  The plan is a table of runs (length,
first and last rank, first sequence, items per sequence, offset) whose number depends on
``SIZE`` alone.  A piece finds its slot by its length and its rank among the pieces of that length; ranks
come from counts per (length, bucket of ids) and a window inside each bucket.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldhub.llm.common import cut, slices, text_of
from fieldhub.llm.tokens import Ids

SIZE = 2048
SLICE = 1 << 19  # bytes of text whose words are held at once
END = 0  # id that closes every document
BUCKET = 20_000  # pieces of one length that are ranked in one window, about

_PIECES = "_id long, _piece int, _start long, _length long, _crc long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _cut(ids: np.ndarray, size: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, crc32) of a document's pieces; what doesn't fill a piece goes first."""
    start, stop = 0, len(ids) % size or min(size, len(ids))
    while start < len(ids):
        yield start, stop - start, zlib.crc32(ids[start:stop].tobytes())
        start, stop = stop, stop + size


def _pieces(tokenizer: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids.of(tokenizer)
        end = np.array([END], dtype="<u4").tobytes()
        for whole in batches:
            for batch in slices(whole, 1, SLICE):
                rows = []
                encoded = ids.encode(batch.column(1).to_pylist())
                for row_id, found in zip(batch.column(0).to_pylist(), encoded, strict=True):
                    pieces = _cut(np.frombuffer(found + end, dtype="<u4"), size)
                    rows += [(row_id, k, *piece) for k, piece in enumerate(pieces)]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                arrays = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["_id", "_piece", "_start", "_length", "_crc"])

    return run


@dataclass(frozen=True)
class Run:
    """Items ``first`` to ``last`` (ranks from 0) of a length, ``each`` per sequence."""

    length: int
    first: int
    last: int
    sequence: int
    each: int
    offset: int


def plan(counts: dict[int, int], size: int = SIZE) -> list[Run]:
    """Best fit, longest first: each item goes to the fullest sequence that has room."""
    runs: list[Run] = []
    open_at: dict[int, list[tuple[int, int]]] = {}  # room left -> (first sequence, sequences)
    rooms: list[int] = []  # sorted
    made = 0

    def leave(room: int, first: int, many: int) -> None:
        if room and many:
            if room not in open_at:
                open_at[room] = []
                insort(rooms, room)
            open_at[room].append((first, many))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, many = open_at[room].pop()
                if not open_at[room]:
                    del open_at[room]
                    rooms.pop(at)
            else:
                room, first = size, made
                many = -(-left // (size // length))
                made += many
            each = room // length
            whole = min(many, left // each)
            if whole:
                runs.append(Run(length, rank, rank + whole * each - 1, first, each, size - room))
                leave(room - each * length, first, whole)
                rank, left = rank + whole * each, left - whole * each
            if whole < many and left:
                part = min(left, each)  # fewer than fill the next sequence
                if left < each:
                    runs.append(Run(length, rank, rank + part - 1, first + whole, each, size - room))
                    leave(room - part * length, first + whole, 1)
                    rank, left, whole = rank + part, 0, whole + 1
            leave(room, first + whole, many - whole)
    return runs


def _ranked(pieces: DataFrame) -> DataFrame:
    """``_rank`` of each piece among those of its length, from 0."""
    counted = pieces.groupBy("_length").agg(F.count(F.lit(1)).alias("_many"))
    bucket = F.pmod(F.xxhash64("_id", "_piece", "_crc"), F.ceil(F.col("_many") / BUCKET))
    dealt = pieces.join(F.broadcast(counted), "_length").withColumn("_bucket", bucket)  # <= SIZE rows
    sums = dealt.groupBy("_length", "_bucket").agg(F.count(F.lit(1)).alias("_in"))
    before = Window.partitionBy("_length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_in").over(before), F.lit(0))).drop("_in")
    own = Window.partitionBy("_length", "_bucket").orderBy("_id", "_piece", "_crc")
    return (
        dealt.withColumn("_own", F.row_number().over(own) - 1)
        .join(sums, ["_length", "_bucket"])
        .withColumn("_rank", F.col("_before") + F.col("_own"))
        .drop("_many", "_bucket", "_own", "_before")
    )


def _slots(runs: list[Run]):
    """(sequence, offset) of pieces, from arrays of length and rank."""
    ordered = sorted(runs, key=lambda r: (r.length, r.first))
    table = np.array([[r.length, r.first, r.sequence, r.each, r.offset] for r in ordered], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("_length").to_numpy(), batch.column("_rank").to_numpy()
            sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
            for one in np.unique(length):
                own = table[table[:, 0] == one]
                here = np.flatnonzero(length == one)
                found = own[np.searchsorted(own[:, 1], rank[here], side="right") - 1]
                turn = rank[here] - found[:, 1]
                sequence[here] = found[:, 2] + turn // found[:, 3]
                offset[here] = found[:, 4] + turn % found[:, 3] * one
            columns = [batch.column(n) for n in ("_id", "_piece", "_start", "_length", "_crc")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence), pa.array(offset)],
                ["_id", "_piece", "_start", "_length", "_crc", "_sequence", "_offset"],
            )

    return run


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
    size: int = SIZE,
) -> DataFrame:
    """(_id, _piece, _start, _length, _crc, _sequence, _offset): one row per piece.

    A document's tokens are its ids and a closing 0, so null and empty texts make a
    piece of one token.  Documents of more than ``size`` tokens are cut in pieces of ``size``
    with the remainder first.  Repeated rows are packed once each.  Sequences have no gaps:
    a piece begins where another ends, or at 0.  An empty table gives no pieces.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text"))
    pieces = cut(rows.mapInArrow(_pieces(tokenizer or default_tokenizer(), size), _PIECES), "pieces")
    counts = {r["_length"]: r["n"] for r in pieces.groupBy("_length").agg(F.count(F.lit(1)).alias("n")).collect()}
    return _ranked(pieces).mapInArrow(_slots(plan(counts, size)), f"{_PIECES}, _sequence long, _offset long")
