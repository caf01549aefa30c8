"""Exact duplicates by owners in radix tries.

Texts are compared after deleting ASCII white space.  Every input task first folds the texts
it reads in a trie of its own, so a text that fills a third of the table leaves each task as
one row.  The folded rows are dealt by (length, content hash) and sorted by it; each key's
full byte strings go into a trie, whose terminals hold the best row seen: most code
points in the original text, then the smallest id.  Rows arrive by key, so a key's subtree is
complete when the next key begins; it is then written out and freed (the subtree spill), and a
task holds the different texts of one key only.  A hash collision costs a branch in
the trie and never merges two texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from fieldhub.llm.common import WHITE, byte_texts, slices, text_of
from fieldhub.llm.radix_trie import RadixTrie

FOLD_BYTES = 64 << 20  # a task's own trie is passed on when its edges hold this much

_LIGHT = "_id long, _length long, _hash long, _sha string"
_FOLDED = "_length long, _hash long, _key binary, _points long, _best long, _count long"
_OWNERS = "_length long, _hash long, _sha string, _owner long, _group long"


def _normalised(column: pa.Array) -> list[bytes]:
    return [text.translate(None, WHITE) for text in byte_texts(column)]


def _hash(key: bytes) -> int:
    return int.from_bytes(xxhash.xxh64_digest(key), "big", signed=True)


def _light(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, length, hash, sha256) of each row; batch: id, text, code points."""
    for whole in batches:
        for batch in slices(whole, 1):
            keys = _normalised(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(map(len, keys), pa.int64()),
                    pa.array(map(_hash, keys), pa.int64()),
                    pa.array([hashlib.sha256(key).hexdigest() for key in keys], pa.string()),
                ],
                ["_id", "_length", "_hash", "_sha"],
            )


def _rank(points: int, row_id: int | None) -> tuple:
    return (-points, row_id is None, row_id or 0)


def _row_id(rank: tuple) -> int | None:
    return None if rank[1] else rank[2]


def _folded(trie: RadixTrie, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The trie's terminals as rows, some megabytes of them at a time."""
    rows: list[tuple] = []
    held = 0

    def batch() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        names = ["_length", "_hash", "_key", "_points", "_best", "_count"]
        arrays = [pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names)

    for key, rank, count in trie.terminals():
        rows.append((len(key), _hash(key), key, -rank[0], _row_id(rank), count))
        held += len(key)
        if held > most:
            yield batch()
            rows, held = [], 0
    if rows:
        yield batch()


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pre-aggregation: the different texts of a task; batch: id, text, code points."""
    trie = RadixTrie()
    for whole in batches:
        for batch in slices(whole, 1):
            ids, points = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for key, row_id, size in zip(_normalised(batch.column(1)), ids, points, strict=True):
                trie.insert(key, _rank(size, row_id))
            if trie.held > FOLD_BYTES:
                yield from _folded(trie)
                trie = RadixTrie()
    yield from _folded(trie)


def _owned(trie: RadixTrie, key: tuple[int, int]) -> list[tuple]:
    return [
        (*key, hashlib.sha256(text).hexdigest(), _row_id(rank), count)
        for text, rank, count in trie.terminals()
    ]


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Owners of the texts of a partition that is sorted by (length, hash)."""
    trie, current = RadixTrie(), None
    for batch in batches:
        done: list[tuple] = []
        rows = zip(*(column.to_pylist() for column in batch.columns), strict=True)
        for length, hashed, text, points, best, count in rows:
            if current != (length, hashed):
                done += _owned(trie, current) if current else []
                trie, current = RadixTrie(), (length, hashed)
            trie.insert(text, _rank(points, best), count)
        yield _owner_batch(done)
    if current:
        yield _owner_batch(_owned(trie, current))


def _owner_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    arrays = [pa.array(values, kind) for values, kind in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, ["_length", "_hash", "_sha", "_owner", "_group"])


def exact_owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _owner, _group, _kept, _sha) for every row of ``docs``.

    ``_owner`` is the id of the row that stays: the most code points in the original text,
    then the smallest id, a null id last.  ``_group`` counts the rows of equal text, ``_sha``
    is the SHA-256 of the text without white space.  Null and empty texts are equal to each
    other.  Repeated rows with one id are one document: they stay together.  An
    empty table gives an empty table; other columns of ``docs`` are not looked at.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text"),
        F.length(text_of(text_col)).cast("long").alias("_points"),
    )
    owners = (
        rows.mapInArrow(_fold, _FOLDED)
        .repartition("_length", "_hash")
        .sortWithinPartitions("_length", "_hash")
        .mapInArrow(_own, _OWNERS)
    )
    light = rows.mapInArrow(_light, _LIGHT)
    return light.join(owners, ["_length", "_hash", "_sha"]).select(
        "_id", "_owner", "_group", F.col("_id").eqNullSafe(F.col("_owner")).alias("_kept"), "_sha"
    )


class _Kept:
    """Rows that own a text so far: a trie whose owners' ranks end in the place of the row."""

    def __init__(self):
        self.trie = RadixTrie()
        self.batches: list[pa.RecordBatch] = []
        self.held = 0

    def add(self, batch: pa.RecordBatch) -> None:
        """Batch: row, text, id, code points."""
        place = len(self.batches)
        self.batches.append(batch)
        self.held += batch.nbytes
        ids, points = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        for row, (key, row_id, size) in enumerate(zip(_normalised(batch.column(1)), ids, points, strict=True)):
            self.trie.insert(key, (*_rank(size, row_id), place, row))

    def rows(self) -> Iterator[tuple[pa.RecordBatch, list[int], list[int]]]:
        """(rows, lengths, hashes) of the owners, by batch."""
        at: list[list[tuple[int, int, int]]] = [[] for _ in self.batches]
        for key, owner, _ in self.trie.terminals():
            at[owner[-2]].append((owner[-1], len(key), _hash(key)))
        for batch, found in zip(self.batches, at, strict=True):
            if found:
                places, lengths, hashes = zip(*sorted(found), strict=True)
                yield batch.take(pa.array(places, pa.int64())), lengths, hashes


def _fold_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pre-aggregation: of a task's rows those that own a text; batch: row, text, id, code points."""

    def folded() -> Iterator[pa.RecordBatch]:
        for rows, lengths, hashes in kept.rows():
            numbers = [pa.array(lengths, pa.int64()), pa.array(hashes, pa.int64())]
            yield pa.RecordBatch.from_arrays([*rows.columns, *numbers], [*rows.schema.names, "_length", "_hash"])

    kept = _Kept()
    for whole in batches:
        for batch in slices(whole, 1):
            kept.add(batch)
            if kept.held > FOLD_BYTES:
                yield from folded()
                kept = _Kept()
    yield from folded()


def _gathered(batches: list[pa.RecordBatch], most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Small batches joined to batches of some megabytes."""
    part: list[pa.RecordBatch] = []
    held = 0
    for k, batch in enumerate(batches, 1):
        part.append(batch)
        held += batch.nbytes
        if held > most or k == len(batches):
            yield from pa.Table.from_batches(part).combine_chunks().to_batches()
            part, held = [], 0


def _own_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The owners' rows of a partition that is sorted by (length, hash); batch as of ``_fold_rows``."""
    kept, current = _Kept(), None
    for batch in batches:
        keys = list(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True))
        start, row = 0, batch.select(range(4))
        done: list[pa.RecordBatch] = []
        for at in range(1, len(keys) + 1):
            if at < len(keys) and keys[at] == keys[start]:
                continue
            if keys[start] != current:  # the key before is complete
                done += [rows.select(range(2)) for rows, _, _ in kept.rows()]
                kept, current = _Kept(), keys[start]
            kept.add(row.slice(start, at - start))
            start = at
        yield from _gathered(done)
    yield from _gathered([rows.select(range(2)) for rows, _, _ in kept.rows()])


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of the rows of equal text the owner's, with all its columns: one row per different text.

    Owners are those of ``exact_owners``; of rows that are alike in id and code points one
    stays.  The row travels as the payload of its text's terminal, so texts are shuffled once.
    The text column is read as a string; null texts count as empty and stay null.
    """
    others = [c for c in docs.columns if c != text_col]
    row = F.struct(F.lit(True).alias("_"), *(docs[f"`{c}`"].alias(f"c{k}") for k, c in enumerate(others)))
    given = docs.select(
        row.alias("_row"), docs[f"`{text_col}`"].cast("string").alias("_text"), docs[f"`{id_col}`"].cast("long").alias("_id"),
        F.length(text_of(text_col)).cast("long").alias("_points"))
    numbers = [StructField("_length", LongType()), StructField("_hash", LongType())]
    folded = given.mapInArrow(_fold_rows, StructType([*given.schema, *numbers]))
    kept = (
        folded.repartition("_length", "_hash").sortWithinPartitions("_length", "_hash")
        .mapInArrow(_own_rows, given.select("_row", "_text").schema))
    place = {c: k for k, c in enumerate(others)}
    return kept.select(*(
        F.col("_text").alias(c) if c == text_col else F.col(f"_row.c{place[c]}").alias(c) for c in docs.columns))
