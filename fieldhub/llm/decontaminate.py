"""Benchmark decontamination by a generalised suffix automaton of the test items.

The items' words are cut in pieces that overlap by all but one word of a window, the pieces
are dealt to shards of about ``SHARD_WORDS`` words, and each shard's automaton is built in a
task.  Documents are not shuffled: every task streams the words of whole texts through one
shard's automaton after the other, tracking the longest match, and carries spans and item ids
along.  A shard is what is broadcast, so that does not grow with the items; more items are
more passes over the same rows.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from fieldhub.llm.automaton import WindowAutomaton
from fieldhub.llm.common import byte_texts, cut, slices, text_of

WINDOW = 10  # words
SHARD_WORDS = 200_000  # words of one automaton, about; some 60 MB in a worker
PIECE = 20_000  # words of one piece of an item
PASSES = 4  # automata that one stage runs through
PART = 1 << 20  # bytes of a text that are split in words at once
COVERAGE = 0.8  # a document with a larger share of hit words goes as a whole

#: ASCII letters and digits are words, so is everything beyond ASCII; all else parts them
_SPACED = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)
_WORD = re.compile(rb"[^ ]+")


def spaced(text: bytes) -> bytes:
    """The text with A-Z lowered and every other byte outside words a space; same length."""
    return text.translate(_SPACED)


def pieces(text: bytes, most: int = PART) -> Iterator[list[bytes]]:
    """The words of a spaced text, some megabytes at a time."""
    at = 0
    while at < len(text):
        end = len(text) if len(text) - at <= most else text.find(b" ", at + most)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _cut_items(width: int, piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, parts, counts = [], [], []
            for item, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), strict=True):
                words = spaced(text).split()
                for first in range(0, max(len(words) - width + 1, min(len(words), 1)), piece):
                    part = words[first : first + piece + width - 1]
                    items.append(item)
                    parts.append(b" ".join(part))
                    counts.append(len(part))
            yield pa.RecordBatch.from_arrays(
                [pa.array(items, pa.string()), pa.array(parts, pa.binary()), pa.array(counts, pa.int64())],
                ["_item", "_part", "_count"],
            )

    return run


def _built(width: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        items = zip(table.column("_item").to_pylist(), table.column("_part").to_pylist(), strict=True)
        made = WindowAutomaton([(item, part.split()) for item, part in items], width)
        return pa.table({"_shard": [key[0].as_py()], "_automaton": [pickle.dumps(vars(made))]},
                        pa.schema([("_shard", pa.int64()), ("_automaton", pa.binary())]))

    return run


def _unpacked(shared) -> WindowAutomaton:
    made = WindowAutomaton.__new__(WindowAutomaton)
    vars(made).update(pickle.loads(shared.value))
    return made


def automata(
    items: DataFrame, item_col: str = "item_id", text_col: str = "text", width: int = WINDOW,
    shard_words: int = SHARD_WORDS, piece: int = PIECE,
) -> DataFrame:
    """(_shard, _automaton): the items' suffix automata, about ``shard_words`` words each."""
    given = items.select(F.col(item_col).cast("string").alias("_item"), text_of(text_col).alias("_text"))
    parts = cut(given.mapInArrow(_cut_items(width, piece), "_item string, _part binary, _count long"), "items")
    words = parts.agg(F.sum("_count")).first()[0] or 0
    shard = F.pmod(F.xxhash64("_item", "_part"), F.lit(-(-words // shard_words) or 1))
    built = parts.withColumn("_shard", shard).groupBy("_shard").applyInArrow(
        _built(width), "_shard long, _automaton binary")
    return cut(built, "automata")


def _joined(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Union of (start, end, longest match) spans; those that only touch stay apart."""
    out: list[tuple[int, int, int]] = []
    for start, end, longest in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1]), max(longest, out[-1][2])
        else:
            out.append((start, end, longest))
    return out


def _found(automaton: WindowAutomaton, text: bytes) -> tuple[int, list[tuple[int, int, int]], set]:
    """Number of words, (start, end, longest match) spans apart from each other, items."""
    count, spans, items = 0, [], set()

    def counted() -> Iterator[list[bytes]]:
        nonlocal count
        for words in pieces(text):
            count += len(words)
            yield words

    for end, length, names in automaton.matches(counted()):
        items.update(names)
        start, longest = end - length, length
        while spans and start < spans[-1][1]:
            before = spans.pop()
            start, longest = min(start, before[0]), max(longest, before[2])
        spans.append((start, end, longest))
    return count, spans, items


_NUMBERS = pa.list_(pa.int64())
_STATE = [("_words", pa.int64()), ("_starts", _NUMBERS), ("_ends", _NUMBERS), ("_longest", _NUMBERS),
          ("_items", pa.list_(pa.string()))]


def _mark(shared):
    """One shard's spans and items, added to those of the shards before; batch: row, text, state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _unpacked(shared)
        for whole in batches:
            for batch in slices(whole, 1):
                columns: list[list] = [[] for _ in _STATE]
                before = zip(*(batch.column(c).to_pylist() for c in range(3, 7)), strict=True)
                for text, (starts, ends, longest, items) in zip(byte_texts(batch.column(1)), before, strict=True):
                    count, spans, names = _found(automaton, spaced(text))
                    if starts:
                        spans = _joined([*spans, *zip(starts, ends, longest, strict=True)])
                    names.update(items or ())
                    columns[0].append(count)
                    for k in range(3):
                        columns[1 + k].append([span[k] for span in spans])
                    columns[4].append(sorted(name for name in names if name is not None))
                arrays = [pa.array(values, kind) for values, (_, kind) in zip(columns, _STATE, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), *arrays], ["_row", "_text", *(name for name, _ in _STATE)])

    return run


def _marked(docs: DataFrame, carried: Column, text_col: str, built: DataFrame) -> DataFrame:
    """(_row, _text) of ``docs`` with word count, spans and items of all shards."""
    context = docs.sparkSession.sparkContext
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    rows = docs.select(
        carried.alias("_row"), text_of(text_col).alias("_text"), none("long", "_words"),
        *(none("array<long>", name) for name in ("_starts", "_ends", "_longest")), none("array<string>", "_items"))
    shards = sorted(row[0] for row in built.select("_shard").collect())  # numbers only
    blobs = (built.filter(F.col("_shard") == shard).first()["_automaton"] for shard in shards)  # one at a time
    if not shards:
        blobs = [pickle.dumps(vars(WindowAutomaton([], WINDOW)))]
    for number, blob in enumerate(blobs):
        if number and number % PASSES == 0:
            rows = cut(rows, "marked")
        rows = rows.mapInArrow(_mark(context.broadcast(bytes(blob))), rows.schema)
    return rows


def overlap(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """(_id, _words, _hit, _items, _starts, _ends, _longest) for every row of ``docs``.

    ``_starts`` and ``_ends`` are word spans (end excluded) that windows of items cover,
    apart from each other, ``_longest`` the longest run of words that an item shares in each;
    ``_hit`` counts their words; ``_items`` are the ids, as sorted strings, of the items with
    a window in the text.  The id is cast to long.  Null texts and items have no words; items
    without words have no windows; items without an id cover words and are not named; rows
    that share an item id are one item with the windows of both.  Repeated rows of ``docs``
    stay, an empty table of either side is no special case, and other columns are not looked at.
    """
    built = automata(items, item_col, item_text_col, width, shard_words)
    marked = _marked(docs, F.col(id_col).cast("long"), text_col, built)
    lengths = F.zip_with("_starts", "_ends", lambda s, e: e - s)
    hit = F.aggregate(lengths, F.lit(0).cast("long"), lambda a, b: a + b)
    return marked.select(
        F.col("_row").alias("_id"), "_words", hit.alias("_hit"), "_items", "_starts", "_ends", "_longest")


def _removed(least: int, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                clean, kept = [], []
                spans = zip(*(batch.column(c).to_pylist() for c in range(2, 6)), strict=True)
                for text, (words, starts, ends, longest) in zip(byte_texts(batch.column(1)), spans, strict=True):
                    cuts = [(s, e) for s, e, run in zip(starts, ends, longest, strict=True) if run >= least]
                    kept.append(sum(e - s for s, e in cuts) <= coverage * words)
                    clean.append(_without(text, cuts) if cuts and kept[-1] else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(clean, pa.string()), pa.array(kept, pa.bool_())], ["_row", "_clean", "_kept"])

    return run


def _without(text: bytes, cuts: list[tuple[int, int]]) -> str:
    """The text without the word spans ``cuts``, and without what stands between their words."""
    out, at, begin = [], 0, 0
    spans = iter(cuts)
    start, end = next(spans)
    for number, word in enumerate(_WORD.finditer(spaced(text))):
        if number == start:
            begin = word.start()
        if number == end - 1:
            out.append(text[at:begin])
            at = word.end()
            start, end = next(spans, (-1, -1))
    return b"".join([*out, text[at:]]).decode()


def decontaminated(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", width: int = WINDOW, least: int = WINDOW, coverage: float = COVERAGE,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """``docs`` without the spans of test items, with all columns.

    A span goes if its longest shared run has ``least`` words or more; a row goes if such
    spans cover more than ``coverage`` of its words.  Texts without such spans stay as they
    are, null ones too; repeated rows stay.
    """
    built = automata(items, item_col, item_text_col, width, shard_words)
    marked = _marked(docs, F.struct(*(docs[f"`{c}`"].alias(c) for c in docs.columns)), text_col, built).drop("_items")
    kind = StructType([marked.schema["_row"], StructField("_clean", StringType()), StructField("_kept", BooleanType())])
    clean = marked.mapInArrow(_removed(least, coverage), kind).filter("_kept")
    column = lambda c: F.col("_row").getField(c)
    return clean.select(*(
        (F.coalesce("_clean", column(c)) if c == text_col else column(c)).alias(c) for c in docs.columns))
