"""Language-model scores of texts: logistic context mixing of the bits of whole texts.

* The bits of every word are predicted by the context mixer (``mixer.py``) from hashed contexts that reach over the word
  before; their counts and weights come from every use of every training word, each use left out of its own counts.
* How often the text itself had a word before (an adaptive share) joins in while scoring.
* A segment (some sentences, ended by what its last word is) that training texts repeat
  is also predicted from its count, and from the text's own past.

Discounted counts and shares keep a proper distribution, so a text's probability is the product
over its segments.  The counts cover all training texts; the mixer's tables have a fixed size.

Plan: input tasks cut their texts in chunks and write each chunk's different words, segments and heads (class of the word
before, first bytes) as rows, and its texts as numbers of those; counts are one aggregation over these rows.  The mixer
predicts equal bits in equal contexts alike: the rest of a word is worked out once a word and a head once a chunk, however
often they occur.  Counts and bits return to the chunks by a join, and a chunk is scored where its rows
meet.  No table row per token exists.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldhub.llm import mixer
from fieldhub.llm.common import byte_texts, cut, fold, slices, text_of

FOLDS, HELD_OUT = 7, 2
CHUNK = 32 << 20  # bytes of text of a chunk, about
WORD, SEGMENT, TEXT, PAIR = 0, 1, 2, 3  # a pair: class of the word before, and a head
MARK = b" "  # begins a segment's key; words hold no white space
WORD_HALF, SEGMENT_HALF = 400, 20  # items of a text after which 1/4 goes to its own past
LESSON = 20_000  # words and heads that train one set of weights, about; the sets are averaged
SLICES = 64  # parts in which a task's table is summed

_CHUNKS = "chunk long, kind int, idx int, key binary, n long, id long, held boolean, bytes long, body binary"
_CHUNK_SCHEMA = pa.schema([
    ("chunk", pa.int64()), ("kind", pa.int32()), ("idx", pa.int32()), ("key", pa.binary()), ("n", pa.int64()),
    ("id", pa.int64()), ("held", pa.bool_()), ("bytes", pa.int64()), ("body", pa.binary()),
])
_MARKS = mixer.CLASSES << 8 * mixer.HEAD
_SCORES = "_id long, _held boolean, _tokens long, _known long, _base double, _score double, _bytes long"


class _Words(dict):
    """Numbers of words in the order of their first use, and whether a word ends a segment."""

    def __init__(self):
        super().__init__()
        self.ends = bytearray()

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.ends.append(word == mixer.END or (word[-1] in b".!?" and zlib.crc32(word) % 4 == 0))
        return number


def _packed(words: np.ndarray, ends: np.ndarray, segments: list[int]) -> bytes:
    """A text as word numbers (byte planes, as many as the largest needs), segment ends and segment numbers."""
    wide = max(1, (int(words.max(initial=0)).bit_length() + 7) // 8)
    planes = words.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :wide].T
    parts = (np.array([len(words), len(ends), wide], "<u4").tobytes(), planes.tobytes(),
             ends.astype("<u4").tobytes(), np.array(segments, "<u4").tobytes())
    return zlib.compress(b"".join(parts), 1)


def _unpacked(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = zlib.decompress(body)
    n, m, wide = np.frombuffer(raw, "<u4", 3).tolist()
    planes = np.frombuffer(raw, np.uint8, wide * n, 12).reshape(wide, n).astype(np.int64)
    rest = np.frombuffer(raw, "<u4", 2 * m, 12 + wide * n).astype(np.int64)
    words = np.zeros(n, np.int64)
    for plane, digits in enumerate(planes):
        words |= digits << 8 * plane
    return words, rest[:m], rest[m:]


class _Chunk:
    def __init__(self, number: int):
        self.number = number
        self.words, self.segments = _Words(), {}
        self.word_n, self.segment_n = [], []  # training uses, as arrays and numbers
        self.texts: list[tuple] = []
        self.held = 0

    def add(self, row_id: int | None, text: bytes, held: bool) -> None:
        words = text.lower().split()
        words.append(mixer.END)
        numbers = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        ends = np.flatnonzero(np.frombuffer(self.words.ends, np.uint8)[numbers]) + 1
        segments, start = [], 0
        for end in ends.tolist():
            hashed = xxhash.xxh64_digest(b" ".join(words[start:end]))
            segments.append(self.segments.setdefault(hashed, len(self.segments)))
            start = end
        if not held:
            self.word_n.append(numbers)
            self.segment_n += segments
        self.texts.append((row_id, held, len(text), _packed(numbers, ends, segments)))
        self.held += len(text) + 64

    def rows(self) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        word_n = np.bincount(np.concatenate(self.word_n or [none]), minlength=len(self.words))
        segment_n = np.bincount(np.array(self.segment_n, np.int64), minlength=len(self.segments))
        segments = [MARK + hashed for hashed in self.segments]
        pairs, pair_n = self._pairs()
        for kind, keys, n in ((WORD, list(self.words), word_n), (SEGMENT, segments, segment_n), (PAIR, pairs, pair_n)):
            for first in range(0, len(keys), 100_000):
                part = keys[first : first + 100_000]
                yield self._batch(len(part), kind=[kind] * len(part), idx=np.arange(first, first + len(part), dtype=np.int32),
                                  key=part, n=n[first : first + len(part)])
        for first in range(0, len(self.texts), 2_000):
            ids, held, size, body = zip(*self.texts[first : first + 2_000], strict=True)
            yield self._batch(len(ids), kind=[TEXT] * len(ids), id=ids, held=held, bytes=size, body=body)

    def _pairs(self) -> tuple[list[bytes], np.ndarray]:
        """Keys of the training uses' pairs (class of the word before, head) and how many they are; an end's class begins a text."""
        marks = mixer.marks(list(self.words))
        heads, first, head = np.unique(marks // mixer.CLASSES, return_index=True, return_inverse=True)
        n = np.zeros(mixer.CLASSES * len(heads), np.int64)
        for numbers in self.word_n:
            before = np.zeros(len(numbers), np.int64)
            before[1:] = marks[numbers[:-1]] % mixer.CLASSES
            np.add.at(n, before * len(heads) + head[numbers], 1)
        used = np.flatnonzero(n)
        spelled = [mixer.head_of(mark) for mark in marks[first]]
        return [bytes([code // len(heads)]) + spelled[code % len(heads)] for code in used.tolist()], n[used]

    def _batch(self, rows: int, **columns) -> pa.RecordBatch:
        columns["chunk"] = [self.number] * rows
        arrays = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in _CHUNK_SCHEMA]
        return pa.RecordBatch.from_arrays(arrays, schema=_CHUNK_SCHEMA)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks are numbered by task and turn: of a task only one attempt's rows are kept."""
    first, turn = TaskContext.get().partitionId() << 24, 0
    chunk = _Chunk(first)
    for whole in batches:
        for batch in slices(whole, 1):
            rows = zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), batch.column(2).to_pylist(), strict=True)
            for row_id, text, held in rows:
                if chunk.held and chunk.held + len(text) > CHUNK:
                    yield from chunk.rows()
                    turn += 1
                    chunk = _Chunk(first + turn)
                chunk.add(row_id, text, held)
    if chunk.texts:
        yield from chunk.rows()


@dataclass(frozen=True)
class Counts:
    """Totals of a level: all uses, different keys, and the discount of each count."""

    total: int
    kinds: int
    discount: float

    @staticmethod
    def of(row: dict) -> Counts:
        once, twice = row["once"] or 0, row["twice"] or 0
        return Counts(row["total"] or 0, row["kinds"] or 0, once / (once + 2 * twice) if once else 0.5)

    def log2(self, counts: np.ndarray, below: np.ndarray) -> np.ndarray:
        """log2 of the probabilities, given the counts and the next level's log2."""
        if not self.total:
            return below
        rest = np.log2(self.discount * self.kinds / self.total) + below
        with np.errstate(divide="ignore"):
            own = np.log2(np.maximum(counts - self.discount, 0) / self.total)
        return np.logaddexp2(own, rest)


def _adapted(numbers: np.ndarray, static: np.ndarray, half: int) -> np.ndarray:
    """log2 of the probabilities when a share goes to what the text had before.

    The share grows with what came before, from 0 to 1/2, and is 1/4 after ``half`` items.
    """
    order = np.argsort(numbers, kind="stable")
    sorted_ = numbers[order]
    first = np.concatenate(([True], sorted_[1:] != sorted_[:-1]))
    place = np.arange(len(numbers))
    before = np.empty(len(numbers), np.int64)
    before[order] = place - np.maximum.accumulate(np.where(first, place, 0))
    share = 0.5 * place / (place + half)
    with np.errstate(divide="ignore"):
        own = np.log2(share * before / np.maximum(place, 1))
    return np.logaddexp2(np.log2(1 - share) + static, own)


def _totals(counts: DataFrame) -> dict[int, Counts]:
    seen = F.col("c") > 0
    rows = counts.groupBy("kind").agg(
        F.sum("c").alias("total"), F.sum(seen.cast("long")).alias("kinds"),
        F.sum((F.col("c") == 1).cast("long")).alias("once"), F.sum((F.col("c") == 2).cast("long")).alias("twice"),
    ).collect()
    by = {r["kind"]: Counts.of(r.asDict()) for r in rows}
    return {kind: by.get(kind, Counts(0, 0, 0.5)) for kind in (WORD, SEGMENT)}


def _columns(batch: pa.RecordBatch) -> tuple[list[int], list[bytes], list[int]]:
    return tuple(batch.column(name).to_pylist() for name in ("kind", "key", "c"))


def _kinds(kinds: list[int], keys: list[bytes], uses: list[int]) -> Iterator[tuple]:
    """Words, then pairs, as (words or heads, uses, None or classes)."""
    times = np.array(uses, np.float64)
    pair = np.array(kinds) == PAIR
    for here in (np.flatnonzero(~pair), np.flatnonzero(pair)):
        if len(here):
            own = [keys[i] for i in here]
            if pair[here[0]]:
                yield [key[1:] for key in own], times[here], np.array([key[0] for key in own], np.int64)
            else:
                yield own, times[here], None


def _byte_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros(256, np.int64)
    for batch in batches:
        sums += mixer.byte_counts(batch.column(0).to_pylist(), batch.column(1).to_numpy())
    yield pa.RecordBatch.from_arrays([pa.array(range(256), pa.int32()), pa.array(sums)], ["byte", "n"])


def _tables(code: mixer.Code):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((1 << mixer.SLOTS, 2))
        some = False
        for batch in batches:
            for keys, times, classes in _kinds(*_columns(batch)):
                mixer.count(keys, code, table, times, classes)
            some = some or batch.num_rows > 0
        for i, part in enumerate(np.split(table, SLICES)) if some else ():
            yield pa.RecordBatch.from_arrays(
                [pa.array([i], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["slice", "body"])

    return run


def _sum_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the slices that arrive at a task, one row after another; packed, as the driver takes all of them."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            part = np.frombuffer(zlib.decompress(body.as_py()), np.float64)
            sums[i] = sums[i] + part if i in sums else part
    for i, part in sums.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([i], pa.int32()), pa.array([zlib.compress(part.astype(np.float32).tobytes(), 1)], pa.binary())],
            ["slice", "body"])


def _learned(code: mixer.Code, table):
    """Weights and refining counts of a task, as rows (what, place, value, words).

    Every lesson starts from the same weights, so the sums don't depend on how lessons are dealt to tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, refine, words = np.zeros_like(mixer.start_weights()), np.zeros((mixer.GATES * mixer.BINS, 2)), 0
        current, lesson = None, []

        def learn() -> None:
            nonlocal words
            weights = mixer.start_weights()
            for keys, times, classes in _kinds(*zip(*lesson, strict=True)):
                mixer.learn(keys, code, table.value, weights, refine, times, classes, mixer.HEAD if classes is None else 0)
            np.add(sums, weights * len(lesson), out=sums)
            words += len(lesson)

        for batch in batches:
            for number, *row in zip(batch.column("lesson").to_pylist(), *_columns(batch), strict=True):
                if number != current and lesson:
                    learn()
                    lesson = []
                current = number
                lesson.append(row)
        if lesson:
            learn()
        for what, values in ((0, sums.ravel()), (1, refine.ravel())) if words else ():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(values), what, np.int32)), pa.array(np.arange(len(values), dtype=np.int32)),
                 pa.array(values), pa.array(np.full(len(values), words))], ["what", "place", "value", "words"])

    return run


def train_mixer(uses: DataFrame) -> mixer.Mixer:
    """The mixer of the training words and pairs (columns kind, key, c: each once, with its uses).

    Weights learn from the rests of words and from heads; what is used once is predicted as new.
    """
    spark = uses.sparkSession
    sums = np.zeros(256, np.int64)
    for r in uses.filter(F.col("kind") == WORD).select("key", "c").mapInArrow(_byte_counts, "byte int, n long").groupBy("byte").agg(
            F.sum("n").alias("n")).collect():
        sums[r["byte"]] = r["n"]
    code = mixer.huffman(sums)
    table = np.zeros((1 << mixer.SLOTS, 2), np.float32)
    parts = np.split(table, SLICES)
    summed = uses.mapInArrow(_tables(code), "slice int, body binary").repartition(SLICES, "slice").mapInArrow(
        _sum_slices, "slice int, body binary")
    for r in summed.collect():  # the table: of a fixed size
        parts[r["slice"]][:] = np.frombuffer(zlib.decompress(r["body"]), np.float32).reshape(-1, 2)
    shared = spark.sparkContext.broadcast(table)
    lessons = max(1, uses.count() // LESSON)
    dealt = uses.withColumn("turn", F.xxhash64("kind", "key")).withColumn("lesson", F.pmod("turn", F.lit(lessons))).repartition(
        "lesson").sortWithinPartitions("lesson", "turn", "key")
    rows = (
        dealt.select("lesson", "kind", "key", "c").mapInArrow(_learned(code, shared), "what int, place int, value double, words long")
        .groupBy("what", "place").agg(F.sum("value").alias("value"), F.sum("words").alias("words")).collect()
    )
    weights, refine = mixer.start_weights(), np.zeros((mixer.GATES * mixer.BINS, 2))
    for r in rows:  # as many as there are weights and bins
        if r["what"] == 0:
            weights.flat[r["place"]] = r["value"] / r["words"]
        else:
            refine.flat[r["place"]] = r["value"]
    shared.destroy()  # the driver's copy too
    return mixer.Mixer.of(code, table, weights, refine)


def _whole(light: mixer.Mixer, shared) -> mixer.Mixer:
    odds, levels = shared.value
    return replace(light, odds=odds, levels=levels)


def _spelled(light: mixer.Mixer, shared):
    """The rests of words, and each word's head and class in one number; ``light`` is the mixer without its large tables,
    which are broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = _whole(light, shared)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            bits, marks = np.zeros(len(keys), np.float32), np.zeros(len(keys), np.int32)
            here = [i for i, key in enumerate(keys) if key[:1] != MARK]
            words = [keys[i] for i in here]
            bits[here] = whole.log2(words, skip=mixer.HEAD)
            marks[here] = mixer.marks(words)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits), pa.array(marks)],
                                             ["key", "c", "bits", "mark"])

    return run


def _scored(words: Counts, segments: Counts, light: mixer.Mixer, shared):
    def run(key: tuple, texts: pa.Table, units: pa.Table) -> pa.Table:
        at, all_marks = np.divmod(units.column("at").to_numpy(), _MARKS)
        kind, idx = at % 2, at // 2
        counts, bits = units.column("c").to_numpy(), units.column("bits").to_numpy()

        def by_number(of: int, values: np.ndarray) -> np.ndarray:
            here = kind == of
            out = np.zeros(int(here.sum()), values.dtype)
            out[idx[here]] = values[here]
            return out

        word_c, segment_c, rest_bits = by_number(WORD, counts), by_number(SEGMENT, counts), by_number(WORD, bits)
        marks = by_number(WORD, all_marks)
        classes = marks % mixer.CLASSES
        heads, head = np.unique(marks // mixer.CLASSES, return_inverse=True)

        def pairs(numbers: np.ndarray) -> np.ndarray:
            before = np.zeros(len(numbers), np.int64)
            before[1:] = classes[numbers[:-1]]
            return before * len(heads) + head[numbers]

        bodies = texts.column("body").to_pylist()
        head_bits = np.zeros(mixer.CLASSES * len(heads), np.float32)
        for body in bodies:
            head_bits[pairs(_unpacked(body)[0])] = 1
        used = np.flatnonzero(head_bits)
        spelled = [mixer.head_of(own * mixer.CLASSES) for own in heads]
        head_bits[used] = _whole(light, shared).log2([spelled[i] for i in used % len(heads)], used // len(heads))
        base = np.log10((word_c + 1) / (words.total + words.kinds + 1))
        rows = []
        for row_id, held, size, body in zip(*(texts.column(n).to_pylist() for n in ("id", "held", "bytes")), bodies, strict=True):
            numbers, ends, own = _unpacked(body)
            static = rest_bits[numbers].astype(np.float64) + head_bits[pairs(numbers)]
            below = np.add.reduceat(_adapted(numbers, static, WORD_HALF), np.concatenate(([0], ends[:-1])))
            score = _adapted(own, segments.log2(segment_c[own], below), SEGMENT_HALF).sum() * np.log10(2)
            rows.append((row_id, held, len(numbers), int((word_c[numbers] > 0).sum()), float(base[numbers].sum()), float(score), size))
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
        names = ["_id", "_held", "_tokens", "_known", "_base", "_score", "_bytes"]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _held, _tokens, _known, _train, _base, _score, _bytes) for every row of ``docs``.

    The model learns from the rows whose id's crc32 modulo FOLDS isn't HELD_OUT.  ``_score`` and
    ``_base`` are log10 probabilities of the text's words and its end by the model and by
    add-one word counts; bits per byte are -_score * log2(10) / _bytes.  Null and empty texts have the end
    only.  Without any training text every word is spelled by an untrained mixer, and ``_base`` is 0.
    Repeated rows are scored alike, and counted as often as they are there.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text"),
                       (fold(id_col, FOLDS) == HELD_OUT).alias("_held"))
    chunks = cut(rows.mapInArrow(_chunks, _CHUNKS), "chunks")
    units = chunks.filter(F.col("kind") != TEXT).select("chunk", "kind", "idx", "key", "n")
    counts = cut(units.groupBy("key", "kind").agg(F.sum("n").alias("c")), "counts")
    totals = _totals(counts)
    trained = train_mixer(counts.filter((F.col("kind") != SEGMENT) & (F.col("c") > 0)).select("kind", "key", "c"))
    shared = docs.sparkSession.sparkContext.broadcast((trained.odds, trained.levels))  # 2^SLOTS numbers
    light = replace(trained, odds=np.zeros(0, np.float32), levels=np.zeros(0, np.uint8))
    del trained
    spelled = counts.filter(F.col("kind") < TEXT).select("key", "c").mapInArrow(
        _spelled(light, shared), "key binary, c long, bits float, mark int")
    found = units.filter(F.col("kind") < TEXT).select("chunk", (F.col("idx") * 2 + F.col("kind")).alias("at"), "key").join(
        spelled, "key").select("chunk", (F.col("at").cast("long") * _MARKS + F.col("mark")).alias("at"), "c", "bits")
    texts = chunks.filter(F.col("kind") == TEXT).select(F.col("chunk").alias("of"), "id", "held", "bytes", "body")
    scored = texts.groupBy("of").cogroup(found.groupBy("chunk")).applyInArrow(
        _scored(totals[WORD], totals[SEGMENT], light, shared), _SCORES)
    return scored.withColumn("_train", F.lit(totals[WORD].total).cast("long"))
