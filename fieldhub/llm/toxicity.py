"""Toxicity by a convolutional text classifier, trained in numpy.

Words (lower case, without ASCII punctuation) get the sum of two hashed embeddings, one of
the word and one of its first bytes, so forms of a word share a part.  Filters
over one, two and three words slide over the whole text, each filter's highest activation is
kept, and a logistic layer turns these maxima into a score.  The network is trained with Adam on all
labelled rows but a part that is kept aside to place the scores: clean and toxic rows meet at a score
of 0.7, and per language a threshold is set that lets through at most ``CLEAN_FLAGGED`` of the clean rows.

Rows are dealt by hash into lessons.  Each lesson starts from one network, whose embeddings know how often
every hash is found in toxic and clean texts of all lessons, and the lessons' networks are averaged by their rows.
The rows kept aside meet as counts per rounded output, so thresholds come from all of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from fieldhub.llm.common import byte_texts, cut, slices, text_of
from fieldhub.llm.labels import known_labels, maybe_known

MOST_TASKS = 1_024  # that lessons are dealt to
LESSON = 8_000  # rows that train one network, about; the networks are averaged
SLICES = 16  # parts in which a task's numbers are summed
ROUND = 1_000  # outputs are told apart by a thousandth where scores are placed
FAR = 40  # and up to this
BITS = 16  # of a hash
BEGIN = 4  # bytes of a word's beginning
DIMENSION = 16
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 6
BATCH_WORDS = 40_000
SURE = 8  # standard errors from which an embedding's log odds are taken whole
ASIDE = 5  # a fifth of the rows calibrates
MARK = 0.7  # score at which a text counts as toxic
CLEAN_FLAGGED = 0.002

_MARKS = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))
_LOW = np.uint32((1 << BITS) - 1)
_PAD = 2 << BITS  # row of zeros after the embeddings
_STEP = 1 << 17  # words that are convolved at once
_CODED = [StructField("_lang", StringType()), StructField("_codes", BinaryType())]


def word_codes(text: bytes) -> np.ndarray:
    """For each word the hash of the word in the low and of its beginning in the high bits."""
    words = text.lower().translate(_MARKS).split()
    whole = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    begin = np.fromiter((zlib.crc32(word[:BEGIN]) for word in words), np.uint32, len(words))
    return whole & _LOW | begin << np.uint32(BITS)


def _indexes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the embeddings of both hashes: words first, then beginnings."""
    return (codes & _LOW).astype(np.int64), (codes >> np.uint32(BITS)).astype(np.int64) + (1 << BITS)


@dataclass
class Network:
    embeddings: np.ndarray
    filters: np.ndarray  # (offsets of all widths * FILTERS), see _columns
    bias: np.ndarray
    out: np.ndarray
    shift: float
    slope: float = 1.0  # calibration of the last layer's logit
    centre: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    @staticmethod
    def fresh(seed: int = 11) -> Network:
        draw = np.random.default_rng(seed)
        embeddings = draw.normal(0, 0.1, (_PAD + 1, DIMENSION)).astype(np.float32)
        embeddings[_PAD] = 0
        filters = draw.normal(0, 0.3, (DIMENSION, sum(WIDTHS) * FILTERS)).astype(np.float32)
        features = len(WIDTHS) * FILTERS
        return Network(embeddings, filters, np.zeros(features, np.float32),
                       draw.normal(0, 0.1, features).astype(np.float32), 0.0)

    def numbers(self) -> np.ndarray:
        """All trained numbers in one row."""
        parts = (self.embeddings, self.filters, self.bias, self.out, np.array([self.shift]))
        return np.concatenate([np.asarray(part, np.float64).ravel() for part in parts])

    def of_numbers(self, numbers: np.ndarray) -> Network:
        ends = np.cumsum([self.embeddings.size, self.filters.size, self.bias.size, self.out.size])
        embeddings, filters, bias, out, shift = np.split(numbers.astype(np.float32), ends)
        return replace(self, embeddings=embeddings.reshape(self.embeddings.shape),
                       filters=filters.reshape(self.filters.shape), bias=bias, out=out, shift=float(shift[0]))

    def activations(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """(filter, position): outputs along a padded word sequence, before the bias."""
        summed = self.embeddings.take(low, axis=0)
        summed += self.embeddings.take(high, axis=0)
        parts = self.filters.T @ summed.T
        n, at, found = len(low) - max(WIDTHS) + 1, 0, []
        for width in WIDTHS:
            own = parts[at : at + FILTERS, :n].copy()
            for k in range(1, width):
                own += parts[at + k * FILTERS : at + (k + 1) * FILTERS, k : k + n]
            at += width * FILTERS
            found.append(own)
        return np.concatenate(found)

    def pooled(self, codes: np.ndarray) -> np.ndarray:
        """Highest output of each filter over a whole text, some words at a time."""
        best = np.full(len(WIDTHS) * FILTERS, -np.inf, np.float32)
        rest = max(WIDTHS) - 1
        for first in range(0, max(1, len(codes)), _STEP):
            part = codes[first : first + _STEP + rest]
            low, high = _padded([part], 0 if first + _STEP + rest <= len(codes) else rest)
            best = np.maximum(best, self.activations(low, high).max(axis=1))
        return best

    def many(self, texts: list[np.ndarray]) -> np.ndarray:
        """Last layer's logit of each text."""
        if not texts:
            return np.zeros(0)
        rest = max(WIDTHS) - 1
        pooled = np.empty((len(texts), len(WIDTHS) * FILTERS), np.float32)
        held: list[int] = []

        def flush() -> None:
            if held:
                low, high = _padded([texts[i] for i in held], rest)
                starts = np.cumsum([0] + [len(texts[i]) + rest for i in held[:-1]])
                out = self.activations(low, high)
                pooled[held] = np.maximum.reduceat(out, starts, axis=1).T
                held.clear()

        words = 0
        for i, codes in enumerate(texts):
            if len(codes) > _STEP // 4:
                pooled[i] = self.pooled(codes)
                continue
            held.append(i)
            words += len(codes) + rest
            if words > _STEP:
                flush()
                words = 0
        flush()
        return np.maximum(pooled + self.bias, 0) @ self.out + self.shift

    def scores(self, texts: list[bytes]) -> np.ndarray:
        logits = self.many([word_codes(text) for text in texts])
        return self.placed(logits)

    def placed(self, logits: np.ndarray) -> np.ndarray:
        """Scores: the calibrated centre is at MARK."""
        at = np.log(MARK / (1 - MARK))
        return 1 / (1 + np.exp(-np.clip(self.slope * (logits - self.centre) + at, -50, 50)))


def _padded(texts: list[np.ndarray], rest: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of both embeddings, each text followed by ``rest`` rows of padding and the
    last one by enough for a position."""
    low, high, pad = [], [], np.full(rest, _PAD, np.int64)
    for codes in texts:
        word, begin = _indexes(codes)
        low += [word, pad]
        high += [begin, pad]
    short = max(0, max(WIDTHS) - sum(map(len, low)))
    tail = np.full(max(short, max(WIDTHS) - 1 if rest else 0), _PAD, np.int64)
    return np.concatenate([*low, tail]), np.concatenate([*high, tail])


class _Adam:
    def __init__(self, value: np.ndarray, rate: float):
        self.value, self.rate = value, rate
        self.first, self.second, self.turn = np.zeros_like(value), np.zeros_like(value), 0

    def step(self, slope: np.ndarray) -> None:
        self.turn += 1
        self.first += 0.1 * (slope - self.first)
        self.second += 0.001 * (slope * slope - self.second)
        scaled = self.first / (1 - 0.9**self.turn)
        self.value -= self.rate * scaled / (np.sqrt(self.second / (1 - 0.999**self.turn)) + 1e-8)


def _found(codes: list[bytes], labels: list[int], seen: np.ndarray) -> None:
    """Add to ``seen`` (label, hash) the texts that a hash is found in."""
    for body, label in zip(codes, labels, strict=True):
        for index in _indexes(np.frombuffer(body, "<u4")):
            seen[label, np.unique(index)] += 1


def _seed(net: Network, seen: np.ndarray, rows: np.ndarray) -> None:
    """Start the first coordinate of an embedding at the log odds of finding it in a toxic
    text, shrunk to 0 where it may be chance."""
    many = np.maximum(1, rows)[:, None]
    overall = seen.sum(axis=0) / many.sum()
    share = (seen + overall) / (many + 1)
    odds = np.log(np.maximum(share[1], 1e-9) / np.maximum(share[0], 1e-9))
    error = np.sqrt(np.maximum(overall * (1 - overall), 1e-9) * (1 / many).sum())
    trust = np.minimum(1, (np.abs(share[1] - share[0]) / error / SURE) ** 2)
    net.embeddings[:_PAD, 0] = np.clip(odds * trust, -4, 4) / 2


def _learn(net: Network, texts: list[np.ndarray], labels: np.ndarray, rows: np.ndarray, epochs: int) -> None:
    """Gradient steps on batches of texts; gradients flow through the pooled positions only.

    ``rows`` has the rows of both classes in all lessons: together a class weighs half.
    """
    draw, rest = np.random.default_rng(5), max(WIDTHS) - 1
    weight = 0.5 * rows.sum() / np.maximum(1, rows)[labels]
    tables = [_Adam(net.filters, 0.01), _Adam(net.bias, 0.01), _Adam(net.out, 0.01)]
    shift = _Adam(np.zeros(1, np.float32), 0.01)
    for _ in range(epochs):
        order = draw.permutation(len(texts))
        ends = np.cumsum([len(texts[i]) + rest for i in order])
        for group in np.split(order, np.flatnonzero(np.diff(ends // BATCH_WORDS)) + 1):
            low, high = _padded([texts[i] for i in group], rest)
            sizes = np.array([len(texts[i]) + rest for i in group])
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            out = net.activations(low, high)
            where = np.array([
                start + out[:, start : start + size].argmax(axis=1)
                for start, size in zip(starts, sizes, strict=True)
            ])
            best = out[np.arange(out.shape[0]), where]
            raised = best + net.bias
            live = raised > 0
            hidden = np.where(live, raised, 0)
            logit = hidden @ net.out + shift.value[0]
            delta = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[group]) * weight[group] / len(group)
            back = (delta[:, None] * net.out) * live
            grads = np.zeros_like(net.filters)
            touched = []
            for f in range(best.shape[1]):
                g = back[:, f].astype(np.float32)
                first = sum(width * FILTERS for width in WIDTHS[: f // FILTERS]) + f % FILTERS
                for k in range(WIDTHS[f // FILTERS]):
                    column = first + k * FILTERS
                    i, j = low[where[:, f] + k], high[where[:, f] + k]
                    grads[:, column] += (net.embeddings[i] + net.embeddings[j]).T @ g
                    pull = g[:, None] * net.filters[:, column]
                    touched += [(i, pull), (j, pull)]
            rows = np.concatenate([r for r, _ in touched])
            pulls = np.concatenate([p for _, p in touched])
            tables[1].step(back.sum(axis=0).astype(np.float32))
            tables[2].step((hidden * delta[:, None]).sum(axis=0).astype(np.float32))
            shift.step(np.array([delta.sum()], np.float32))
            tables[0].step(grads)
            own, inverse = np.unique(rows, return_inverse=True)
            total = np.zeros((len(own), DIMENSION), np.float32)
            np.add.at(total, inverse, pulls)
            net.embeddings[own] -= 0.02 * total
            net.embeddings[_PAD] = 0
    net.shift = float(shift.value[0])


def _sliced(numbers: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i, part in enumerate(np.array_split(numbers, SLICES)):
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["slice", "body"])


def _sum_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            part = np.frombuffer(body.as_py(), np.float64)
            sums[i] = sums[i] + part if i in sums else part
    for i, part in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["slice", "body"])


def _summed(rows: DataFrame, run: Callable) -> np.ndarray:
    """The sum of the numbers that ``run`` gives for each task: of a fixed size."""
    kind = "slice int, body binary"
    parts = rows.mapInArrow(run, kind).repartition(SLICES, "slice").mapInArrow(_sum_slices, kind).collect()
    return np.concatenate([np.frombuffer(r["body"], np.float64) for r in sorted(parts, key=lambda r: r["slice"])])


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros((2, _PAD))
    for batch in batches:
        _found(batch.column(0).to_pylist(), batch.column(1).to_pylist(), seen)
    if seen.any():
        yield from _sliced(seen.ravel())


def _lessons(start, rows: np.ndarray, epochs: int):
    """Sum of the lessons' moves from their start, each times its rows; the last number is that of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, current, texts, labels = None, None, [], []

        def learn() -> None:
            nonlocal sums
            net = Network.fresh().of_numbers(start.value)
            _learn(net, texts, np.array(labels, dtype=int), rows, epochs)
            found = np.append(net.numbers() - start.value, 1.0) * len(texts)
            sums = found if sums is None else sums + found

        for batch in batches:
            for lesson, body, label in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if lesson != current and texts:
                    learn()
                    texts, labels = [], []
                current = lesson
                texts.append(np.frombuffer(body, "<u4"))
                labels.append(label)
        if texts:
            learn()
        if sums is not None:
            yield from _sliced(sums)

    return run


def _outputs(net):
    """Rounded outputs of the last layer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logits = net.value.many([np.frombuffer(body, "<u4") for body in batch.column(0).to_pylist()])
            at = np.round(np.clip(logits, -FAR, FAR) * ROUND).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(at)], ["_label", "_lang", "_at"])

    return run


def place(net: Network, label: np.ndarray, lang: np.ndarray, logits: np.ndarray, many: np.ndarray) -> None:
    """Set where scores lie, from the numbers of rows by label, language and output."""
    edges, at = np.unique(logits, return_inverse=True)
    clean, toxic = (np.bincount(at[label == k], many[label == k], len(edges)) for k in (0, 1))
    middles = np.concatenate(([edges[0] - 1], (edges[1:] + edges[:-1]) / 2))
    below = lambda seen: np.concatenate(([0], np.cumsum(seen)[:-1])) / seen.sum()
    wrong = 1 - below(clean) + below(toxic)
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    net.centre = float(middles[best[len(best) // 2]])
    for own in sorted(set(lang.tolist())):
        here = (lang == own) & (label == 0)
        order = np.argsort(-logits[here], kind="stable")
        over = np.cumsum(many[here][order])  # clean rows from the highest output down
        if not len(order):
            net.thresholds[own] = MARK
            continue
        allowed = int(over[-1] * CLEAN_FLAGGED)
        highest = logits[here][order][np.searchsorted(over, allowed, side="right")]
        net.thresholds[own] = max(MARK / 2, float(net.placed(np.array([highest]))[0]))


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, 1):
            found = pa.array([word_codes(t).astype("<u4").tobytes() for t in byte_texts(batch.column(1))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), found], ["_of_doc", "_lang", "_codes"])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id",
          text_col: str = "text", lang_col: str = "lang", epochs: int = EPOCHS) -> Network:
    """Fit on all labelled rows of the training folds; languages place thresholds and nothing else.

    Without rows of both classes all texts score 0.
    """
    context, net = docs.sparkSession.sparkContext, Network.fresh()
    known = known_labels(labels, label_col, id_col)
    rows = maybe_known(docs, known, id_col).select(
        F.col(id_col).alias("_of_doc"), text_of(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
    found = rows.mapInArrow(_codes, StructType([rows.schema["_of_doc"], *_CODED]))
    # always merged: a broadcast of the labels would end at some size, and what moves is only rows that are kept
    coded = cut(found.join(known.hint("merge"), F.col("_of_doc") == F.col("_of")).select(
        F.col("_of_doc").cast("long").alias("_id"), "_label", F.coalesce("_lang", F.lit("")).alias("_lang"), "_codes",
    ).withColumn("_turn", F.xxhash64("_id", "_codes")), "toxicity")
    kept = F.pmod(F.col("_turn"), F.lit(ASIDE)) == ASIDE - 1
    counts = {(r["kept"], r["_label"]): r["n"] for r in coded.groupBy(kept.alias("kept"), "_label").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    if any(not sum(counts.get((k, label), 0) for k in (True, False)) for label in (0, 1)):
        net.out[:] = 0
        net.shift = -50.0
        return net
    if len(counts) == 4:
        learnt, aside = coded.filter(~kept), coded.filter(kept)
        many = np.array([counts[False, 0], counts[False, 1]])
    else:  # too few to keep some aside
        learnt = aside = coded
        many = np.array([sum(counts.get((k, label), 0) for k in (True, False)) for label in (0, 1)])
    _seed(net, _summed(learnt.select("_codes", "_label"), _seen).reshape(2, _PAD), many)
    start = context.broadcast(net.numbers())  # of a fixed size, as the trained network
    lessons = max(1, round(int(many.sum()) / LESSON))
    dealt = learnt.withColumn("_lesson", F.pmod(F.shiftright("_turn", 16), F.lit(lessons))).repartition(
        min(lessons, MOST_TASKS), "_lesson").sortWithinPartitions("_lesson", "_turn", "_id", "_label")
    sums = _summed(dealt.select("_lesson", "_codes", "_label"), _lessons(start, many, epochs))
    net = net.of_numbers(start.value + sums[:-1] / sums[-1])
    start.unpersist()
    shared = context.broadcast(net)
    found = aside.select("_codes", "_label", "_lang").mapInArrow(_outputs(shared), "_label int, _lang string, _at int").groupBy(
        "_label", "_lang", "_at").agg(F.count(F.lit(1)).alias("n")).collect()  # as many as rounded outputs by language
    shared.unpersist()
    found.sort()
    label, lang, at, n = (np.array(column) for column in zip(*found, strict=True))
    place(net, label, lang, at / ROUND, n)
    return net


def _scored(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                scores = net.scores(byte_texts(batch.column(1)))
                over = [net.thresholds.get(lang or "", MARK) for lang in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(scores, pa.float64()), pa.array(scores > np.array(over))],
                    ["_id", "_score", "_flagged"],
                )

    return run


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang") -> DataFrame:
    """(_id, _score, _flagged) for every row of ``docs``.

    ``_flagged`` says that the score is over the threshold of the row's language; the score
    itself does not look at the language.  Null texts score as empty ones, a null or unseen language
    takes the common mark.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text"),
        F.col(lang_col).cast("string").alias("_lang"),
    )
    return rows.mapInArrow(_scored(net), "_id long, _score double, _flagged boolean")
