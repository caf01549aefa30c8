"""Quality scores by Bradley-Terry ranking on text statistics.

A document's strength is a weighted sum of text statistics; that a document is preferred to
another has the probability sigmoid(strength difference).  Preference pairs join a good
and a poor document of a bounded labelled sample; the weights minimise the logistic loss on feature
differences.  The cut is the quantile of the sample's strengths at its share of poor
documents, and the score is sigmoid(strength - cut), so documents under the quantile score
under 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldhub.llm.common import byte_texts, slices, text_of
from fieldhub.llm.labels import labelled_sample

SAMPLE = 8_000  # labelled rows of a class that are fitted on, at most
PAIRS = 60_000  # preference pairs, at most
PENALTY = 1e-3

_LOWER, _UPPER, _DIGIT = range(97, 123), range(65, 91), range(48, 58)
_SPACE = (32, *range(9, 14))
_SINGLE = b"|!?.,:;%$#&*@<>{}[]()/\\=_-\"'"  # each with a share of its own

NAMES = (
    "lower", "upper", "digit", "space", "beyond", *(chr(c) for c in _SINGLE),
    "words", "word_length", "longest_word", "variety", "line_words", "repeated_lines", "busiest_line",
    "capital_words", "edge_marks", "repeated_words", "entropy",
)


def features(text: bytes) -> np.ndarray:
    """Statistics of a whole text; all zero for an empty one."""
    out = np.zeros(len(NAMES))
    if not text:
        return out
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    total = len(text)
    words = text.split()
    n = max(1, len(words))
    lines = [line for line in text.split(b"\n") if line]
    different = set(lines)
    kinds = set(words)
    solid = max(1, total - int(seen[list(_SPACE)].sum()))
    share = seen[seen > 0] / total
    roots = [seen[list(_LOWER)].sum(), seen[list(_UPPER)].sum(), seen[list(_DIGIT)].sum(),
             seen[list(_SPACE)].sum(), seen[128:].sum(), *(seen[c] for c in _SINGLE)]
    out[: len(roots)] = np.sqrt(np.array(roots) / total)
    marks = sum(1 for word in kinds if not word[-1:].isalpha() and word[-1] < 128)
    capitals = sum(1 for word in kinds if word.isupper())
    out[len(roots) :] = (
        np.log1p(n), np.log1p(solid / n), np.log1p(max(map(len, kinds), default=0)),
        np.log1p(len(kinds)) / np.log1p(n), np.log1p(n / max(1, len(lines))),
        1 - len(different) / max(1, len(lines)),
        max(map(len, different), default=0) / total,
        capitals / max(1, len(kinds)), marks / max(1, len(kinds)),
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        float(-(share * np.log(share)).sum()),
    )
    return out


@dataclass(frozen=True)
class Ranking:
    """Strength of a text: weights times standardised statistics, less the cut."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def strengths(self, statistics: np.ndarray) -> np.ndarray:
        return self._scaled(statistics) @ self.weights - self.cut

    def _scaled(self, statistics: np.ndarray) -> np.ndarray:
        return np.clip((statistics - self.mean) / self.scale, -5, 5)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        strengths = self.strengths(np.array([features(text) for text in texts]))
        return 1 / (1 + np.exp(-np.clip(strengths, -50, 50)))


def _bradley_terry(good: np.ndarray, poor: np.ndarray) -> np.ndarray:
    """Weights that maximise the likelihood of the preferences, by Newton steps."""
    draw = np.random.default_rng(7)
    pairs = max(len(good), len(poor), PAIRS)
    gaps = good[draw.integers(len(good), size=pairs)] - poor[draw.integers(len(poor), size=pairs)]
    weights = np.zeros(gaps.shape[1])
    for _ in range(50):
        wins = 1 / (1 + np.exp(-np.clip(gaps @ weights, -30, 30)))
        slope = PENALTY * weights - gaps.T @ (1 - wins) / pairs
        bend = (gaps * (wins * (1 - wins))[:, None]).T @ gaps / pairs
        step = np.linalg.solve(bend + PENALTY * np.eye(len(weights)), slope)
        weights -= step
        if np.abs(step).max() < 1e-7:
            break
    return weights


def fit(statistics: np.ndarray, labels: np.ndarray, counts: dict[int, int]) -> Ranking:
    """Ranking from a sample; ``counts`` has the number of all training rows by label.

    Without rows of both classes nothing can be preferred: every text then scores 0.5.
    """
    mean = statistics.mean(axis=0) if len(labels) else np.zeros(len(NAMES))
    scale = statistics.std(axis=0) + 1e-6 if len(labels) else np.ones(len(NAMES))
    flat = Ranking(mean, scale, np.zeros(len(NAMES)), 0.0)
    if len(set(labels.tolist())) < 2:
        return flat
    scaled = flat._scaled(statistics)
    weights = _bradley_terry(scaled[labels == 1], scaled[labels == 0])
    strengths = scaled @ weights
    order = np.argsort(strengths, kind="stable")
    each = np.where(labels == 1, counts[1] / (labels == 1).sum(), counts[0] / (labels == 0).sum())
    share = np.cumsum(each[order]) / each.sum()
    under = int((share <= counts[0] / (counts[0] + counts[1]) + 1e-9).sum())
    under = min(max(under, 1), len(order) - 1)
    return Ranking(mean, scale, weights, float(strengths[order[under - 1 : under + 1]].mean()))


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, 1):
            found = pa.array([features(t).tolist() for t in byte_texts(batch.column(1))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), found], ["_id", "_label", "_statistics"]
            )


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
          text_col: str = "text") -> Ranking:
    sample = labelled_sample(docs, labels, label_col, SAMPLE, id_col, text_col)
    rows = sample.rows.select(F.col("_id").cast("long").alias("_id"), text_of("_text"), "_label").mapInArrow(
        _statistics, "_id long, _label int, _statistics array<double>"
    ).collect()
    rows.sort(key=lambda r: (r["_id"], r["_statistics"]))
    statistics = np.array([r["_statistics"] for r in rows]).reshape(len(rows), len(NAMES))
    return fit(statistics, np.array([r["_label"] for r in rows], dtype=int), sample.counts)


def _scored(ranking: Ranking):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                scores = pa.array(ranking.scores(byte_texts(batch.column(1))), pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(0), scores], ["_id", "_score"])

    return run


def score(docs: DataFrame, ranking: Ranking, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _score) for every row of ``docs``; null texts score as empty ones."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text"))
    return rows.mapInArrow(_scored(ranking), "_id long, _score double")


def keep_good(docs: DataFrame, ranking: Ranking, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score 0.5 or more, with all their columns; one pass, no shuffle."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, at):
                good = ranking.scores(byte_texts(batch.column(at).cast(pa.string()))) >= 0.5
                yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
