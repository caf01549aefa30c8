"""Spelling variants: words one edit apart, found by dynamic programming down sorted lists.

Two words one edit apart, the shorter of m code points, agree on their first or on their
last half.  So a word is dealt, for each m that it can take part in, to one list per half.
Lists of more than ``LIST`` words are dealt again by halves of what is not yet equal, until
one code point is left; a list then has at most an alphabet's words of either length, and
no word is left out.  A pair belongs to exactly one list: to the one of the first halves where
those agree, to the other elsewhere.

A list is sorted (from the end, where ends agree), and every word of it is compared with those
behind it by a banded edit matrix of three cells a row.  Neighbours in the list share the rows of
their common prefix, so a scan computes only the rows behind it; where a row
leaves no cell within one edit, all words with that prefix are skipped at once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldhub.llm.common import byte_texts, cut, slices, text_of

LEAST = 7  # code points of a word
OFTEN = 2  # occurrences of a word
FACTOR = 10  # a form is at least so many times as frequent
SLIP = 31  # one in so many (document, word) pairs loses a code point
LIST = 256  # a longer list is dealt once more
HELD = 300_000  # different words that a task counts before it passes them on

PART = 4 << 20  # bytes of a text that are searched at once

_RUN = re.compile(f"[a-zÀ-ÿ]{{{LEAST},}}")
_APART = re.compile(rb"[\x00-\x60\x7B-\x7F]")


def runs(text: bytes) -> Iterator[list[str]]:
    """The letter runs of at least ``LEAST`` code points, A-Z lowered, some megabytes at a time."""
    text, at = text.lower(), 0
    while at < len(text):
        apart = _APART.search(text, at + PART) if len(text) - at > PART else None
        end = apart.start() if apart else len(text)
        yield _RUN.findall(text[at:end].decode())
        at = end


def slipped(doc_id: str, run: str) -> str:
    """The run as it counts: one (document, run) pair in ``SLIP`` loses a code point."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    at = h % len(run)
    return run if h % SLIP else run[:at] + run[at + 1 :]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and counts of a task; batch: id, text."""
    counts: Counter[str] = Counter()

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["_word", "_n"])

    for whole in batches:
        for part in slices(whole, 1):
            ids = part.column(0).to_pylist()
            for doc_id, text in zip(ids, byte_texts(part.column(1)), strict=True):
                for found in runs(text):
                    for run, n in Counter(found).items():
                        word = slipped(doc_id, run)
                        if len(word) >= LEAST:
                            counts[word] += n
                    if len(counts) > HELD:
                        yield batch()
                        counts.clear()
    yield batch()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_word, _n): the words of all texts with their occurrences."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(key.alias("_id"), text_of(text_col).alias("_text"))
    counts = rows.mapInArrow(_counted, "_word string, _n long")
    return counts.groupBy("_word").agg(F.sum("_n").alias("_n")).filter(F.col("_n") >= OFTEN)


_LIST = ["_least", "_front", "_back", "_ends", "_path", "_name"]


def _dealt(members: DataFrame) -> DataFrame:
    """Each member once per half of what is not yet equal; the list's name is what then is.

    ``_front`` and ``_back`` count equal code points.  ``_path`` keeps the first halves of the lists of
    ends on the way: pairs that agree there belong to the other list.
    """
    front, back, least = F.col("_front"), F.col("_back"), F.col("_least")
    half = F.ceil((least - front - back) / 2).cast("int")
    lists = F.array(
        F.struct((front + half).alias("front"), back.alias("back"), F.lit(False).alias("ends"), F.col("_path").alias("path")),
        F.struct(front.alias("front"), (least - front - half).alias("back"), F.lit(True).alias("ends"),
                 F.concat("_path", F.array(F.struct(front.alias("at"), (front + half).alias("to")))).alias("path")),
    )
    met = members.select("_word", "_n", "_least", F.explode(lists).alias("l"))
    name = F.concat(F.expr("left(_word, l.front)"), F.lit("-"), F.expr("right(_word, l.back)"))
    return met.select(
        "_word", "_n", "_least", F.col("l.front").alias("_front"), F.col("l.back").alias("_back"),
        F.col("l.ends").alias("_ends"), F.col("l.path").alias("_path"), name.alias("_name"))


def _row(query: str, above: tuple[int, int, int], depth: int, letter: str) -> tuple[int, int, int]:
    """Row ``depth`` of the edit matrix: its cells of ``depth`` - 1, ``depth`` and ``depth`` + 1
    letters of the query, from those of the row before; cells off the query count 2."""
    size = len(query)
    left, middle, right = above
    low = at = high = 2
    if depth - 1 <= size:
        low = middle + 1
        if depth >= 2:
            low = min(low, left + (query[depth - 2] != letter))
    if depth <= size:
        at = min(middle + (query[depth - 1] != letter), right + 1, low + 1)
    if depth < size:
        high = min(right + (query[depth] != letter), at + 1)
    return low, at, high


def near_pairs(words: list[str]) -> Iterator[tuple[int, int]]:
    """(i, j), i < j: the words of a sorted list that are exactly one edit apart."""
    shared = [0] + [len(commonprefix(pair)) for pair in pairwise(words)]
    for i, query in enumerate(words):
        size = len(query)
        rows = [(2, 0, 1), *[(1, 0, 1)] * (size - 1), (1, 0, 2)]  # of the query itself
        j = i + 1
        while j < len(words):
            word = words[j]
            del rows[shared[j] + 1 :]  # the word examined last shares the rows up to here
            while len(rows) <= len(word):
                row = _row(query, rows[-1], len(rows), word[len(rows) - 1])
                if min(row) > 1:
                    break
                rows.append(row)
            j += 1
            if len(rows) > len(word):
                if abs(len(word) - size) <= 1 and rows[-1][1 + size - len(word)] == 1:
                    yield i, j - 1
                continue
            dead = len(rows)
            while j < len(words) and shared[j] >= dead:  # the same letters, the same dead row
                j += 1


def _scanned(rows: list[tuple[str, int]], least: int, ends: bool, path: list[dict]) -> Iterator[tuple]:
    """Both directions of a list's pairs: word, its count, the near word, its count."""
    order = sorted(((word[::-1] if ends else word), word, n) for word, n in rows)
    for i, j in near_pairs([key for key, _, _ in order]):
        (_, a, n_a), (_, b, n_b) = order[i], order[j]
        if min(len(a), len(b)) != least:
            continue
        if any(a[p["at"] : p["to"]] == b[p["at"] : p["to"]] for p in path):
            continue  # the list of the first halves has it
        yield a, n_a, b, n_b
        yield b, n_b, a, n_a


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of a partition that is sorted by list; batch: list key, word, count."""
    current, rows = None, []

    def batch(found: list[tuple]) -> pa.RecordBatch:
        columns = zip(*found, strict=True) if found else [[]] * 4
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [pa.array(values, kind) for values, kind in zip(columns, kinds, strict=True)], ["_word", "_n", "_near", "_near_n"])

    for whole in batches:
        found: list[tuple] = []
        columns = [column.to_pylist() for column in whole.columns]
        for least, front, back, ends, path, name, word, n in zip(*columns, strict=True):
            key = (least, front, back, ends, name, [tuple(p.values()) for p in path])
            if current is None or key != current[0]:
                if len(rows) > 1:
                    found += _scanned(rows, *current[1])
                current, rows = (key, (least, ends, path)), []
            rows.append((word, n))
        yield batch(found)
    if current is not None:
        yield batch(list(_scanned(rows, *current[1])))


def near_words(words: DataFrame, most: int = LIST) -> DataFrame:
    """(_word, _n, _near, _near_n): every ordered pair of words exactly one edit apart.

    ``words`` holds different words of ``LEAST`` or more code points with their counts.
    """
    lengths = F.array(F.length("_word"), F.length("_word") - 1)
    zero = F.lit(0)
    none = F.from_json(F.lit("[]"), "array<struct<at: int, to: int>>")
    members = words.select("_word", "_n", F.explode(lengths).alias("_least")).filter(F.col("_least") >= LEAST).select(
        "_word", "_n", "_least", zero.alias("_front"), zero.alias("_back"), none.alias("_path"))
    found = None
    while True:
        dealt = _dealt(members)
        counts = dealt.groupBy(*_LIST).agg(F.count(F.lit(1)).alias("_size")).filter("_size > 1")
        sized = cut(dealt.join(counts, _LIST), "lists")
        done = (F.col("_size") <= most) | (F.col("_least") - F.col("_front") - F.col("_back") <= 1)
        pairs = (
            sized.filter(done).select(*_LIST, "_word", "_n")
            .repartition(*_LIST).sortWithinPartitions(*_LIST)
            .mapInArrow(_pairs, "_word string, _n long, _near string, _near_n long")
        )
        found = pairs if found is None else found.unionByName(pairs)
        members = sized.filter(~done).select("_word", "_n", "_least", "_front", "_back", "_path")
        if members.isEmpty():
            return found


def _roots(forms: DataFrame) -> DataFrame:
    """(_word, _root) of words with a form: the ends of the chains, by doubling the steps."""
    found = cut(forms.select("_word", F.col("_form").alias("_root")), "roots")
    while True:
        further = found.select(F.col("_word").alias("_root"), F.col("_root").alias("_end"))
        met = found.join(further, "_root", "left")
        if met.filter("_end is not null").isEmpty():
            return found
        found = cut(met.select("_word", F.coalesce("_end", "_root").alias("_root")), "roots")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = LIST) -> DataFrame:
    """(_word, _n, _near, _form, _form_n, _root) of every word of the texts.

    Words, near words, forms and roots are those of the module's constants: letter runs of
    ASCII and Latin-1 with A-Z lowered, ``LEAST`` code points, ``OFTEN`` occurrences over all texts.  Null and empty
    texts have no words; a null id counts as an empty text; repeated rows count each;
    an empty table gives an empty table.  Frequencies rise along forms by ``FACTOR``, so a
    chain has at most 18 steps.  Other columns are not looked at.
    """
    words = cut(vocabulary(docs, id_col, text_col), "words")
    near = cut(
        near_words(words, most).groupBy("_word").agg(
            F.count(F.lit(1)).alias("_near"),
            F.min(F.when(F.col("_near_n") >= FACTOR * F.col("_n"), F.struct(-F.col("_near_n"), F.col("_near")))).alias("_best"),
        ).select("_word", "_near", F.col("_best._near").alias("_form"), (-F.col("_best.col1")).alias("_form_n")),
        "near")
    roots = _roots(near.filter("_form is not null"))
    return words.join(near, "_word", "left").join(roots, "_word", "left").select(
        "_word", "_n", F.coalesce("_near", F.lit(0)).alias("_near"), "_form", "_form_n",
        F.coalesce("_root", "_word").alias("_root"))
