"""Labelled rows, and bounded samples of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldhub.llm.common import fold

FOLDS, HELD_OUT = 3, 1
MARKS = 27  # bits of a number of the bitmap of labelled ids: 16 MB, whatever the labels hold
_BLOCK = 15  # of them within a row of the bitmap


@dataclass(frozen=True)
class Sample:
    rows: DataFrame  # the documents' id and text with the label as _label, in no order
    counts: dict[int, int]  # all training rows by label


def known_labels(labels: DataFrame, label_col: str, id_col: str = "doc_id") -> DataFrame:
    """(_of, _label) of the training folds.

    Rows of the held-out fold, rows without an id and labels other than 0 and 1 are left out; where an id has several
    labels the smallest holds.
    """
    return (
        labels.select(F.col(id_col).alias("_of"), F.col(label_col).cast("int").alias("_label"))
        .filter("_of IS NOT NULL AND _label IN (0, 1)")
        .groupBy("_of").agg(F.min("_label").alias("_label"))
        .filter(fold("_of", FOLDS) != HELD_OUT)
    )


def _mark(id_column: str) -> Column:
    return F.pmod(F.xxhash64(F.col(id_column).cast("long")), F.lit(1 << MARKS))


def maybe_known(docs: DataFrame, known: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id's hash is that of an id of ``known``: all labelled ones and, rarely, another.

    The hashes are a bitmap of a fixed size, so texts without a label don't move; a join decides about the rest.
    """
    within = (1 << _BLOCK) - 1
    marks = known.select(_mark("_of").alias("_mark")).groupBy(F.shiftright("_mark", _BLOCK).alias("_block")).agg(
        F.bitmap_construct_agg(F.col("_mark").bitwiseAND(F.lit(within))).alias("_bits"))
    place = F.col("_mark").bitwiseAND(F.lit(within)).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return (
        docs.withColumn("_mark", _mark(id_col)).join(F.broadcast(marks), F.shiftright("_mark", _BLOCK) == F.col("_block"))
        .filter(byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) > 0).select(*docs.columns)
    )


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, most: int, id_col: str = "doc_id",
    text_col: str = "text",
) -> Sample:
    """At most ``most`` of the documents of ``known_labels`` of each class, by hash order of the id; the ids are few and broadcast."""
    known = known_labels(labels, label_col, id_col)
    counts = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = None
    for label in (0, 1):
        part = known.filter(F.col("_label") == label).orderBy(F.xxhash64("_of"), "_of").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(
        F.broadcast(picked), F.col("_id") == F.col("_of")
    )
    return Sample(rows.select("_id", "_text", "_label"), counts)
