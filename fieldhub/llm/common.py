"""Small helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldhub.session import Scratch

#: the ASCII white space every operator splits at: space, tab, line feed, vertical tab, form feed, return
WHITE = b" \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """The text of a row; a null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold(id_column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % folds


def md5_bits(text: Column) -> Column:
    """32 bits of the MD5 of a text, the same in any engine."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared checkpoint folder and read it back: a lineage cut that
    survives lost executors."""
    return Scratch(df.sparkSession, label).cut(df)


def byte_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, without decoding them; nulls count as empty."""
    values = column.cast(pa.large_binary()).to_pylist()
    return [v or b"" for v in values] if column.null_count else values


def slices(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts hold about ``most`` bytes; a longer text is
    a run of its own, so what a task holds follows its longest text and not the batch."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
    ends, held = [0], 0
    for row, size in enumerate(sizes):
        if held and held + size > most:
            ends.append(row)
            held = 0
        held += int(size)
    ends.append(batch.num_rows)
    for start, end in pairwise(ends):
        if end > start:
            yield batch.slice(start, end - start)
    pa.default_memory_pool().release_unused()  # workers are used again, their idle memory counts
