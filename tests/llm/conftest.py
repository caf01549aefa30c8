from __future__ import annotations

import pytest

KINDS = ("doc_id long, text string, lang string, source string, n_chars long, "
         "_id long, _text string, _kept_id long, _size long, _rate double, row string")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, columns with working names."""
    long = " ".join(f"wort{i % 977} und{i % 13}" for i in range(30_000))
    texts = [
        (1, "The cat sat on the mat.", "en", "a"), (2, "The  cat sat\ton the mat.", "en", "a"),
        (3, "The cat sat on the mat!", "en", "b"), (4, None, "de", "b"), (5, "", None, None),
        (6, " \n\t ", "fr", None), (7, long, "de", "a"), (8, long + " ende", "de", "c"), (9, "x", "en", "c"),
        (10, "x", "en", "c"), (10, "x", "en", "c"), (None, "x", None, "c"), (None, None, None, None),
        (11, "Ärger über Öl ", "de", "a"), (12, "Ärger über Öl", "de", "a"), (13, "<|endoftext|> it's  2", "en", "b"),
    ]
    rows = [(i, t, lang, s, None if t is None else len(t), 7, "t", 1, 2, 0.5, "r") for i, t, lang, s in texts]
    return spark.createDataFrame(rows, KINDS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], KINDS)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")
