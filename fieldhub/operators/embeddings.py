"""Embedding references, similarity scores and classification flags."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldhub import constants as K


def from_bands(df: DataFrame, dim: int = K.EMBEDDING_DIM) -> Column:
    """Vector from ``embedding_i`` or ``b_i`` band columns; absent or null bands are 0."""
    names = set(df.columns)
    bands = []
    for i in range(dim):
        found = [F.col(n) for n in (f"embedding_{i}", f"b{i}") if n in names]
        bands.append(F.coalesce(*found, F.lit(0.0)).cast("float"))
    return F.array(*bands)


def mean_vectors(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Element-wise mean per class, of vectors of any length.

    Vectors of one class must have one length; a class with several has no mean (null).
    """
    known = vectors.filter(F.col(vector).isNotNull())
    cells = known.select(key, F.size(vector).alias("_size"), F.posexplode(vector).alias("_at", "_value"))
    means = cells.groupBy(key, "_at").agg(F.avg(F.col("_value").cast("double")).alias("_mean"))
    rows = means.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_at", "_mean"))).alias("_cells"))
    sizes = known.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), (F.min(F.size(vector)) == F.max(F.size(vector))).alias("_even")
    )
    mean = F.when(F.col("_even"), F.col("_cells._mean"))
    return sizes.join(rows, sizes[key].eqNullSafe(rows[key]), "left").select(sizes[key], "n", mean.alias("mean"))


def reference_vector(means: DataFrame, key: str, value) -> list[float] | None:
    """The mean vector of one class as plain numbers (``dim`` doubles); None if it has none."""
    row = means.filter(F.col(key) == value).select("mean").first()
    return None if row is None else list(row["mean"])


def cosine(vector: Column, reference: list[float]) -> Column:
    """Cosine similarity to a fixed vector, 0 when either is all zero.

    A vector of another length is an error: it comes from another model.
    """
    norm_ref = math.sqrt(sum(r * r for r in reference))
    if norm_ref == 0:
        return F.when(vector.isNotNull(), F.lit(0.0))
    weights = F.array(*[F.lit(r / norm_ref) for r in reference])
    zero = F.lit(0.0)
    dot = F.aggregate(F.zip_with(vector, weights, lambda a, w: a * w), zero, lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(vector, zero, lambda s, a: s + a.cast("double") * a))
    fits = F.size(vector) == len(reference)
    odd = F.raise_error(F.concat(F.lit(f"a vector of {len(reference)} numbers is needed, not of "), F.size(vector).cast("string")))
    return F.when(vector.isNull(), F.lit(None)).when(~fits, odd.cast("double")).when(norm == 0, zero).otherwise(dot / norm)


def classify(
    candidates: DataFrame,
    reference: list[float] | None,
    vector: str = "vector",
    threshold: float = K.SIMILARITY_THRESHOLD,
) -> DataFrame:
    """Add ae_score, ae_is_afo and ae_filtered.

    Without a reference every candidate passes with score 1; a candidate without an
    embedding gets the neutral score.
    """
    if reference is None:
        score = F.lit(1.0)
        return candidates.withColumns(
            {"ae_score": score, "ae_is_afo": F.lit(True), "ae_filtered": F.lit(False)}
        )
    score = F.coalesce(cosine(F.col(vector), reference), F.lit(K.NEUTRAL_SIMILARITY))
    return candidates.withColumn("ae_score", score).withColumns({
        "ae_is_afo": F.col("ae_score") >= threshold,
        "ae_filtered": F.col("ae_score") < threshold,
    })


def validated(classified: DataFrame) -> DataFrame:
    return classified.filter("ae_is_afo")
