"""Mixing sources to target weights: repetition rates and seeded Bernoulli copies.

Tokens are summed per source (partial sums before the shuffle), targets follow from the
sums by water-filling, and each document is taken floor(rate) times plus one more time with
probability rate - floor(rate).  The extra copies are drawn by coordinated Bernoulli
trials: documents are dealt to cells of a source by hash, ordered by size in each cell, and
document k of a cell is taken where k * p + u passes a whole number, u being the cell's hash
seeded uniform.  Every document's chance is p, and a cell misses its share by about one
document.  Cells hold about ``CELL`` rows whatever the size of the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldhub.llm.common import WORD, cut, md5_bits, text_of

WEIGHTS = (3, 1, 2)  # by rank of the source's name, repeating
SHARE = (3, 2)  # the mix is 3/2 of all tokens
MOST = 2  # no source is repeated more often
CELL = 2_000  # documents of a cell, about
MOST_SOURCES = 10_000  # targets of so many sources are broadcast, more are not
SEED = "mix"


def words(text_col: str = "text") -> Column:
    return F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long")


def source_targets(sized: DataFrame, source_col: str) -> DataFrame:
    """(_source, _source_size, _rows, _target): one row per source.

    The target of a source is min(MOST * size, weight * level), with the level at
    which all targets together are SHARE of all sizes.  Sources fill in the order of size per weight:
    a source is full if the level would still be above it with all before it full.
    """
    sums = sized.groupBy(F.col(source_col).alias("_source")).agg(
        F.sum("_size").alias("_source_size"), F.count(F.lit(1)).alias("_rows")
    )
    rank = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last()))
    weight = F.element_at(
        F.array(*(F.lit(w).cast("long") for w in WEIGHTS)), ((rank - 1) % len(WEIGHTS) + 1).cast("int")
    )
    every = Window.partitionBy()
    weighed = sums.withColumn("_weight", weight).withColumn("_most", MOST * F.col("_source_size"))
    by_fill = Window.orderBy(F.col("_most") / F.col("_weight"), F.col("_source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    full = F.coalesce(F.sum("_most").over(before), F.lit(0))
    left = SHARE[0] * F.sum("_source_size").over(every) - SHARE[1] * full  # times SHARE[1]
    open_weight = F.sum("_weight").over(every) - F.coalesce(F.sum("_weight").over(before), F.lit(0))
    levels = weighed.withColumn("_left", left).withColumn("_open", SHARE[1] * open_weight)
    fits = F.col("_most") * F.col("_open") >= F.col("_left") * F.col("_weight")
    first = F.min(F.when(fits, F.struct(F.col("_most") / F.col("_weight"), F.col("_source").isNull(),
                                        "_source", "_left", "_open"))).over(every)
    mark = F.struct(F.col("_most") / F.col("_weight"), F.col("_source").isNull(), F.col("_source"))
    head = F.struct(first["col1"], first["col2"], first["_source"])
    target = F.when(mark < head, F.col("_most").cast("double")).otherwise(
        F.coalesce(F.col("_weight") * (first["_left"].cast("double") / first["_open"]), F.lit(0.0))
    )
    return levels.select("_source", "_source_size", "_rows", target.alias("_target"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None,
    seed: str = SEED, carried: Column | None = None, text_col: str = "text",
) -> DataFrame:
    """(_id, _size, _source_size, _target, _copies) for every row of ``docs``, and ``carried`` as _row if given.

    ``_copies`` is how often the mix takes the document: never more than MOST times.  ``size``
    counts tokens (words of ``text`` if not given); null sizes count as 0, null sources are a
    source of their own, ranked last.  A source without tokens has the target 0 and
    gives no copies.  Draws depend on the ids, sizes and the seed only (for rows without an id on the
    text), so reruns agree; repeated rows are documents of their own, each drawn in turn.
    """
    size = words() if size is None else size
    unnamed = F.md5(text_of(text_col)) if text_col in docs.columns else F.lit("")
    sized = docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_of"),
        F.coalesce(size.cast("long"), F.lit(0).cast("long")).alias("_size"),
        F.coalesce(F.col(id_col).cast("string"), unnamed).alias("_key"),
        *([] if carried is None else [carried.alias("_row")]),
    )
    targets = source_targets(sized, "_of")
    if carried is not None:  # few sources go to the rows, many sources meet them by name
        targets = cut(targets, "targets")
        targets = F.broadcast(targets) if targets.count() <= MOST_SOURCES else targets
    met = sized.join(targets, F.col("_of").eqNullSafe(F.col("_source")))
    rate = F.coalesce(F.try_divide(F.col("_target"), F.col("_source_size")), F.lit(0.0))
    whole = F.floor("_rate")
    cell = md5_bits(F.concat(F.lit(f"{seed}/"), "_key")) % F.ceil(F.col("_rows") / CELL)
    celled = met.withColumn("_rate", rate).withColumn("_cell", cell)
    turn = F.row_number().over(
        Window.partitionBy("_source", "_cell").orderBy("_size", md5_bits(F.concat(F.lit(f"{seed}:"), "_key")), "_id")
    )
    name = F.coalesce(F.concat(F.lit("="), F.col("_source")), F.lit("-"))
    uniform = md5_bits(F.concat(F.lit(f"{seed}#"), F.col("_cell").cast("string"), name)) / F.lit(4294967296.0)
    passed = lambda k: F.floor(k * (F.col("_rate") - whole) + uniform)
    extra = passed(F.col("_turn")) - passed(F.col("_turn") - 1)
    return celled.withColumn("_turn", turn).select(
        "_id", "_size", "_source_size", "_target", (whole + extra).cast("long").alias("_copies"),
        *([] if carried is None else ["_row"]),
    )


def mixed(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None,
    seed: str = SEED,
) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with all their columns.

    Every row has a count of its own, also where rows share an id or have none.  Nulls are as of ``mix``.
    """
    row = F.struct(*(docs[f"`{c}`"].alias(f"c{k}") for k, c in enumerate(docs.columns)))
    taken = mix(docs, id_col, source_col, size, seed, row).filter("_copies > 0")
    copies = taken.select(F.explode(F.array_repeat("_row", F.col("_copies").cast("int"))).alias("_row"))
    return copies.select(*(F.col(f"_row.c{k}").alias(c) for k, c in enumerate(docs.columns)))
