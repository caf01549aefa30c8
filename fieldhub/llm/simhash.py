"""Near duplicates by 64-bit SimHash fingerprints and BK-trees.

A document's fingerprint has a bit where more than half of its shingles' XXH64 hashes have
it.  Two fingerprints that differ in at most ``RADIUS`` bits agree on one of
``RADIUS + 1`` blocks of bits, so every fingerprint is dealt to one shard per block.  A shard
of more than ``SHARD`` fingerprints is dealt again by blocks of its free bits; a shard with f
free bits has at most 2^f members, so the dealing ends by itself with small shards and
without dropping any.  A BK-tree is built per shard, where its queries (the shard's own
fingerprints) are, and each query follows the edges within the radius.  A shard gives fewer
links than members, joining exactly what all its pairs would join.

The trees are not sent to every executor: all trees together grow with the corpus, so a
broadcast of them would have no size bound.  Each tree meets its own queries instead.

Near copies of a similarity (``similar_groups``, the corpus pipeline's stage) need another
radius: documents of Jaccard 0.8 are about 10 of 64 bits apart, where neither blocks of bits
nor a BK-tree leave anything out (strangers are about 32 apart).  A first pass joins most of them cheaply: each document
meets one leader in each of ``BANDS`` shards, dealt by keys of ``ROWS`` minimum hashes of the shingles, if their
fingerprints (of sets of shingles, so that repeats don't move them) are near.  A second pass
leaves no similar pair out: every document is listed by its rarest shingles, so many that two
similar sets have one in common, and members of a list that are not in one group yet are compared.  What drops a
pair before that are bounds that no similar pair exceeds.  In both passes every pair is verified by the exact Jaccard similarity
of its whole texts before it joins anything.  A text that shares only common passages with others meets none of them
there, so a large group costs its size and not its square.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from fieldhub.llm.bktree import spanning_links
from fieldhub.llm.common import byte_texts, cut, slices, text_of
from fieldhub.operators.components import connected_components
from fieldhub.session import small_table

RADIUS = 2
SHARD = 512  # a larger shard is dealt once more
ALL_BITS = (1 << 64) - 1
STEP = 1 << 16  # shingles hashed at once

CONTRACT_WIDTH = 3  # op10's shingles, for which RADIUS is given
SIMILAR = 0.8  # least Jaccard similarity of near copies by other shingles
BANDS, ROWS = 20, 5  # at Jaccard 0.8 a pair shares none of the keys in 0.04 % of cases
FAR = 28  # bits of fingerprints that meet in the first pass; at Jaccard 0.8 the mean is 9.7 to 12 (small sets) and the deviation about 3
LISTED = 32  # members of a list that are compared with each other at once
WIDE = 8  # words of a set's parities
COMMON_BITS = 18  # buckets that tell common shingles from rare ones
MOST_KEYS = 500_000  # texts asked for that are broadcast by key (some 40 MB), more are joined
SLICE = 4 << 20  # bytes of text that are worked on at once
MINIMA_STEP = 1024  # shingles that meet all multipliers at once


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                found = [fingerprint(text, width) for text in byte_texts(batch.column(1))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(found, pa.int64())], ["_id", "_print"]
                )

    return run


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text"))
    return rows.mapInArrow(_fingerprints(width), "_id long, _print long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _blocks(fixed: int, parts: int) -> list[int]:
    """Masks that fix one more block each: the free bits cut in ``parts`` runs."""
    free = [bit for bit in range(64) if not fixed >> bit & 1]
    runs = [free[len(free) * i // parts : len(free) * (i + 1) // parts] for i in range(parts)]
    return [fixed | sum(1 << bit for bit in run) for run in runs]


def _dealt(members: DataFrame, masks: list[int], parts: int) -> DataFrame:
    """Each member once per block of its shard's free bits."""
    steps = [(_signed(mask), _signed(block)) for mask in masks for block in _blocks(mask, parts)]
    table = small_table(members.sparkSession, steps, {"_mask": "bigint", "_next": "bigint"})
    met = members.join(F.broadcast(table), "_mask")  # parts^depth rows
    return met.select("_print", F.col("_next").alias("_mask")).withColumn(
        "_value", F.col("_print").bitwiseAND(F.col("_mask"))
    )


def _tree_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = [
                (_signed(a), _signed(b))
                for shard in batch.column(0).to_pylist()
                for a, b in spanning_links([value & ALL_BITS for value in shard], radius)
            ]
            a, b = zip(*links, strict=True) if links else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]
            )

    return run


def links(prints: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(a, b): links of at most ``radius`` differing bits that span every group of different
    fingerprints (column ``_print``)."""
    parts, masks = radius + 1, [0]
    if shard < 2**parts:
        raise ValueError(f"shards of {shard} fingerprints cannot be dealt by {parts} blocks")
    members = prints.select("_print").distinct().withColumn("_mask", F.lit(0).cast("long"))
    found = None
    while True:
        dealt = _dealt(members, masks, parts)
        counts = dealt.groupBy("_mask", "_value").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        sized = cut(dealt.join(counts, ["_mask", "_value"]), "shards")
        small = (
            sized.filter(F.col("_n") <= shard)
            .groupBy("_mask", "_value").agg(F.collect_list("_print").alias("_shard"))
            .select("_shard").mapInArrow(_tree_links(radius), "a long, b long")
        )
        found = small if found is None else found.unionByName(small)
        members = sized.filter(F.col("_n") > shard)
        if members.isEmpty():
            return found
        masks = sorted({block for mask in masks for block in _blocks(mask, parts)})


def _hashed(words: list[bytes], width: int) -> Iterator[np.ndarray]:
    """The shingles' XXH64, repeats included, ``STEP`` at a time; fewer words than ``width`` are one."""
    total = max(1, len(words) - width + 1)
    for first in range(0, total, STEP):
        part = words[first : min(first + STEP, total) + width - 1]
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
        starts = np.concatenate(([0], ends[:-1]))[: max(1, len(part) - width + 1)].tolist()
        stops = (ends[min(width, len(part)) - 1 :] - 1).tolist()
        shingles = [joined[a:b] for a, b in zip(starts, stops, strict=True)]
        yield np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, len(shingles))


def _majority(parts: Iterable[np.ndarray]) -> int:
    """The bits that more than half of the hashes have."""
    sums, total = np.zeros(64, dtype=np.int64), 0
    for hashes in parts:
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8), bitorder="little")
        sums += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
        total += len(hashes)
    majority = np.packbits(2 * sums > total, bitorder="little")
    return int.from_bytes(majority.tobytes(), "little", signed=True)


def fingerprint(text: bytes, width: int) -> int:
    """SimHash of a text's ``width``-word shingles, repeats counted; 0 without words."""
    words = text.lower().split()  # bytes: only A-Z is lowered, only ASCII white space splits
    return _majority(_hashed(words, width)) if words else 0


def _shingle_set(words: list[bytes], width: int) -> np.ndarray:
    """Different shingles' hashes, sorted; a text without words has the empty shingle's."""
    if not words:
        return np.array([xxhash.xxh64_intdigest(b"", 42)], np.uint64)
    return np.unique(np.concatenate([np.unique(part) for part in _hashed(words, width)]))


def _key(words: list[bytes]) -> str:
    """Names a text up to case and white space, by 128 bits."""
    return xxhash.xxh3_128_hexdigest(b" ".join(words), 7)


def _band_keys(hashes: np.ndarray, factors: np.ndarray) -> list[int]:
    """Shard keys: each hashes some of the minima of the multiplied shingle hashes."""
    minima = np.full(len(factors), ALL_BITS, np.uint64)
    for first in range(0, len(hashes), MINIMA_STEP):
        part = hashes[first : first + MINIMA_STEP]
        minima = np.minimum(minima, (factors[:, None] * part[None, :]).min(axis=1))
    rows = minima.reshape(BANDS, ROWS)
    return [_signed(xxhash.xxh64_intdigest(row.tobytes(), band)) for band, row in enumerate(rows)]


_DESCRIBED = "_id long, _key string, _print long, _size long, _bands array<long>, _wide array<long>"


def _described(width: int):
    factors = np.random.default_rng(5).integers(0, ALL_BITS, BANDS * ROWS, np.uint64, endpoint=True) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, SLICE):
                rows = []
                for text in byte_texts(batch.column(1)):
                    words = text.lower().split()
                    hashes = _shingle_set(words, width)
                    rows.append((_key(words), _majority([hashes]), len(hashes), _band_keys(hashes, factors), _wide_print(hashes)))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                arrays = [pa.array(values, kind) for values, kind in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["_id", "_key", "_print", "_size", "_bands", "_wide"])

    return run


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the text's key; batch: row, text."""
    for whole in batches:
        for batch in slices(whole, 1, SLICE):
            keys = [_key(text.lower().split()) for text in byte_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.string())], ["_row", "_text", "_key"])


def _hash_sets(width: int):
    """The different shingles' hashes of each text; batch: key, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, SLICE):
                sets = [_shingle_set(text.lower().split(), width).view(np.int64) for text in byte_texts(batch.column(1))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["_key", "_set"])

    return run


def _sets(wanted: DataFrame, docs: DataFrame, text_col: str, width: int) -> DataFrame:
    """(_key, _set): the shingle sets of the texts with the keys wanted, each once."""
    given = docs.select(F.lit(0).alias("_row"), text_of(text_col).alias("_text"))
    wanted = cut(wanted, "wanted")
    if wanted.count() <= MOST_KEYS:  # then the texts that nobody wants are not shuffled
        wanted = F.broadcast(wanted)
    texts = (
        given.mapInArrow(_keyed, "_row int, _text string, _key string").join(wanted, "_key", "left_semi")
        .groupBy("_key").agg(F.first("_text").alias("_text")))
    return cut(texts.mapInArrow(_hash_sets(width), "_key string, _set array<long>"), "sets")


def _similarities(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, _jaccard): the similarity of pairs by all shingles of their whole texts."""
    one, other = sets.toDF("a", "_one"), sets.toDF("b", "_other")
    met = pairs.join(one, "a").join(other, "b").withColumn("_both", F.size(F.array_intersect("_one", "_other")))
    union = F.size("_one") + F.size("_other") - F.col("_both")
    return met.select("a", "b", (F.col("_both") / union).alias("_jaccard"))


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of a similarity of ``least`` or more."""
    return cut(_similarities(pairs, sets).filter(F.col("_jaccard") >= least).select("a", "b"), "similar")


def _rooted(classes: DataFrame, found: DataFrame) -> DataFrame:
    """Add the root that links reach (the own key without any)."""
    roots = connected_components(found).distinct().toDF("_key", "_root")
    return classes.join(roots, "_key", "left").withColumn("_root", F.coalesce("_root", "_key"))


def _sized(one: Column, other: Column, least: float) -> Column:
    """Sizes alike, as those of every pair of similarity ``least`` are."""
    return F.least(one["_size"], other["_size"]) >= least * F.greatest(one["_size"], other["_size"]) - 1e-6


def _pairs(met: DataFrame, one: str, other: str, least: float) -> DataFrame:
    """Pairs of a first pass: what it leaves out is found by lists."""
    a, b = F.col(one), F.col(other)
    bits = F.bit_count(a["_print"].bitwiseXOR(b["_print"]))
    return met.filter((a["_key"] != b["_key"]) & (bits <= FAR) & _sized(a, b, least)).select(
        F.least(a["_key"], b["_key"]).alias("a"), F.greatest(a["_key"], b["_key"]).alias("b")).distinct()


# --- what the first pass leaves open ---------------------------------------------------------------
def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(64 - COMMON_BITS)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of a task's shingles fall in each bucket; batch: set."""
    counts = np.zeros(1 << COMMON_BITS, np.int64)
    for batch in batches:
        values = batch.column(0).flatten().to_numpy(zero_copy_only=False)
        counts += np.bincount(_bucket(values), minlength=len(counts))
    found = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], ["_bucket", "_n"])


def _wide_print(hashes: np.ndarray) -> list[int]:
    """Of each of 64 * ``WIDE`` buckets whether an odd number of the set falls in it: two sets differ in no more bits than members."""
    counts = np.bincount((hashes & np.uint64(64 * WIDE - 1)).astype(np.int64), minlength=64 * WIDE)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view("<i8").tolist()


def _noded(width: int):
    """(_node, _set): the different shingles' hashes of each text by 64 bits of its key, ``F.xxhash64`` of it; batch: row, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, SLICE):
                split = [text.lower().split() for text in byte_texts(batch.column(1))]
                nodes = [_signed(xxhash.xxh64_intdigest(_key(words).encode(), 42)) for words in split]
                sets = [_shingle_set(words, width).view(np.int64) for words in split]
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["_node", "_set"])

    return run


def _then(*steps):
    """Steps over batches as one, so that nothing between them is moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps:
            batches = step(batches)
        return batches

    return run


def _prefixes(shared, least: float):
    """The rarest shingles of each set, so many that sets without one in common are under ``least``;
    batch: columns to carry, set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            owners, tokens, ranks, common = [], [], [], []
            sets, carried = batch.column(batch.num_columns - 1), range(batch.num_columns - 1)
            for row in range(batch.num_rows):
                hashes = sets[row].values.to_numpy(zero_copy_only=False)
                often = counts[_bucket(hashes)]
                size = len(hashes) - math.ceil(least * len(hashes) - 1e-6) + 1
                rarest = np.lexsort((hashes, often))[:size]
                owners.append(np.full(len(rarest), row))
                tokens.append(hashes[rarest])
                ranks.append(np.arange(len(rarest), dtype=np.int32))
                common.append(np.full(len(rarest), often.mean()))
            if owners:
                at = pa.array(np.concatenate(owners))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens)), *(batch.column(c).take(at) for c in carried),
                     pa.array(np.concatenate(ranks)), pa.array(np.concatenate(common).astype(np.float32))],
                    ["_token", *(batch.schema.names[c] for c in carried), "_rank", "_common"])

    return run


def _common_ones(counted: DataFrame):
    """How many shingles fall in each bucket, for all tasks: 2^COMMON_BITS numbers whatever there is to count."""
    sums = counted.groupBy("_bucket").agg(F.sum("_n").alias("_n")).toArrow()  # one row a bucket at most
    counts = np.zeros(1 << COMMON_BITS, np.int64)
    counts[sums.column(0).to_numpy()] = sums.column(1).to_numpy()
    return counted.sparkSession.sparkContext.broadcast(counts)


def _open(lists: DataFrame) -> DataFrame:
    """The rows of lists of more than one group; ``_many`` counts a list.  The rows move once, at every size."""
    of = Window.partitionBy("_token")
    spans = lists.withColumns({"_low": F.min("_head").over(of), "_high": F.max("_head").over(of)})
    left = spans.filter("_low < _high").drop("_low", "_high").dropDuplicates(["_token", "_node"])  # equal texts are one member
    return cut(left.withColumn("_many", F.count(F.lit(1)).over(of)), "open")


def _lists(members: DataFrame, least: float) -> DataFrame:
    """The members (_node, _head, _set) by their rarest shingles: two sets of similarity ``least``
    meet in a list.  ``_many`` counts a list; lists of one group are left out.

    Any one order of the shingles gives that; the order by bucket counts only makes lists
    short.
    """
    shared = _common_ones(members.select("_set").mapInArrow(_counted, "_bucket long, _n long"))
    kinds = "_token long, _node long, _head long, _rank int, _common float"
    return _open(cut(members.select("_node", "_head", "_set").mapInArrow(_prefixes(shared, least), kinds), "lists"))


def _text_lists(docs: DataFrame, text_col: str, width: int, least: float, nodes: DataFrame) -> DataFrame:
    """``_lists`` of whole texts, whose sets are not moved.  ``nodes`` (_node, _head) names groups."""
    texts = docs.select(F.lit(0).alias("_row"), text_of(text_col).alias("_text"))
    sets_only = lambda batches: (b.select(["_set"]) for b in batches)
    shared = _common_ones(texts.mapInArrow(_then(_noded(width), sets_only, _counted), "_bucket long, _n long"))
    kinds = "_token long, _node long, _rank int, _common float"
    listed = cut(texts.mapInArrow(_then(_noded(width), _prefixes(shared, least)), kinds), "lists")
    grouped = cut(nodes.filter("_node <> _head").select("_node", "_head"), "grouped")
    grouped = F.broadcast(grouped) if grouped.count() <= MOST_KEYS else grouped
    return _open(listed.join(grouped, "_node", "left").withColumn("_head", F.coalesce("_head", "_node")))


def _listed_pairs(lists: DataFrame, members: DataFrame, least: float) -> DataFrame:
    """(a, b) of members of different groups in a list.  ``_far`` is a member's distance to a text
    that is the same in the whole list: the Jaccard distance is a metric, so two such
    distances that differ by more than 1 - ``least`` are those of texts that cannot be similar.

    ``_rank`` counts the member's rarer shingles.  What a pair shares comes from its first shared shingle on,
    so there each has enough left for the overlap that ``least`` asks for; a list where one has not gives no pair.
    The parities differ in no more bits than the sets in members.  None of these bounds drops a similar pair.
    """
    light = members.select("_node", "_size", "_wide")
    rows = lists.join(light, "_node").select(
        "_token", F.struct("_node", "_head", "_size", "_far", "_wide", (F.col("_size") - F.col("_rank")).alias("_rest")).alias("_one"))
    a, b = F.col("_one"), F.col("_other")
    apart = (a["_node"] < b["_node"]) & (a["_head"] != b["_head"])
    near = F.abs(a["_far"] - b["_far"]) <= 1 - least + 1e-9
    enough = F.least(a["_rest"], b["_rest"]) >= least / (1 + least) * (a["_size"] + b["_size"]) - 1e-6
    bits = sum((F.bit_count(F.get(a["_wide"], k).bitwiseXOR(F.get(b["_wide"], k))) for k in range(WIDE)), F.lit(0))
    few = bits <= (1 - least) / (1 + least) * (a["_size"] + b["_size"]) + 1e-6
    kept = apart & near & enough & _sized(a, b, least) & few
    met = rows.join(rows.withColumnRenamed("_one", "_other"), "_token").filter(kept)
    return met.select(a["_node"].alias("a"), b["_node"].alias("b")).distinct()


def _listed_links(nodes: DataFrame, lists: DataFrame, sets_of: Callable[[DataFrame], DataFrame], least: float) -> DataFrame:
    """Links between members (_node, _head, _key, _size, _wide) of different groups, as keys.

    In a list of up to ``LISTED`` members pairs of different groups are compared.  In a longer one all members first
    meet one leader, the one whose shingles are the most common (of a group of near copies
    that is what they are copies of), which joins groups and gives each member a distance that rules out most others.
    """
    names = nodes.select("_node", "_key")
    keyed = lambda pairs: pairs.join(names.toDF("a", "_a"), "a").join(names.toDF("b", "_b"), "b").select(
        F.col("_a").alias("a"), F.col("_b").alias("b"))
    pairs = _listed_pairs(lists.filter(F.col("_many") <= LISTED).withColumn("_far", F.lit(0.0)), nodes, least)

    long = lists.filter(F.col("_many") > LISTED)
    leaders = long.groupBy("_token").agg(F.max_by("_node", F.struct("_common", "_node")).alias("_first"))
    met = cut(long.join(leaders, "_token").select("_token", "_node", "_head", "_rank", "_first"), "led")
    found = None
    if not met.isEmpty():
        asked = cut(met.filter("_node <> _first").select(F.col("_node").alias("a"), F.col("_first").alias("b")).distinct(), "asked")
        wanted = asked.select(F.explode(F.array("a", "b")).alias("_node")).distinct().join(names, "_node")
        known = sets_of(wanted.select("_key")).join(names, "_key").select("_node", "_set")
        measured = cut(_similarities(asked, known), "measured")
        found = measured.filter(F.col("_jaccard") >= least).select("a", "b")
        of = nodes.select("_node", "_head")
        between = found.join(of.toDF("a", "_a"), "a").join(of.toDF("b", "_b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
        merged = _rooted(of.select(F.col("_head").alias("_key")).distinct(), between).toDF("_head", "_now")
        far = measured.select(F.col("a").alias("_node"), F.col("b").alias("_first"), (1 - F.col("_jaccard")).alias("_far"))
        placed = met.join(far, ["_node", "_first"], "left").join(merged, "_head").select(
            "_token", "_node", "_rank", F.col("_now").alias("_head"), F.coalesce("_far", F.lit(0.0)).alias("_far"))
        placed = cut(placed, "placed")
        spans = placed.groupBy("_token").agg(F.min("_head").alias("_low"), F.max("_head").alias("_high")).filter("_low < _high")
        pairs = pairs.unionByName(_listed_pairs(placed.join(spans.select("_token"), "_token"), nodes, least))
    compared = cut(keyed(pairs.distinct()), "pairs")
    links = _similar(compared, sets_of(compared.select(F.explode(F.array("a", "b")).alias("_key")).distinct()), least)
    return links if found is None else links.unionByName(keyed(found))


def similar_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
    least: float = SIMILAR,
) -> DataFrame:
    """(_id, _key, _print, _root, _group) for every row, by links of texts whose sets of
    ``width``-word shingles have a Jaccard similarity of ``least`` or more.

    ``_root`` names the group, ``_group`` is the smallest id in it (null if no row of it has one), ``_key`` the
    text up to case and white space, ``_print`` the SimHash of its set of shingles.  No pair
    under ``least`` links and no pair of ``least`` or more is left out.  Texts without words are one text.
    """
    given = docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text"))
    rows = cut(given.mapInArrow(_described(width), _DESCRIBED), "prints")
    classes = cut(rows.groupBy("_key").agg(
        F.min("_id").alias("_least"), *(F.first(c).alias(c) for c in ("_print", "_size", "_bands", "_wide"))), "classes")
    dealt = classes.select("_key", "_print", "_size", F.explode("_bands").alias("_shard"))
    leaders = dealt.groupBy("_shard").agg(
        F.min_by(F.struct("_key", "_print", "_size"), F.xxhash64("_key", "_shard")).alias("_first"),
        F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    members = cut(dealt.join(leaders, "_shard"), "members")
    met = members.select(F.struct("_key", "_print", "_size").alias("_one"), "_first")
    tested = cut(_pairs(met, "_one", "_first", least), "pairs")
    wanted = tested.select(F.explode(F.array("a", "b")).alias("_key")).distinct()
    found = _similar(tested, _sets(wanted, docs, text_col, width), least)

    rooted = cut(_rooted(classes.select("_key", "_size", "_wide"), found), "rooted").withColumn("_node", F.xxhash64("_key"))
    heads = rooted.groupBy("_root").agg(F.min("_node").alias("_head"))
    nodes = cut(rooted.join(heads, "_root").select("_node", "_head", "_key", "_size", "_wide"), "nodes")
    lists = _text_lists(docs, text_col, width, least, nodes)
    if not lists.isEmpty():
        sets_of = lambda wanted: _sets(wanted, docs, text_col, width)
        found = cut(found.unionByName(_listed_links(nodes, lists, sets_of, least)), "links")

    rooted = cut(_rooted(classes.select("_key", "_least"), found), "rooted")
    groups = rooted.groupBy("_root").agg(F.min("_least").alias("_group"))
    named = rooted.join(groups, "_root").select("_key", "_root", "_group")
    return rows.select("_id", "_key", "_print").join(named, "_key").select("_id", "_key", "_print", "_root", "_group")


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = CONTRACT_WIDTH,
    radius: int | None = None,
) -> DataFrame:
    """(_id, _print, _group) for every row of ``docs``.

    Without ``radius`` it is ``RADIUS`` bits for shingles of ``CONTRACT_WIDTH`` words; other
    shingles go by verified similarity (``similar_groups``).

    ``_group`` is the smallest id that can be reached by links of at most ``radius`` bits
    (a row's own fingerprint included).  Null and empty texts have the
    fingerprint 0 and link like any other; a text with fewer words than ``width`` is one
    shingle.  A null id takes part in linking and never names a group of which a member has
    an id.  Repeated rows stay and share their group.
    """
    if radius is None and width != CONTRACT_WIDTH:
        return similar_groups(docs, id_col, text_col, width).select("_id", "_print", "_group")
    radius = RADIUS if radius is None else radius
    rows = cut(fingerprints(docs, id_col, text_col, width), "prints")
    prints = rows.groupBy("_print").agg(F.min("_id").alias("_least"))
    joined = connected_components(links(prints, radius)).select(
        F.col("node").alias("_print"), F.col("component").alias("_root")
    )
    rooted = prints.join(joined.distinct(), "_print", "left").withColumn(
        "_root", F.coalesce("_root", "_print")
    )
    least = rooted.groupBy("_root").agg(F.min("_least").alias("_group"))
    named = rooted.join(least, "_root").select("_print", "_group")
    return rows.join(named, "_print").select("_id", "_print", "_group")


def drop_near(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
    least: float = SIMILAR,
) -> DataFrame:
    """One row of each near-duplicate group, with all columns: links are verified Jaccard
    similarities of ``least`` or more.

    The row with the smallest id stays, a row without one only if the group has no other; of rows that share that id
    the one with the least text key, of equal rows one.  The text column is read as a string; null texts count as empty.
    """
    groups = similar_groups(docs, id_col, text_col, width, least)
    kept = groups.groupBy("_root").agg(F.min(F.struct(F.col("_id").isNull().alias("_none"), "_id", "_key")).alias("_best"))
    name = lambda key, row_id: F.concat(key, F.lit(":"), F.coalesce(row_id.cast("string"), F.lit("")))
    names = kept.select(name(F.col("_best._key"), F.col("_best._id")).alias("_name"))
    row = F.struct(*(docs[f"`{c}`"].alias(f"c{k}") for k, c in enumerate(docs.columns)))
    given = docs.select(row.alias("_row"), text_of(text_col).alias("_text"))
    keyed = given.mapInArrow(_keyed, StructType([*given.schema, StructField("_key", StringType())]))
    row_id = F.col(f"_row.c{docs.columns.index(id_col)}").cast("long")
    named = keyed.select("_row", name(F.col("_key"), row_id).alias("_name")).join(names, "_name", "left_semi")
    one = named.groupBy("_name").agg(F.first("_row").alias("_row"))
    return one.select(*(F.col(f"_row.c{k}").alias(c) for k, c in enumerate(docs.columns)))
