"""The op queries: each operator over its whole table, with the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldhub.llm import conversations, decontaminate, exact, lm, mixing, packing, pivots, quality, simhash, toxicity, urls, variants, warc
from fieldhub.llm.common import fold, table
from fieldhub.llm.labels import FOLDS, HELD_OUT
from fieldhub.llm.sql import OP2_SQL, OP4_SQL, OP7_SQL, OP8_SQL, OP9_SQL, OP11_SQL, OP12_SQL, OP13_SQL


def _judged(scored: DataFrame, mark: float, *more: str) -> DataFrame:
    return scored.select(
        F.col("_id").alias("doc_id"), (fold("_id", FOLDS) == HELD_OUT).alias("held_out"),
        F.col("_score").alias("score"), (F.col("_score") >= mark).cast("int").alias("predicted"),
        *(F.col(f"_{name}").alias(name) for name in more),
    )


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranking = quality.train(docs, table(spark, sf_dir, "labels"))
    return _judged(quality.score(docs, ranking), 0.5)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        F.col("_id").alias("doc_id"), F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        (F.col("_copies") * F.col("_size")).alias("taken"),
    )


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score_texts(table(spark, sf_dir, "documents"))
    return scored.select(
        F.col("_id").alias("doc_id"), F.col("_held").alias("held_out"), F.col("_tokens").alias("n_tokens"),
        F.col("_known").alias("n_known"), F.col("_train").alias("train_tokens"), F.col("_base").alias("base_score"),
        F.col("_score").alias("score"),
        F.try_divide(F.col("_score") * -3.321928094887362, F.col("_bytes")).alias("bits_per_byte"),
    )


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"_id": "page_id", "_host": "host", "_path": "path", "_rule": "rule", "_verdict": "verdict",
             "_score": "llr_milli"}
    return urls.judge(table(spark, sf_dir, "pages")).select(*(F.col(a).alias(b) for a, b in names.items()))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return _judged(toxicity.score(docs, net), toxicity.MARK, "flagged")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"_id": "doc_id", "_piece": "piece", "_start": "start", "_length": "length",
             "_crc": "ids_crc32", "_sequence": "sequence_id", "_offset": "offset"}
    return packing.pack(table(spark, sf_dir, "documents")).select(
        *(F.col(a).alias(b) for a, b in names.items())
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"_id": "page_id", "_bytes": "payload_bytes", "_digest": "payload_digest", "_type": "record_type",
             "_refers_to": "refers_to"}
    return warc.round_trip(table(spark, sf_dir, "pages")).select(*(F.col(a).alias(b) for a, b in names.items()))


def op8_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"_id": "doc_id", "_owner": "keep_id", "_group": "group_size", "_kept": "kept",
             "_sha": "text_sha256"}
    return exact.exact_owners(table(spark, sf_dir, "documents")).select(
        *(F.col(a).alias(b) for a, b in names.items())
    )


def op9_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"_id": "vec_id", "_links": "n_links", "_component": "component_id", "_kept": "kept"}
    return pivots.near_vectors(table(spark, sf_dir, "embeddings")).select(*(F.col(a).alias(b) for a, b in names.items()))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents")).select(
        F.col("_id").alias("doc_id"), F.lpad(F.lower(F.hex("_print")), 16, "0").alias("fingerprint"),
        F.col("_group").alias("component_id"),
    )


def op11_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.overlap(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("_id").alias("doc_id"), F.col("_words").alias("n_words"), F.col("_hit").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"), F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        (F.col("_hit") > 0).alias("contaminated"),
    )


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"_word": "word", "_form": "form", "_root": "root", "_n": "n", "_near": "n_near", "_form_n": "form_n"}
    return variants.variants(table(spark, sf_dir, "documents")).select(*(F.col(a).alias(b) for a, b in names.items()))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    names = {"_conv": "conv_id", "_gaps": "gaps", "_blank": "blank", "_duplicate": "duplicate", "_truncated": "truncated",
             "_illegal": "illegal", "_cost": "cost", "_audit": "audit", "_sha": "repaired_sha256"}
    return conversations.repair(conversations.damaged(given), given).select(*(F.col(a).alias(b) for a, b in names.items()))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_mixing": op2_mixing,
    "op3_lm": op3_lm,
    "op4_urls": op4_urls,
    "op5_toxicity": op5_toxicity,
    "op6_packing": op6_packing,
    "op7_warc": op7_warc,
    "op8_exact": op8_exact,
    "op9_pivots": op9_pivots,
    "op10_simhash": op10_simhash,
    "op11_automaton": op11_automaton,
    "op12_variants": op12_variants,
    "op13_conversations": op13_conversations,
}

SQL: dict[str, str] = {
    "op2_mixing": OP2_SQL, "op4_urls": OP4_SQL, "op7_warc": OP7_SQL, "op8_exact": OP8_SQL, "op9_pivots": OP9_SQL,
    "op11_automaton": OP11_SQL,
    "op12_variants": OP12_SQL,
    "op13_conversations": OP13_SQL,
}
