"""Registered queries of this subpackage with their reference SQL."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewright.llm import (
    bytepairs, language, leaks, licenses, lines, nearest, pieces, prefixes, quality, repair, repeats, shards, similar,
)
from gaugewright.llm.common import table
from gaugewright.llm.tokenizer import PATTERN, RANKS, TOKENIZER

SHARDS = 16


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(quality.fold("doc_id", 5) == 1, F.lit(False))
    model = language.train(docs.filter(~held_out))
    return language.score(docs, model, ["doc_id"]).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score", "score", "perplexity",
    )


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.tokenize(docs, TOKENIZER, ids=False, digests=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest.search(vectors, vectors.filter("vec_id % 50 = 0"))


def op4_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), kept=["doc_id"])


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), wrapped=True)


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.dedupe(table(spark, sf_dir, "documents").select("doc_id", "text"), kept=["doc_id"], texts=False)


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedupe(docs).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


def op7_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedupe(docs, per=12).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(quality.fold("doc_id", 3) == 1, F.lit(False))
    model = quality.fit(docs, table(spark, sf_dir, "labels").filter(~held_out))
    return quality.score(docs, model, ["doc_id"]).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op9_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mapped = shards.first_map(spark, SHARDS)
    grown = shards.grow(mapped)
    held = shards.slot_bytes(docs)
    placed = shards.places(docs, mapped)
    # Both sides have one row per virtual slot.
    extra = grown.select("virtual_slot", F.col("shard").alias("grown_shard")).join(
        held.select("virtual_slot", F.col("bytes").alias("slot_bytes")), "virtual_slot", "left"
    )
    return placed.join(F.broadcast(extra), "virtual_slot").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "virtual_slot", "slot_bytes"
    )


def op11_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rebuilt = prefixes.rebuilt(prefixes.sequences(table(spark, sf_dir, "conversations")))
    return prefixes.nodes(rebuilt).drop("turn_id")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damage(table(spark, sf_dir, "conversations")))


def op13_bytepairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bytepairs.tokenize(docs, RANKS, PATTERN, ids=False, digests=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


QUERIES = {
    "op1_language": op1_language,
    "op2_pieces": op2_pieces,
    "op3_nearest": op3_nearest,
    "op4_leaks": op4_leaks,
    "op5_licenses": op5_licenses,
    "op5_notices": op5_notices,
    "op6_repeats": op6_repeats,
    "op7_lines": op7_lines,
    "op7_edits": op7_edits,
    "op8_quality": op8_quality,
    "op9_similar": op9_similar,
    "op10_shards": op10_shards,
    "op11_prefixes": op11_prefixes,
    "op12_repair": op12_repair,
    "op13_bytepairs": op13_bytepairs,
    "pipeline": corpus_pipeline.run,
}
#: The others have no SQL form, or none that ends on whole tables; tests/llm holds them against brute force.
ORACLES = {
    "op4_leaks": leaks.oracle(), "op5_licenses": licenses.oracle(), "op5_notices": licenses.wrapped_oracle(), "op7_lines": lines.oracle(),
    "op11_prefixes": prefixes.oracle(), "op12_repair": repair.oracle(),
}
