"""One registered query per operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalspark.llm import (bpe, chosen_path, compact_windows, conversations, line_dedup, merkle, mixing, near_vectors,
                             perplexity, pii, sharding, toxicity, window_dedup)
from signalspark.llm.streams import modest_batches
from signalspark.storage import materialize


def public_bpe() -> tuple[str, str]:
    """Rank file and pattern of the public multilingual byte-level BPE."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return modest_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op5_pca_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = chosen_path.jaccard_join(table(spark, sf_dir, "documents"))
    return joined.select("doc_id", "text_id", "class_id", "n_links", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def op7_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.feistel_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op8_distinct_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encoded(table(spark, sf_dir, "documents"), *public_bpe()))


def op9_raked_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    slim = materialize(docs.select("doc_id", "source", "lang", mixing.topic_of().alias("topic"),
                                   mixing.n_tokens().alias("tokens")), "tokens")
    cells = mixing.mix_probabilities(slim, mixing.ALPHAS, budget=0.5)
    return mixing.with_draw(slim, cells, list(mixing.ALPHAS)).select(
        "doc_id", "source", "lang", "topic", "tokens", F.round("weight", 7).alias("weight"),
        F.round("probability", 6).alias("probability"), "sampled")


def op1_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    slim = docs.select("doc_id", F.xxhash64("text").alias("digest"), F.when(F.col("text").isNull(), 0).otherwise(
        F.size(F.split("text", "\n"))).cast("long").alias("n_lines"))
    removed = line_dedup.removed_lines(docs).withColumnsRenamed({"id": "_id", "digest": "_digest"})
    joined = slim.join(removed, slim["doc_id"].eqNullSafe(removed["_id"]) & (slim["digest"] == removed["_digest"]), "left")
    return joined.select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
                         F.coalesce(F.array_join(F.col("removed").cast("array<string>"), ","), F.lit("")).alias("removed_lines"))


def op2_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op3_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = perplexity.with_verdict(perplexity.scored(table(spark, sf_dir, "documents"), keep=["doc_id"]))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return rows.select("doc_id", *[F.col(f"_lm_{n}").alias(n) for n in names],
                       F.round("_lm_log_ppl", 4).alias("log_perplexity"))


def op4_radix_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = window_dedup.repeated_windows(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.near_passages(table(spark, sf_dir, "documents"))


def op11_lightest_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    return conversations.repaired(given, conversations.damaged(given))


def op12_gru_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    text = F.when(picked, F.translate("text", "\n", "")).otherwise(F.col("text"))
    proven = merkle.manifest(table(spark, sf_dir, "documents"), tampered={"text": text}, with_path=False)
    return proven.withColumn("verified", F.col("folded_root") == F.col("root"))


LLM_QUERIES = {f.__name__: f for f in (op1_fuzzy_lines, op2_semi_markov_pii, op3_perplexity_rules, op4_radix_windows, op5_pca_tiles, op6_chosen_path_join, op7_feistel_shards, op8_distinct_word_bpe,
                                     op9_raked_mix, op10_compact_windows,
                                     op11_lightest_repair, op12_gru_toxicity, op13_merkle_manifest)}
