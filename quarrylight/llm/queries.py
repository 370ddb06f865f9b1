"""The registered queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm import block_max, byte_bpe, divergence, embedding_dedup, fingerprint, langid, license_scan, line_dedup, mixing, oracles, order_minhash, substring, token_pack, toxicity
from quarrylight.llm.common import broadcast_if_small, table, written


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = token_pack.write_shards(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), vocabulary=49408, end_id=1)
    return token_pack.read_digests(shards)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.remove_boilerplate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("kept_md5"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"), window=13)


def held_out(doc_id: str = "doc_id"):
    """Fold 2 of 4 by the checksum of the id's digits."""
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~held_out()))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = license_scan.train(license_scan.sample(docs))
    found = license_scan.scan(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.array_join(F.transform("licences", lambda x: x["family"]), ",").alias("families"), "n_units", "n_licence_units", F.round(F.array_max(F.transform("licences", lambda x: x["score"])), 4).alias("score"))


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    moved = written(fingerprint.duplicate_classes(docs).where("doc_id <> class_id").distinct(), "moved")
    found = fingerprint.fingerprints(docs).join(broadcast_if_small(moved), "doc_id", "left")
    return found.withColumn("class_id", F.coalesce("class_id", "doc_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = order_minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    # more common words than by default: each is folded once and not in every run of documents that has it
    return byte_bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), common=450_000)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(mixing.labelled(table(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "topic", "n_tokens"), "labelled")
    found = mixing.mix(rows, has_labels=True)
    return found.select("doc_id", "topic", "n_tokens", F.round("probability", 6).alias("probability"), "selected")


def op11_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_max.search(block_max.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = toxicity.fit(docs, labels.where(~held))
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_pack": op1_token_pack,
    "op2_line_dedup": op2_line_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_language_id": op4_language_id,
    "op5_license_scan": op5_license_scan,
    "op6_fingerprint": op6_fingerprint,
    "op7_order_minhash": op7_order_minhash,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_mixing": op10_mixing,
    "op11_block_max": op11_block_max,
    "op12_toxicity": op12_toxicity,
    "op13_divergence": op13_divergence,
}

ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": oracles.line_dedup(),
    "op10_mixing": oracles.mixing(),
    "op11_block_max": oracles.ranked_search(),
    "op13_divergence": oracles.divergence(),
}
