"""One query per operator over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import archives, conversations, embed_dedup, licenses, merkle, packing, pieces, quality, setsketch, sharding
from . import surrogates, token_codes, toxicity as toxic_texts
from .oracle import ORACLE_SQL as ORACLE_SQL
from .shared import table

VOCABULARY, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.range_join(table(spark, sf_dir, "embeddings"), 0.93)


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_codes.token_table(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_batches(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def archive_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.archived(table(spark, sf_dir, "pages"))


def piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.sampled_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its personal data replaced."""
    return surrogates.with_surrogates(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_entities")


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licensed(table(spark, sf_dir, "documents"))


def minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = setsketch.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def vector_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"), 24)


def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.damage_repaired(table(spark, sf_dir, "conversations"))


def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"))


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_texts.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_embedding_near_dedup": embedding_near_dedup,
    "op2_quality_rules": quality_rules,
    "op3_token_ids": token_ids,
    "op4_length_packing": length_packing,
    "op5_archive_conversion": archive_conversion,
    "op6_piece_sampling": piece_sampling,
    "op7_pii_surrogates": pii_surrogates,
    "op8_minhash_near_dedup": minhash_near_dedup,
    "op9_license_scan": license_scan,
    "op10_vector_sharding": vector_sharding,
    "op11_conversation_repair": conversation_repair,
    "op12_merkle_manifest": merkle_manifest,
    "op13_toxicity": toxicity,
}
