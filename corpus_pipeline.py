"""The corpus pipeline: quality rules, near-dedup, personal data, packing; each stage on all its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from aprlens.llm import packing, quality, setsketch, surrogates
from aprlens.llm.shared import kept, table

VOCABULARY = "byte_bpe_50k.json"


def set_apart(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """Columns but ``doc_id`` and ``text`` renamed, so that none has the name of one a stage adds; and their way back."""
    own = {c: c if c in ("doc_id", "text") else f"__{c}" for c in docs.columns}
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()])
    return plain, [F.col(f"`{n}`").alias(c) for c, n in own.items()]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the rules keep. Rows are carried through the scan, so a null or repeated doc_id loses none."""
    plain, back = set_apart(docs)
    judged = quality.quality_rules(plain, table(spark, sf_dir, "labels"), plain.columns)
    return judged.where("kept").select(*back)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id. Rows are told apart by id and
    text, so a repeated id does not take another document with it; of wholly equal rows one stays."""
    plain, back = set_apart(docs)
    key = F.coalesce(F.sha2(F.col("text"), 256), F.lit("")).alias("_key")
    marked = setsketch.near_duplicates(plain.select("doc_id", "text", key), carried=["_key"])
    heads = marked.where("head").select(F.col("doc_id").alias("_id"), F.col("_key").alias("_of")).distinct()
    keyed = plain.withColumn("_key", key)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_of"))
    return keyed.join(heads, same, "left_semi").dropDuplicates(["doc_id", "_key"]).select(*back)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets replaced by surrogates; every document stays."""
    plain, back = set_apart(docs)
    return surrogates.with_surrogates(plain).select(*back)


def length_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and token-budget batches of what is left."""
    return packing.packed_batches(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("personal data", personal_data),
    ("packing", length_packing),
]

#: The forest, the keyed surrogates and the tokenizer have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
