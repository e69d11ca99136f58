"""The training-data pipeline: stages over documents, each written and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusbench.llm import hyperminhash, language, packing, quality, superkmers, tokens
from corpusbench.llm.common import stage_table, text_key

NEAR = 80  # percent of shared five-word shingles at which documents are near-duplicates


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns as one, so that no operator takes them for its own."""
    others = (F.col(c) for c in docs.columns if c not in ("doc_id", "text"))
    return docs.select("doc_id", "text", F.struct(*others, F.lit(0).alias("_none")).alias("_others"))


def _unpacked(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.select(*(c if c in ("doc_id", "text") else F.col("_others")[c].alias(c) for c in columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current policy of the quality ledger."""
    entries = quality.ledger(_packed(docs))
    return _unpacked(entries.where(quality.passes(quality.POLICIES[quality.CURRENT])), docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share any n-gram with a known language; profiles are learned from the labelled ones that came in.

    Texts without letters go, and texts in a script no profile has; a foreign language in a known
    script shares n-grams with its profiles and stays.
    """
    profiles = language.learn_profiles(docs)
    told = language.predict(_packed(docs), profiles)
    return _unpacked(told.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") > 0)), docs.columns)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest id, a null id being larger than every id.

    Rows are judged one by one: repeated rows and copies without an id are near-duplicates like any
    other, and rows that share an id but not their text are different documents.  Of rows of one id
    in a group that of the least text hash stays; of rows equal in id and text any one.
    """
    # Numbers are written down, for a plan that runs again may deal its rows in another order.
    row, text = "_near_row", "_near_text"
    numbered = stage_table(docs.withColumns({row: F.monotonically_increasing_id(), text: text_key()}), "near-rows")
    judged = hyperminhash.near_duplicates(numbered, percent=NEAR, id_col=row)
    groups = judged.select(F.col("doc_id").alias(row), "component_id").join(numbered.select(row, "doc_id", text), row)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", text, row))[row]
    stays = groups.groupBy("component_id").agg(first.alias(row)).select(row)
    return numbered.join(stays, row, "left_semi").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words that repeated windows cover; texts that lose nothing keep their layout."""
    cleaned = superkmers.repeated_words(_packed(docs), keep=["_others"])
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text"))
    n_chars = F.length("text").cast(docs.schema["n_chars"].dataType)
    return _unpacked(cleaned.withColumn("text", text), docs.columns).withColumn("n_chars", n_chars)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of the documents in training sequences."""
    definition = tokens.tokenizer_json(public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack_documents(docs, definition)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("minhash_near_dedup", minhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", pack),
]
# Language profiles, near-duplicate components, and token ids are not SQL: tests hold run() against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents in their order; what a stage keeps is written for the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage_table(docs, f"pipeline-{name}")
    return docs
