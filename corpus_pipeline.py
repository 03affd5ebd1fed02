"""From raw documents to packed training sequences: five stages, each one of the corpus operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm import exact_dedup, lang_id, mixing, packing, simhash


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one language: its model codes the text in as few bits a byte as the language's own texts, and no other language comes
    near. Random characters, other scripts and mixtures go, null texts and those without a letter too; rows that repeat a key are judged one
    by one; of an empty table, or one without any language, nothing stays. All columns of docs stay, whatever their names."""
    return lang_id.in_language(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays (null and empty texts are one; a null doc_id stays only where there is no other; of rows
    that repeat both, any one). An empty table stays empty. All columns of docs stay."""
    return exact_dedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates the row with the least doc_id stays (a null doc_id only where there is no other; of several such rows
    one). Texts without a word are near each other. Rows that repeat a doc_id belong each to its own group. An empty table stays empty. All
    columns of docs stay."""
    return simhash.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each repetition of a document that its source's target asks for; the last one of a source may be the beginning of its text. A null
    source is one of its own, ordered last; a text without words adds nothing to a source's size. An empty table stays empty. All columns of
    docs stay; n_chars follows a cut text."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens, in the order of doc_id (a null first). Null and empty texts have the end token alone; rows
    that repeat a doc_id lie next to each other. An empty table gives no piece; other columns are left out."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("pack", pack)]

#: A learned model, fingerprints and tokens are beyond SQL; tests/llm has a version by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
