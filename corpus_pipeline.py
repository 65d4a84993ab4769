"""The corpus pipeline: stages over documents, each written as Parquet and read again.

Null and empty texts go in the first stage, as texts without a letter. Rows that
are equal in doc_id and text are one document, which the second stage keeps once;
rows that only share a doc_id are different documents. A null doc_id stays null
and never matches another. Further columns of ``docs`` are not read. Stages over
empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicgrid.llm import decontaminate, language_id, ngram_join, packing, suffix_dedup
from civicgrid.llm.common import crc_bucket, materialise, table, text_key

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: those without any letter."""
    found = language_id.identify(docs, crc_bucket(F.col("doc_id"), 4) != 2, keep=COLUMNS)
    return found.filter(F.col("lang_pred") != language_id.UNDETERMINED).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar ones stays, that of the smallest doc_id (none comes last).

    Rows go by a 128-bit hash of doc_id and text: rows of one doc_id may differ in
    text, and rows that are equal in both are one document.
    """
    key = text_key(F.to_json(F.struct("doc_id", "text")))
    rows = docs.select(key.alias("key"), *COLUMNS)
    classes = ngram_join.similarity_classes(rows.select(F.col("key").alias("doc_id"), "text")).filter("n_links > 0")
    classes = classes.groupBy(F.col("doc_id").alias("key")).agg(F.min("class_id").alias("class_id"), F.count("*").alias("n"))
    linked = materialise(classes.join(rows.groupBy("key").agg(F.min("doc_id").alias("doc_id")), "key"), "linked")
    first = linked.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("first")).select("first.key")
    # tables of known size: few keys are sent to the tasks, and no text is shuffled for them
    again = materialise(linked.filter("n > 1").join(first, "key", "left_semi").select("key"), "again")
    gone = materialise(linked.join(first, "key", "left_anti").select("key").union(again), "gone")
    one = rows.join(again, "key", "left_semi").groupBy("key").agg(F.min(F.struct("lang", "source", "n_chars", "doc_id", "text")).alias("row"))
    return rows.join(gone, "key", "left_anti").select(*COLUMNS).union(one.select("row.*").select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages leave the texts, with the rest of a character that they cut; documents that had only those go."""
    left = suffix_dedup.without_repeats(docs, keep=["doc_id", "lang", "source"]).filter("n_removed = 0 OR n_removed < n_bytes")
    return left.withColumnRenamed("kept_text", "text").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate.clean_documents(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: a row for each piece and its place."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 1)


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("decontamination", benchmark_passages),
    ("best_fit_packing", packed),
]

#: SQL can't express the tokenizer and the models; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
