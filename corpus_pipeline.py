"""A corpus pipeline: score, deduplicate, mix and tokenize the documents of a folder.

Every stage works on all rows that its predecessor kept and returns the columns
of ``documents``; the last returns ids.  ``run`` writes what each stage returns
and reads it again, so a lost executor costs one stage's work at most.

Edge cases, for all stages: null and empty texts score as clean, have no lines
and no shingles, take no part in the mix (size 0) and so end there; rows with a
null doc_id are scored, deduplicated by nobody, mixed and encoded; rows that
repeat a doc_id share the fate of that id in the n-gram join, and are rows of
their own elsewhere; ties go to the smaller doc_id, and where that is equal to
either; very long texts are read whole; further columns of ``documents``, whatever
their names, pass through up to the last stage; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import bpe, line_dedup, mixing, ngram_join, toxicity
from rasterloom.llm.common import fresh_name, release_shuffles, table, write_table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5 stay."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), usable=~toxicity.held_out(F.col("_id")))
    score = fresh_name(docs, "toxicity")
    scored = toxicity.score(docs, model, keep=tuple(docs.columns), into=score)
    return scored.where(F.col(score) < 0.5).drop(score)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicate lines the first stays; documents all stay, and n_chars follows the text."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one of smallest doc_id stays (and rows that repeat it); rows without doc_id stay."""
    classes = ngram_join.ngram_jaccard_classes(docs)
    gone = classes.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixing.mix_documents(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of every row."""
    both = bpe.round_trip(docs, bpe.tokenizer_path())
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("ngram_join", ngram_join_stage),
    ("source_mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: Training, fuzzy matching and merging have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir))
        release_shuffles(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
