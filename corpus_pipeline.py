"""A training corpus from `documents`: quality rules, near copies, secrets, source mix, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracehound.llm import mixing, ngram_join, quality, secrets, sentencepiece
from tracehound.llm.common import shared_folder, table, written

#: Near copies of the corpus: shingles of five words, similarity of 0.8 or more.
SHINGLE, PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the rules keep, without their failing lines; n_chars counts the new text."""
    return quality.cleaned(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return ngram_join.one_of_each(docs, size=SHINGLE, percent=PERCENT)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark; n_chars counts the new text."""
    return secrets.without_secrets(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: at most three times, or not at all."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns, then ids, n_tokens, and whether the ids decode to the text."""
    return sentencepiece.encoded(docs, keep=docs.columns)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_join", near_copies),
    ("secret_scans", secret_scans),
    ("source_mixing", source_mixing),
    ("sentencepiece", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), folder, f"{k}_{name}")
    return docs


#: SQL cannot state the piece merges of the last stage; the stages are tested against brute force instead.
ORACLE_SQL = None
