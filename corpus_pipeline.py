"""The corpus pipeline: quality rules, line dedup, near-dedup, secret scans, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), docs being what the stage before it wrote, and
all but the last return the columns of documents. run() applies them to documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import linededup, packing, quality, secretscan, simhash
from palimpsest.llm.common import staged

TOKENIZER = "word_bpe_49k.json"


def recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs with n_chars, if it has that column, as the text's length now."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*columns)


def beside(docs: DataFrame, names: set[str], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """stage(docs) with the columns of docs, those of names too, which the stage would replace by its own."""
    own = {c: f"_own_{i}" for i, c in enumerate(docs.columns) if c in names}
    return stage(docs.withColumnsRenamed(own)).select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, those of null or empty text among them.

    Equal texts get equal verdicts; a null doc_id is a row like any other. Other columns stay. No rows give no rows.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    added = {x.split()[0] for x in quality.SCORED.split(", ")}
    return beside(docs, added, lambda d: quality.quality_rules(d, labels).where("kept"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line, short ones too, go; every document stays, with what is left of it.

    A repeated row loses its lines with words, its text may become empty; null stays null. Ties of doc_id are ordered by a
    hash of the text. Other columns stay, n_chars is counted anew. No rows give no rows.
    """
    return recounted(beside(docs, {"n_lines", "n_removed"}, linededup.dedup_lines), docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the least doc_id (null first).

    Null and empty texts are one group, repeated rows another each. All columns stay. No rows give no rows.
    """
    return simhash.one_of_each(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind in brackets; every document stays.

    Null stays null, empty stays empty. Other columns stay, n_chars is counted anew. No rows give no rows.
    """
    return recounted(beside(docs, {"n_secrets"}, secretscan.mask_secrets), docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens.

    Null or empty text is a document of the end id alone; repeated rows are documents of their own. Other columns are not
    read. No rows give no rows.
    """
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near dedup", near_stage),
    ("secret scans", secret_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
