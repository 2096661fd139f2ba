"""From raw documents to packed token sequences, in five stages; each calls one operator on all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crestline.llm import op1_mixing, op4_pii, op5_langid, op9_packing, op10_setsketch, queries
from crestline.llm.common import cut, table

#: Cosine with the nearest language below which a text of any variety counts as no language at all; see op5_langid.
LEAST_COSINE = 0.05
#: Tokenized words a worker keeps; its memory also holds what earlier stages left there.
KEPT_WORDS = 60_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or unlike every language learned, go."""
    return op5_langid.known_language(docs, LEAST_COSINE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 80 % of their five-word shingles, directly or in a chain, the smallest doc_id stays."""
    return op10_setsketch.one_of_each(docs, width=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return op4_pii.without_personal_data(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are used none, one or up to three times, so that sources near their targets."""
    return op1_mixing.mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 4096 tokens."""
    return op9_packing.pack_documents(docs, queries.tokenizer_path(), kept=KEPT_WORDS)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("packing", packing),
]

#: Hashed sketches, trained networks and tokenizers are beyond SQL; tests compare each stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
