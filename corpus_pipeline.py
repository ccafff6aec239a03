"""From raw documents to token ids: five stages, each an operator of folia.llm over all that is left.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. run() writes each stage's rows to the shared folder and reads them again.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from folia.llm.bpe import encode
from folia.llm.common import stage, table
from folia.llm.jaccard import drop_near_copies
from folia.llm.languages import keep_identified
from folia.llm.mixing import mixed_documents
from folia.llm.privacy import sanitise

#: A byte-level BPE file; its path is a parameter of the encoder.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


#: Rows of whole texts that travel between Spark and Python at a time.
BATCH_ROWS = 1000

Step = Callable[[SparkSession, DataFrame, str], DataFrame]


def _in_small_batches(step: Step) -> Step:
    @functools.wraps(step)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        return step(spark, docs, sf_dir)

    return run


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language that the labelled ones teach; those without letters go."""
    return keep_identified(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return drop_near_copies(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that disclose it out of their texts."""
    return sanitise(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the ids of the text."""
    return encode(docs, TOKENIZER).select("doc_id", "lang", "source", "ids")


STAGES: list[tuple[str, Step]] = [
    ("language", _in_small_batches(language)),
    ("near copies", _in_small_batches(near_copies)),
    ("personal data", _in_small_batches(personal_data)),
    ("mixture", _in_small_batches(mixture)),
    ("tokens", _in_small_batches(tokens)),
]

#: Mixture inference and byte-pair merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
