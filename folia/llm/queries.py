"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from folia.llm import divergence, mixing, toolcalls
from folia.llm.bpe import op1_bpe
from folia.llm.capfilters import op3_near_vectors
from folia.llm.classlm import op6_class_lm
from folia.llm.common import table
from folia.llm.dimscan import op12_neighbours
from folia.llm.divergence import op13_divergence
from folia.llm.fingerprints import op5_fingerprints
from folia.llm.importance import op11_importance
from folia.llm.jaccard import op8_jaccard_join
from folia.llm.languages import op2_language_id
from folia.llm.mixing import op7_mixing
from folia.llm.privacy import op4_pii
from folia.llm.toolcalls import op10_tool_calls
from folia.llm.urls import op9_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": lambda spark, sf_dir: op1_bpe(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")),
    "op2_language_id": lambda spark, sf_dir: op2_language_id(table(spark, sf_dir, "documents")),
    "op3_near_vectors": lambda spark, sf_dir: op3_near_vectors(table(spark, sf_dir, "embeddings")),
    "op4_pii": lambda spark, sf_dir: op4_pii(table(spark, sf_dir, "documents")),
    "op5_fingerprints": lambda spark, sf_dir: op5_fingerprints(table(spark, sf_dir, "documents")),
    "op6_class_lm": lambda spark, sf_dir: op6_class_lm(table(spark, sf_dir, "documents")),
    "op7_mixing": lambda spark, sf_dir: op7_mixing(table(spark, sf_dir, "documents")),
    "op8_jaccard_join": lambda spark, sf_dir: op8_jaccard_join(table(spark, sf_dir, "documents")),
    "op9_url_filter": lambda spark, sf_dir: op9_url_filter(table(spark, sf_dir, "pages")),
    "op10_tool_calls": lambda spark, sf_dir: op10_tool_calls(table(spark, sf_dir, "conversations")),
    "op11_importance": lambda spark, sf_dir: op11_importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op12_neighbours": lambda spark, sf_dir: op12_neighbours(table(spark, sf_dir, "embeddings")),
    "op13_divergence": lambda spark, sf_dir: op13_divergence(table(spark, sf_dir, "documents")),
}

QUERIES["pipeline"] = corpus_pipeline.run

ORACLE_SQL: dict[str, str] = {"op7_mixing": mixing.ORACLE_SQL, "op10_tool_calls": toolcalls.ORACLE_SQL, "op13_divergence": divergence.ORACLE_SQL}
