"""Registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tillstar.llm.chat_format import OP13_SQL, op13_chat_format
from tillstar.llm.dual_tree import OP11_SQL, op11_ranked_search
from tillstar.llm.embedding_dedup import OP7_SQL, op7_embedding_dedup
from tillstar.llm.licenses import op6_license_scan
from tillstar.llm.mixing import OP3_SQL, op3_mixing
from tillstar.llm.neighbours import OP4_SQL, op4_neighbours
from tillstar.llm.ngram_join import op1_ngram_join
from tillstar.llm.packing import op10_packing
from tillstar.llm.runs import op12_periodic_runs
from tillstar.llm.secrets import OP8_SQL, op8_secrets
from tillstar.llm.suffix_dedup import op2_suffix_dedup
from tillstar.llm.toxicity import op9_toxicity
from tillstar.llm.url_filter import OP5_SQL, op5_url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_join": op1_ngram_join,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_mixing": op3_mixing,
        "op4_neighbours": op4_neighbours,
        "op5_url_filter": op5_url_filter,
        "op6_license_scan": op6_license_scan,
        "op7_embedding_dedup": op7_embedding_dedup,
        "op8_secrets": op8_secrets,
        "op9_toxicity": op9_toxicity,
        "op10_packing": op10_packing,
        "op11_ranked_search": op11_ranked_search,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_chat_format": op13_chat_format,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_mixing": OP3_SQL,
        "op4_neighbours": OP4_SQL,
        "op5_url_filter": OP5_SQL,
        "op7_embedding_dedup": OP7_SQL,
        "op8_secrets": OP8_SQL,
        "op11_ranked_search": OP11_SQL,
        "op13_chat_format": OP13_SQL,
    }
