"""The named queries of this subpackage and their SQL forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spendtrace.llm.alignment import alignment_query
from spendtrace.llm.chat import CHAT_SQL, chat_query
from spendtrace.llm.classifier import classifier_query
from spendtrace.llm.covertree import TOP_K_SQL, top_k_query
from spendtrace.llm.decontaminate import DECONTAMINATE_SQL, decontaminate_query
from spendtrace.llm.divergence import divergence_query
from spendtrace.llm.extract import extract_query
from spendtrace.llm.importance import importance_query
from spendtrace.llm.jaccard import JACCARD_SQL, jaccard_query
from spendtrace.llm.langid import langid_query
from spendtrace.llm.mixture import MIXTURE_SQL, mixture_query
from spendtrace.llm.shard import shard_query
from spendtrace.llm.warc import WARC_SQL, warc_query


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_divergence": divergence_query,
        "op2_quality_classifier": classifier_query,
        "op3_chat_format": chat_query,
        "op4_decontaminate": decontaminate_query,
        "op5_shard": shard_query,
        "op6_language_id": langid_query,
        "op7_jaccard_join": jaccard_query,
        "op8_warc": warc_query,
        "op9_html_extract": extract_query,
        "op10_mixture": mixture_query,
        "op11_alignment": alignment_query,
        "op12_importance": importance_query,
        "op13_top_k": top_k_query,
    }


def llm_sql() -> dict[str, str]:
    """SQL of the queries that SQL expresses on whole tables.

    Sharding needs crc32 and a loop per key; the learned operators are
    iterative. The tests hold those against brute force.
    """
    return {
        "op3_chat_format": CHAT_SQL,
        "op4_decontaminate": DECONTAMINATE_SQL,
        "op7_jaccard_join": JACCARD_SQL,
        "op8_warc": WARC_SQL,
        "op10_mixture": MIXTURE_SQL,
        "op13_top_k": TOP_K_SQL,
    }
