"""The corpus queries, one for each operator, and the pipeline; SQL oracles where SQL can say it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES = {
    "op1_toxicity": "toxicity",
    "op2_html_extraction": "html_text",
    "op3_semi_markov_pii": "pii",
    "op4_nra_topk": "topk",
    "op5_feistel_sharding": "sharding",
    "op6_sentencepiece": "sentencepieces",
    "op7_suffix_dedup": "repeats",
    "op8_mixing_sources": "mixing",
    "op9_minhash_neardup": "neardup",
    "op10_document_fingerprints": "fingerprints",
    "op11_fill_in_middle": "fill_in_middle",
    "op12_prefix_trie": "prefix_trie",
    "op13_recompression_dedup": "recompression",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(importlib.import_module(f"tessera.llm.{module}"), name) for name, module in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    from tessera.llm.fill_in_middle import ORACLE_FILL_IN_MIDDLE
    from tessera.llm.prefix_trie import ORACLE_PREFIX_TRIE
    from tessera.llm.recompression import ORACLE_RECOMPRESSION
    from tessera.llm.topk import ORACLE_TOPK

    return {"op4_nra_topk": ORACLE_TOPK, "op11_fill_in_middle": ORACLE_FILL_IN_MIDDLE, "op12_prefix_trie": ORACLE_PREFIX_TRIE, "op13_recompression_dedup": ORACLE_RECOMPRESSION}
