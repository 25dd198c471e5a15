"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: query name -> module of this subpackage that has ``query`` and perhaps ``ORACLE_SQL``
MODULES = {
    "op1_language_id": "language",
    "op2_histogram_top_k": "search",
    "op3_hash_tree_sharding": "sharding",
    "op4_secret_scan": "secrets",
    "op5_token_counts": "tokens",
    "op6_id_files": "idfile",
    "op7_source_mixing": "mixing",
    "op8_simhash_near_dedup": "simhash",
    "op9_quality_cascade": "quality",
    "op10_hilbert_packing": "packing",
    "op11_conversation_repair": "dialogue",
    "op12_closed_itemsets": "itemsets",
    "op13_polytope_near_dedup": "polytope",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: import_module(f"tessera.llm.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"tessera.llm.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
