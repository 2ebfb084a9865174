"""Training-data operators over whole document corpora.

Every module holds one operator, its thin ``opN_<name>`` query and, where SQL
can express the query, its DuckDB statement. Nothing else in the library
imports this subpackage.
"""

from __future__ import annotations

import importlib

#: module -> query name
MODULES = {
    "minhash": "op1_minhash_near_dedup",
    "langid": "op2_language_id",
    "quotes": "op3_quotation_linking",
    "mixing": "op4_pareto_mixing",
    "quality": "op5_quality_rules",
    "pii": "op6_pii_spans",
    "debruijn": "op7_substring_dedup",
    "bpe": "op8_bpe_lexicon",
    "media": "op9_media_sequences",
    "suffixes": "op10_suffix_dedup",
}


def queries() -> dict:
    return {name: importlib.import_module(f"{__name__}.{module}").query for module, name in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"{__name__}.{module}"), "ORACLE_SQL", None) for module, name in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
