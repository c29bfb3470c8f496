"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

#: Query -> the module of this subpackage that has it.
_QUERIES = {
    "op1_exact_dedup": "exact_dedup",
    "op2_html_extraction": "html_extract",
    "op3_sentencepiece": "sentencepiece_sampling",
    "op4_language_id": "language_id",
    "op5_media_columns": "media_jpeg",
    "op6_quality": "quality_rff",
    "op7_simhash": "simhash",
    "op8_suffix_dedup": "suffix_dedup",
    "op9_packing": "packing",
    "op10_secrets": "secrets",
    "op11_hard_negatives": "hard_negatives",
    "op12_line_dedup": "line_dedup",
    "op13_collocations": "collocations",
}
#: Modules whose queries SQL can express over whole tables.
_WITH_SQL = ["exact_dedup", "hard_negatives", "line_dedup", "collocations"]


def queries() -> dict:
    return {query: getattr(import_module(f"tessera.llm.{module}"), query) for query, module in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """The other queries are tested against brute force."""
    return {query: sql for module in _WITH_SQL for query, sql in import_module(f"tessera.llm.{module}").ORACLE_SQL.items()}
