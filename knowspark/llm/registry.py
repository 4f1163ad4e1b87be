"""Queries of the corpus operators: op<N>_<name> -> (spark, sf_dir) -> DataFrame, and their DuckDB SQL."""

from __future__ import annotations

from importlib import import_module

_OPS = {
    "op1_minhash": "minhash",
    "op2_token_counts": "token_counts",
    "op3_decontamination": "decontam",
    "op4_line_dedup": "lines",
    "op5_pii": "pii",
    "op6_bpe": "bpe",
    "op7_url_filters": "urls",
    "op8_toxicity": "toxicity",
    "op9_chat_format": "chat",
    "op10_quality_rules": "quality",
    "op11_token_alignment": "align",
    "op12_sharding": "shards",
    "op13_spelling_variants": "spelling",
}


def queries() -> dict:
    return {name: import_module(f"{__package__}.{mod}").query for name, mod in _OPS.items()}


def oracle_sql() -> dict:
    mods = {name: import_module(f"{__package__}.{mod}") for name, mod in _OPS.items()}
    return {name: m.ORACLE for name, m in mods.items() if getattr(m, "ORACLE", None)}
