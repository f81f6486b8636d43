"""Registered queries of the operators: each takes (spark, sf_dir), reads whole tables and returns the full result."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "quality_rules", "chat_format", "decontaminate", "bpe", "token_file", "near_dup", "pu_quality", "html_extract", "katz", "license_scan",
    "spelling_variants", "collocations", "sentencepiece_codec",
)


def _all(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out.update(getattr(import_module(f"sievelab.llm.q_{module}"), name))
    return out


def all_queries() -> dict:
    return _all("QUERIES")


def all_oracles() -> dict[str, str]:
    return _all("ORACLE")
