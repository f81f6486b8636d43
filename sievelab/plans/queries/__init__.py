"""Registered queries, one module per operator family; each has QUERIES and ORACLE."""

from __future__ import annotations

from importlib import import_module

MODULES = ("data", "noise", "summaries", "text", "evaluation", "detection", "latent", "models", "experiments")


def all_queries() -> dict:
    out: dict = {}
    for name in MODULES:
        out.update(import_module(f"{__name__}.{name}").QUERIES)
    return out


def all_oracles() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in MODULES:
        out.update(import_module(f"{__name__}.{name}").ORACLE)
    return out
