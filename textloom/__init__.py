"""Search and analysis of text collections on Spark. The engine's entry points are loaded when they are first used."""

from __future__ import annotations

import importlib

_WHERE = {"Query": "plans.engine", "Index": "plans.engine", "Engine": "plans.engine", "reconcile_covering": "plans.engine", "is_regex": "functions.router", "find_root": "sources.corpus", "covering_roots": "sources.corpus", "parse_level": "plans.schemas"}
__all__ = [*_WHERE, "matches_query", "split_terms"]


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(importlib.import_module(f"{__name__}.{_WHERE[name]}"), name)


def split_terms(text: str) -> list[str]:
    return __getattr__("Query")(text).terms


def matches_query(candidate: str, query: str) -> bool:
    return __getattr__("Query")(query).matches(candidate)
