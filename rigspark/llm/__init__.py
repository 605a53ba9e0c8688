"""Operators for large text corpora, and the queries that apply them to whole tables."""

from __future__ import annotations

import importlib

from .base import ORACLES, QUERIES

_MODULES = ("line_dedup", "decontaminate", "exact_dedup", "sharding", "url_filter", "hmm", "language", "jaccard_join", "packing", "chat", "embedding_join", "repair",
            "periodic")


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f".{name}", __name__)


def queries():
    _load()
    return dict(QUERIES)


def oracle_sql():
    _load()
    return dict(ORACLES)
