"""Queries of this package by name, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib

MODULES = ("decontaminate", "quality", "line_dedup", "capture_index", "jaccard_join", "language", "packing", "site_style_tree", "pii", "audio")


def _modules():
    return [importlib.import_module(f"lodestone.llm.{name}") for name in MODULES]


def queries():
    found = {}
    for module in _modules():
        found |= module.QUERIES
    return found


def oracle_sql():
    found = {}
    for module in _modules():
        found |= getattr(module, "ORACLE_SQL", {})
    return found
