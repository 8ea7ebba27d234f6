"""Queries over the driver's tables, one module per family of operators."""

from __future__ import annotations

import importlib

MODULES: tuple[str, ...] = ("text", "characters", "search", "chunks", "events", "evaluation", "registry", "readers")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"lodewell.query_sets.{name}")
