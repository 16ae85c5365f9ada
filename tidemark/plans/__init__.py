"""Registered queries over the given tables."""

from __future__ import annotations

import importlib
import pkgutil


def load() -> dict:
    """Import every ``*_queries`` module and return the registry."""
    for module in pkgutil.iter_modules(__path__):
        if module.name.endswith("_queries"):
            importlib.import_module(f"{__name__}.{module.name}")
    from tidemark.plans.registry import REGISTRY

    return dict(REGISTRY)
