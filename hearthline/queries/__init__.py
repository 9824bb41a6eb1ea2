"""Registered queries over the given tables."""

from __future__ import annotations

import importlib
import pkgutil

from hearthline.queries.registry import REGISTRY, Entry


def load_registry() -> dict[str, Entry]:
    """Import every ``q_*`` module once and return the registry."""
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name.startswith("q_")):
        importlib.import_module(f"{__name__}.{module}")
    return REGISTRY
