"""Queries over the bundled test tables, each with its DuckDB statement where SQL can express it."""

from __future__ import annotations

import importlib
import pkgutil


def load_all():
    """Import every catalog module and return the filled registry."""
    from . import registry

    for info in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{info.name}")
    return registry.QUERIES, registry.ORACLES
