"""Registered queries, grouped like the operator inventory."""

from __future__ import annotations

import importlib
import pkgutil


def load_all() -> None:
    """Import every query module so that its queries are registered."""
    for module in pkgutil.iter_modules(__path__):
        if module.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{module.name}")
