"""Queries that apply each operator to its whole table, and the SQL that checks them where SQL can."""

from __future__ import annotations

import importlib
import pkgutil


from varloom import llm
from varloom.llm.registry import ORACLES, QUERIES

for _module in sorted(m.name for m in pkgutil.iter_modules(llm.__path__)):
    if _module.startswith("op"):
        importlib.import_module(f"varloom.llm.{_module}")

__all__ = ["ORACLES", "QUERIES"]
