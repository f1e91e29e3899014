"""The catalog of registered queries."""

from __future__ import annotations

import importlib

MODULES = ["tables", "sources", "universe", "technical", "xsection", "flow_macro", "fundamental_events", "portfolio", "episodes", "themes", "models", "monitors", "packets", "plans"]


def load():
    from panelspark.catalog.registry import REGISTRY

    for m in MODULES:
        importlib.import_module(f"panelspark.catalog.{m}")
    return REGISTRY
