"""Registered queries over the canonical views."""

from __future__ import annotations

import importlib

from gaugewell.plans.registry import Catalog

MODULES = ("q_rates", "q_tables", "q_text", "q_models", "q_gates", "q_more", "q_tracing", "q_evidence")


def catalogs() -> list[Catalog]:
    """The catalogs of all query modules, in order."""
    return [importlib.import_module(f"gaugewell.plans.{name}").CATALOG for name in MODULES]
