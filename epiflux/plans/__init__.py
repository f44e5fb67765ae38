"""Queries over the driver tables, one module per workload."""

from __future__ import annotations

from importlib import import_module

from epiflux.plans.registry import ORACLES, QUERIES

MODULES = ("tables", "daily", "linelist", "text", "places", "rt", "topics", "stream")


def load_all():
    """Import every plan module and return ``(queries, oracles)``."""
    for name in MODULES:
        import_module(f"epiflux.plans.{name}")
    return QUERIES, ORACLES
