"""Every registered query with its SQL twin, gathered from the modules of millrace.plans."""

from __future__ import annotations

import importlib

MODULES: tuple[str, ...] = ("transforms", "aggregates", "windowed", "joined", "dialect", "cep", "apps", "ml", "streamed")

QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _m = importlib.import_module(f"millrace.plans.{_name}")
    QUERIES.update(_m.QUERIES)
    ORACLES.update(_m.ORACLES)
