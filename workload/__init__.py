"""Every named query, one module per area."""

import importlib

from workload.registry import ORACLES, QUERIES

for _area in ("events", "catalog", "ranking", "maintenance", "search", "products", "streams"):
    importlib.import_module(f"workload.{_area}")
