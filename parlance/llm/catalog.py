"""The registered queries of the operators and the SQL that DuckDB can check them with."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

for _name in ("gif", "digests", "jaccard", "mixing", "packing", "quality", "sharding", "templates", "tokens", "toxicity"):
    _module = importlib.import_module(f"parlance.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= getattr(_module, "ORACLES", {})
