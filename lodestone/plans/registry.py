"""All queries of the search engine by name, with the DuckDB text that gives the same rows."""

from __future__ import annotations

from lodestone.plans.oracles import ORACLES
from lodestone.plans.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
