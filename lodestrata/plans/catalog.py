"""Every registered query of the engine, and the SQL that checks it."""

from __future__ import annotations

from . import codes, forecast, more, prepare, sales, series, vectors  # noqa: F401  (they register their queries)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
