"""All registered queries: name -> (query, SQL or None)."""

from __future__ import annotations

from . import indexes, passages, services  # noqa: F401  they register their queries
from .catalog import QUERIES

__all__ = ["QUERIES"]
