"""Conformance queries: every operator on the test tables, with the same result in plain SQL."""

from . import catalog, mapping, relational, storage, text, validation  # noqa: F401  (register queries)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
