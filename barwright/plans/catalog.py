"""Imports every module that registers queries."""

from __future__ import annotations

from barwright.plans import analytics, edges, features  # noqa: F401, I001
from barwright.plans import extras, primitives  # noqa: F401
from barwright.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
