"""Registered queries and their SQL."""

from __future__ import annotations

from attestry.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
