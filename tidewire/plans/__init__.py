"""Registered queries."""

from tidewire.plans import archive, flows, pages, rules, search, stories, texts  # noqa: F401
from tidewire.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
