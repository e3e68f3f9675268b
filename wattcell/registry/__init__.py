"""Registered queries and the SQL that checks them."""

from wattcell.registry import figures, models, tables
from wattcell.registry.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "figures", "models", "tables"]
