"""Registered queries, each with the SQL that must give the same rows."""

from textmason.checks.registry import ORACLES, QUERIES
from textmason.checks import (  # noqa: F401
    extraction,
    graphs,
    joins,
    paths,
    rollups,
    rules,
    scans,
)

__all__ = ["ORACLES", "QUERIES"]
