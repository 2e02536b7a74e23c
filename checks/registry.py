"""All registered queries."""

from checks import findings, landed, queries
from checks.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "findings", "landed", "queries"]
