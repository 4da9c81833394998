"""Every registered query with its SQL counterpart."""

from gleanery.checks import dom, learned, plans, quality, records, runs, scans  # noqa: F401
from gleanery.checks.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
