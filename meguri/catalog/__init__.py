"""The registered queries and their SQL."""

from meguri.catalog import jobs, lists, matching, scalars, sources  # noqa: F401
from meguri.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
