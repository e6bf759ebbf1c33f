"""One query for each operator, on the test tables, with the SQL that checks it."""

from . import aggregates, alignments, distributions, extremes_synthesis, more, scalars, spells  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
