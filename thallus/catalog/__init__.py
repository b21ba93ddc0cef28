"""Named queries over the given tables, each with its SQL twin where SQL can say it."""

from .registry import ORACLES, QUERIES
from . import analyses, annotation, ecology, measures, scans, sequences, statistics, wrangling  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
