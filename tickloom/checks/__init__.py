"""Every registered query with the SQL it is compared with, grouped as in the survey."""

from tickloom.checks import attribution, books, expressions, labels_eval, learning, libraries, pit, quality, research, slices, streams, technical  # noqa: F401
from tickloom.checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
