"""All queries for the genomic operators, with their oracle SQL."""

from __future__ import annotations

from . import alignments, containers, features, formats, regions, sequences, variants  # noqa: F401
from .registry import ORACLES, PYTHON, QUERIES

__all__ = ["ORACLES", "PYTHON", "QUERIES"]
