"""The catalogue of queries over the supplied tables, and the SQL that checks each."""

from __future__ import annotations

from . import corpus, evaluation, geometry, profile, studies, texts
from .registered import QUERIES, SQL

assert corpus and evaluation and geometry and profile and studies and texts  # importing them fills the catalogue

__all__ = ["QUERIES", "SQL"]
