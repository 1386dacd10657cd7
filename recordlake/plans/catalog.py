"""Every registered query with its SQL twin."""

from __future__ import annotations

from . import q_bands, q_builds, q_composed, q_facts, q_more, q_outcomes, q_portal, q_publishing, q_real, q_records, q_sources, q_stored, q_text  # noqa: F401
from .bindings import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
