"""Every registered query and its SQL, by name."""

from __future__ import annotations

from siltworks.plans import queries_analytics, queries_curation, queries_extra, queries_media, queries_scalar, queries_sources, queries_vision  # noqa: F401
from siltworks.plans.registry import COVERS, ORACLES, QUERIES

__all__ = ["COVERS", "FLAGSHIP", "ORACLES", "QUERIES"]

FLAGSHIP = "leakage_split"
