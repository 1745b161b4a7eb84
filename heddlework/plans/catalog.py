"""All queries by name, with SQL that gives the same rows."""

from __future__ import annotations

from . import catalogs, files, inference, lineages, matching, metadata, profiles, relational, streams

_PLANS = (profiles, matching, inference, catalogs, relational, lineages, streams, files, metadata)
QUERIES = {name: query for plan in _PLANS for name, query in plan.QUERIES.items()}
ORACLES = {name: sql for plan in _PLANS for name, sql in plan.ORACLES.items()}
