"""All queries of the library but those of the optional corpus operators."""

from __future__ import annotations

from . import brain, content, genetics, graphs, policies, relational, telemetry

_PARTS = (genetics, brain, telemetry, policies, graphs, content, relational)
QUERIES = {k: f for part in _PARTS for k, f in part.QUERIES.items()}
ORACLES = {k: s for part in _PARTS for k, s in part.ORACLES.items()}
