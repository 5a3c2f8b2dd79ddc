"""The registered queries and the SQL that checks them."""

from __future__ import annotations

from tidemark.plans import q_events, q_identity, q_models, q_panels, q_scalars, q_series, q_sources  # noqa: F401 - they register their queries
from tidemark.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
