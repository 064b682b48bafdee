"""All registered queries and their oracles (importing the modules registers them)."""

from __future__ import annotations

from tessera.plans import q_dataset, q_enrichment, q_eval, q_features, q_mapping, q_model, q_sources  # noqa: F401
from tessera.plans.registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
