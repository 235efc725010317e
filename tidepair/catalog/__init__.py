"""Registered queries with their SQL twins."""

import importlib

from .tables import ORACLES, REGISTRY

MODULES = ["edge_queries", "scalar_queries", "split_queries", "de_queries", "outcome_queries", "latent_queries", "enrich_queries", "source_queries"]


def load():
    """Import every query module; returns (queries, oracle SQL)."""
    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
    return REGISTRY, ORACLES
