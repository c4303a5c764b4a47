"""Registered queries: each operator run over the given tables, with its SQL twin."""

from changelake.plans.registry import REGISTRY, Tables
from changelake.plans import (  # noqa: F401  (importing registers the queries)
    changing,
    decoding,
    files,
    maintaining,
    monitoring,
    querylogs,
    reconciling,
    streams,
    versioned,
)

__all__ = ["REGISTRY", "Tables"]
