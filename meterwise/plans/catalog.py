"""Import every query module so that its queries register themselves."""

from __future__ import annotations

from . import feature_queries, model_queries, report_queries, sampling_queries  # noqa: F401
from .registry import ORACLES, QUERIES


def all_queries():
    return dict(QUERIES)


def all_oracles():
    return {k: v for k, v in ORACLES.items() if k in QUERIES}
