"""Named queries over the reference operators and their DuckDB SQL."""

from ..shipping import shipped
from . import attempts, hygiene, inference, parsing, scoring, similarity
from .base import ORACLES, QUERIES

__all__ = ["attempts", "hygiene", "inference", "parsing", "oracle_sql", "queries", "scoring", "similarity"]


def queries():
    return {k: shipped(f) for k, f in QUERIES.items()}


def oracle_sql():
    return dict(ORACLES)
