"""Registered queries over the input tables."""

from lodestream.plans import evaluation, learning, market, models, pairs, regimes, research, search, storage, tables  # noqa: F401
from lodestream.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
