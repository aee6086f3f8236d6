"""Queries of the engine over the test tables, each with SQL that gives the same rows where SQL can."""

from sievewright.queries import aggregates, cards, checks, contracts, evaluation, gates, incremental, joins, panels, records, selection, statistics, storage, text, windows  # noqa: F401
from sievewright.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
