"""Operators for preparing training text, with their queries and SQL."""

from seriescast.llm.registry import ORACLES, QUERIES, load_all

__all__ = ["ORACLES", "QUERIES", "load_all"]
