"""The registered queries and, where SQL can say the same, their SQL."""

from seriescast.queries.registry import ORACLES, QUERIES, load_all

__all__ = ["ORACLES", "QUERIES", "load_all"]
