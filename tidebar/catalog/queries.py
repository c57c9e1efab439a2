"""All queries of the library itself, by name."""

from . import market, models, more, strategy

QUERIES, ORACLE_SQL = strategy.QUERIES, strategy.ORACLE

__all__ = ["ORACLE_SQL", "QUERIES", "market", "models", "more"]
