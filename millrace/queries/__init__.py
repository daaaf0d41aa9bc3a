"""The engine's operators as queries over the driver's tables, with SQL for each that SQL can express."""

from millrace.queries import engine, layouts, presets, rewards, tables  # noqa: F401
from millrace.queries.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
