"""The driver's queries and their SQL: importing the package registers them all."""

from . import queries, stateful

__all__ = ["queries", "stateful"]
