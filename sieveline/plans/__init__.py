"""Registered queries over the given tables, each with its SQL where SQL can say the same."""

from .queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
