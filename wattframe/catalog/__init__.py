"""Registered queries over the given tables, each with the SQL that checks it."""

from wattframe.catalog.oracle import ORACLE
from wattframe.catalog.queries import QUERIES

__all__ = ["ORACLE", "QUERIES"]
