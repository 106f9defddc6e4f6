"""Tally: append-only tables and double-entry ledgers on Spark."""

from .database import Database
from .plans.sqlgate import SQLSyntaxError, parse_sql
from .tuning import plan_batches

__all__ = ["plan_batches", "Database", "SQLSyntaxError", "parse_sql"]
