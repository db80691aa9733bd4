"""Checks on tables, written as ordinary DataFrame operations."""

from plumbline.operators import *  # noqa: F401,F403
from plumbline.operators import __all__ as _operators
from plumbline.sources import read_report, read_table, write_report

__all__ = [*_operators, "read_report", "read_table", "write_report"]
