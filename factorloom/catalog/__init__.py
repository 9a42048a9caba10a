"""Queries over the driver tables, each with the SQL that it must equal where SQL can say it."""

from . import dsl, evaluation, market, portfolio, runtime, tables  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
