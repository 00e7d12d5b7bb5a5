"""Fallback scores for rules of other miners, where their files state none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def by_rows(rows: Column, full: int = 1000) -> Column:
    """A share of full rows, at most 1."""
    return F.least(F.lit(1.0), rows / full)


def inverse_rows(rows: Column, base: int = 100, default: float = 0.5) -> Column:
    """base over rows, at most 1; the default where rows are unknown or none."""
    return F.when(rows > 0, F.least(F.lit(1.0), base / rows)).otherwise(default)


def stated_or(value: Column, fallback: Column) -> Column:
    return F.when(value > 0, value).otherwise(fallback)
