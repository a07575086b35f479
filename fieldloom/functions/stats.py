"""Aggregates that are defined where the built-in ones fail."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def correlation(x: str, y: str) -> Column:
    """Pearson's correlation over rows that have both values; null where either is constant."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    spread = F.var_pop(F.when(both, F.col(x))) * F.var_pop(F.when(both, F.col(y)))
    return F.try_divide(F.covar_pop(x, y), F.sqrt(spread))
