"""Helpers for building column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value) with value computed once, however often `of` uses it.

    Inside a lambda, and in nested expressions, Spark would compute it at every use.
    """
    return F.element_at(F.transform(F.array(value), of), 1)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once for each row, whatever stands on it later.

    A filter or several uses of a projected column would make the optimiser compute it at each
    of them; a generator's output it leaves alone.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))
