"""Column choice by name or type, and null handling: null is the only mark of a missing value inside the library."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONSTANT_RTOL, CONSTANT_ATOL = 1e-8, 1e-12


def by_pattern(df: DataFrame, columns: list[str] | None, pattern: str) -> list[str]:
    """``columns`` if given, otherwise those whose name holds a match of ``pattern``."""
    if columns is not None:
        if missing := [c for c in columns if c not in df.columns]:
            raise KeyError(f"columns not found: {missing}")
        return list(columns)
    found = [c for c in df.columns if re.search(pattern, c)]
    if not found:
        raise ValueError(f"no column matches {pattern!r}")
    return found


def numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType))]


def missing_to_null(c: Column) -> Column:
    """A double with NaN as null."""
    c = c.cast("double")
    return F.when(~F.isnan(c), c)


def finite(c: Column) -> Column:
    """A double, null where it is missing or infinite."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def is_constant(x: Column, first: Column) -> Column:
    """Aggregate: do all values equal the first within tolerance?"""
    return ~F.coalesce(F.bool_or(F.abs(x - first) > CONSTANT_ATOL + CONSTANT_RTOL * F.abs(first)), F.lit(False))


def min_max_scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column scaled to 0 .. 1 by its least and greatest value; a column without span becomes 0."""
    bounds = df.agg(*[f(F.col(c)).alias(f"_{k}_{i}") for i, c in enumerate(columns) for k, f in (("lo", F.min), ("hi", F.max))])
    joined = df.crossJoin(F.broadcast(bounds))  # one row
    return joined.select(*[c for c in df.columns if c not in columns], *[F.coalesce(F.try_divide(F.col(c) - F.col(f"_lo_{i}"), F.col(f"_hi_{i}") - F.col(f"_lo_{i}")), F.when(F.col(c).isNotNull(), F.lit(0.0))).alias(c) for i, c in enumerate(columns)]).select(*df.columns)
