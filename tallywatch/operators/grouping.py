"""Grouping sets, rollup and cube from the finest groups.

The rows are grouped once, by all dimensions, and combine before that shuffle. Subtotals come
from the groups, which are as many as the data has combinations, never from the rows again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallywatch.functions.columns import c

_MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def _partial(kind: str, value: Column) -> Column:
    return F.count(value) if kind == "count" else _MERGE[kind](value)


def grouping_sets(
    df: DataFrame, sets: Sequence[Sequence[str]], values: dict[str, tuple[str, Column]]
) -> DataFrame:
    """One row per set and group in it: the dimensions, ``level`` and the aggregates.

    ``values`` maps a name to a kind (``count``, ``sum``, ``min``, ``max``) and an expression.
    ``level`` has a bit for each dimension, the first one highest, that is set where the row
    is a subtotal over it: a null dimension without its bit is a group of nulls. An empty
    table has no groups and no subtotals.
    """
    dimensions = list(dict.fromkeys(n for s in sets for n in s))
    merge = [_MERGE[kind](c(n)).alias(n) for n, (kind, _) in values.items()]
    none = {n: F.coalesce(c(n), F.lit(0)).cast("bigint") for n, (kind, _) in values.items() if kind == "count"}
    if not dimensions:
        totals = df.agg(*[_partial(kind, e).alias(n) for n, (kind, e) in values.items()])
        return totals.select(F.lit(0).cast("bigint").alias("level"), *values)
    finest = df.groupBy(*[c(n) for n in dimensions]).agg(
        *[_partial(kind, e).alias(n) for n, (kind, e) in values.items()]
    )
    grouped = finest.groupingSets([[c(n) for n in s] for s in sets], *[c(n) for n in dimensions])
    found = grouped.agg(F.grouping_id().cast("bigint").alias("level"), *merge).withColumns(none)
    return found.select(*[c(n) for n in dimensions], "level", *[c(n) for n in values])


def rollup(df: DataFrame, dimensions: Sequence[str], values: dict[str, tuple[str, Column]]) -> DataFrame:
    """Groups by all dimensions, by all but the last, and so on to the total."""
    return grouping_sets(df, [dimensions[:i] for i in range(len(dimensions), -1, -1)], values)


def cube(df: DataFrame, dimensions: Sequence[str], values: dict[str, tuple[str, Column]]) -> DataFrame:
    """Groups by every subset of the dimensions."""
    subsets = range((1 << len(dimensions)) - 1, -1, -1)
    return grouping_sets(
        df, [[n for i, n in enumerate(dimensions) if s >> i & 1] for s in subsets], values
    )
