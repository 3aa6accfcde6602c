"""Regular time series: counts per step with the empty steps filled, and changes over time.

Steps are whole multiples of a width since 1970. A key's calendar runs from its first step to its
last, made from its two ends: no table of all steps meets all keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, functions as F

from tallywatch.functions.columns import c
from tallywatch.operators.pieces import same_key, span, ticks
from tallywatch.session import stage

_MERGE = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}


def regular_series(
    df: DataFrame,
    by: Sequence[str],
    at: str,
    step: timedelta | int,
    values: dict[str, tuple[str, Column]],
) -> DataFrame:
    """``by``, ``step`` (its first tick) and the values, one row per key and step.

    ``values`` maps a name to a kind (``count``, ``sum``, ``min``, ``max``) and an expression.
    In a step without rows counts are 0 and the others null. Rows without a time are left
    out; null keys are one key.
    """
    wide = F.lit(span(step)).cast("bigint")
    time = ticks(df, at)
    floor = time - F.pmod(time, wide)
    groups = stage(
        df.filter(time.isNotNull())
        .groupBy(*[c(n) for n in by], floor.alias("step"))
        .agg(*[_MERGE[kind](e).alias(n) for n, (kind, e) in values.items()]),
        "steps",
    )
    ends = groups.groupBy(*[c(n) for n in by]).agg(F.min("step").alias("_a"), F.max("step").alias("_b"))
    calendar = ends.select(*[c(n) for n in by], F.explode(F.sequence("_a", "_b", wide)).alias("step"))
    held = groups.select(
        *[c(n).alias("_of_" + n) for n in by], F.col("step").alias("_of_step"), *[c(n) for n in values]
    )
    same = F.col("step") == F.col("_of_step")
    met = calendar.join(held.hint("merge"), same & same_key(by, "_of_") if by else same, "left")
    none = F.lit(0).cast("bigint")
    filled = [F.coalesce(c(n), none).alias(n) if kind == "count" else c(n) for n, (kind, _) in values.items()]
    return met.select(*[c(n) for n in by], "step", *filled)


def with_change(series: DataFrame, by: Sequence[str], value: str, back: timedelta | int) -> DataFrame:
    """The series with ``<value>_before``, ``back`` earlier, and ``<value>_change`` since then.

    Steps before the key's first one have none: both are null there. Each row meets one row, of
    its key and the earlier step, so a key with most of the rows is spread over tasks.
    """
    earlier = series.select(
        *[c(n).alias("_of_" + n) for n in by],
        (F.col("step") + span(back)).alias("_of_step"),
        c(value).alias(value + "_before"),
    )
    same = F.col("step") == F.col("_of_step")
    met = series.join(earlier.hint("merge"), same & same_key(by, "_of_") if by else same, "left")
    before = c(value + "_before")
    return met.select(*[c(n) for n in series.columns], before, (c(value) - before).alias(value + "_change"))
