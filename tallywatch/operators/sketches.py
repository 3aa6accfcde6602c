"""Summaries that merge: distinct counts and frequent values.

A sketch is a column of a stored table. Sketches of any groups merge into that of their union
without a look at the rows, and every one has a known error.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tallywatch.functions.columns import c
from tallywatch.session import stage

# ---------------------------------------------------------------- distinct counts


def distinct_sketches(df: DataFrame, by: Sequence[str], value: str, lg_k: int = 12) -> DataFrame:
    """Per group a HyperLogLog sketch of the distinct values and the number of values; null is none.

    A sketch has ``2 ** lg_k`` slots, about as many bytes at the most, whatever the rows.
    """
    # A group without values has a sketch too, of none.
    return df.groupBy(*[c(n) for n in by]).agg(
        F.hll_sketch_agg(c(value), F.lit(lg_k)).alias("sketch"), F.count(c(value)).alias("rows")
    )


def merged_sketches(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """The sketches of coarser groups: of unions of those in the table."""
    return sketches.groupBy(*[c(n) for n in by]).agg(
        F.hll_union_agg("sketch").alias("sketch"), F.sum("rows").alias("rows")
    )


def trailing_sketches(sketches: DataFrame, day: str, days: int, by: Sequence[str] = ()) -> DataFrame:
    """Per day the sketch of it and the ``days - 1`` days before, for days that have rows.

    Each day's sketch, not its rows, goes to the days it counts for.
    """
    reach = F.explode(F.sequence(F.lit(0), F.lit(days - 1)))
    moved = sketches.select("*", reach.alias("_later")).withColumn(day, F.date_add(c(day), F.col("_later")))
    merged = moved.groupBy(*[c(n) for n in by], c(day)).agg(
        F.hll_union_agg("sketch").alias("sketch"),
        F.sum("rows").alias("rows"),
        F.max(F.col("_later") == 0).alias("_own"),
    )
    return merged.filter("_own").drop("_own")


def with_distinct(sketches: DataFrame) -> DataFrame:
    """The sketches with their estimate, ``distinct``.

    Estimated as a union, which a sketch made by one task is not: Spark estimates that one
    from the order of its rows too, and the number should not depend on who made it.
    """
    return sketches.withColumn("distinct", F.hll_sketch_estimate(F.hll_union("sketch", "sketch")))


def distinct_error(lg_k: int = 12, deviations: float = 3.0) -> float:
    """The relative error that merged sketches stay within, at so many standard deviations."""
    return deviations * 1.04 / math.sqrt(1 << lg_k)


# ---------------------------------------------------------------- frequent values

#: The summary misses a value's count by at most this part of the rows over its tracked values.
SUMMARY_ERROR = 3.5


def heavy_hitters(df: DataFrame, value: str, share: float) -> DataFrame:
    """``value``, ``rows``: exactly the values that hold at least ``share`` of all rows.

    One pass keeps a frequent-items summary per task, merged in one row: no value is shuffled.
    It tracks so many values that none of the share can be missed: a value is reported if it
    is seen more often than twice the summary's error, which is a third of the share at most.
    A second pass counts the candidates, at most as many as are tracked, and keeps those that
    are frequent indeed. Null is a value.
    """
    if not 2e-5 <= share <= 1:
        raise ValueError("the share must be from 0.00002 to 1")
    tracked = math.ceil(3 * SUMMARY_ERROR / share)
    narrow = df.select(c(value).alias("value"))
    summary = stage(
        narrow.agg(
            F.call_function("approx_top_k_accumulate", F.col("value"), F.lit(tracked)).alias("summary"),
            F.count(F.lit(1)).alias("all"),
        ),
        "frequent-summary",
    )
    total = summary.first()["all"]
    if not total:
        return narrow.select("value", F.lit(0).cast("bigint").alias("rows")).limit(0)
    found = F.call_function("approx_top_k_estimate", F.col("summary"), F.lit(tracked))
    candidates = summary.select(F.explode(found).alias("f")).select(F.col("f.item").alias("_candidate"))
    met = narrow.join(F.broadcast(candidates), F.col("value").eqNullSafe(F.col("_candidate")), "left_semi")
    counted = met.groupBy("value").agg(F.count(F.lit(1)).alias("rows"))
    return counted.filter(F.col("rows") >= math.ceil(share * total))


