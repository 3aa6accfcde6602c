"""Two tables compared as multisets: rows may repeat, null equals null.

Rows are counted with a sign, which combines before the one shuffle, so a row that both
tables hold a million times is one group. Tables have the same columns, in any order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallywatch.functions.columns import c
from tallywatch.operators.pieces import same_key


def row_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every distinct row with its number in each table, ``_left`` and ``_right``."""
    names = left.columns
    if set(names) != set(right.columns) or len(names) != len(right.columns):
        raise ValueError(f"columns differ: {names} and {right.columns}")

    def signed(df: DataFrame, one: int) -> DataFrame:
        ends = [F.lit(one).cast("bigint").alias("_left"), F.lit(1 - one).cast("bigint").alias("_right")]
        return df.select(*[c(n) for n in names], *ends)

    return (
        signed(left, 1)
        .unionByName(signed(right, 0))
        .groupBy(*[c(n) for n in names])
        .agg(F.sum("_left").alias("_left"), F.sum("_right").alias("_right"))
    )


def _repeated(counts: DataFrame, names: Sequence[str], times: Column) -> DataFrame:
    """Each row so many times."""
    held = counts.withColumn("_times", times).filter("_times > 0")
    return held.select(*[c(n) for n in names], F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_again")).drop("_again")


def except_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """The rows of ``left`` without those of ``right``, one for one."""
    return _repeated(row_counts(left, right), left.columns, F.col("_left") - F.col("_right"))


def intersect_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """The rows both hold, as often as both do."""
    return _repeated(row_counts(left, right), left.columns, F.least("_left", "_right"))


def changes(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """What became of ``old``: its columns, ``change`` and ``times``, one row per distinct row.

    ``times`` is how many more (or, negative, fewer) of the row ``new`` holds; rows held equally
    often are left out. ``change`` is ``added`` or ``removed``, or ``changed`` where rows
    of one key were both added and removed.
    """
    net = row_counts(old, new).withColumn("times", F.col("_right") - F.col("_left")).filter("times <> 0")
    keys = net.groupBy(*[c(n).alias("_key_" + n) for n in key]).agg(
        (F.max("times") > 0).alias("_added"), (F.min("times") < 0).alias("_removed")
    )
    both = keys.filter("_added and _removed").drop("_added", "_removed").withColumn("_both", F.lit(True))
    change = F.when(F.col("_both"), "changed").when(F.col("times") > 0, "added").otherwise("removed")
    met = net.join(both.hint("merge"), same_key(key, "_key_"), "left")
    return met.select(*[c(n) for n in old.columns], change.alias("change"), "times")
