"""Global order without a global task: dense ids and running totals.

Spark range-partitions the rows by the whole order and the result is staged, so every row
has a fixed partition and place. What comes before a partition are the totals of the earlier
ones: one row per partition is all that a single task ever adds up. The number of partitions
follows the measured rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallywatch.functions.columns import c
from tallywatch.session import stage

#: Rows that one task sorts.
TASK_ROWS = 2_000_000


def partitions_for(df: DataFrame, rows: int, task_rows: int = TASK_ROWS) -> int:
    """Partitions so that one holds about ``task_rows``; never fewer than a shuffle has."""
    shuffle = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(shuffle, math.ceil(rows / task_rows))


def placed(df: DataFrame, order: list[Column], name: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """``df`` staged in order, with its ``_part`` and the 0-based ``_place`` in it."""
    parts = partitions_for(df, df.count(), task_rows)
    at = F.monotonically_increasing_id()
    sorted_rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return stage(sorted_rows.withColumn("_at", at), name).select(
        *[c(n) for n in df.columns],
        F.shiftright("_at", 33).alias("_part"),
        F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"),
    )


def _before(totals: DataFrame, sums: list[str]) -> DataFrame:
    """Exclusive running sums over the totals of the partitions."""
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        "_part", *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias("_before_" + s) for s in sums]
    )


def ranked(
    df: DataFrame, order: list[Column], name: str, task_rows: int = TASK_ROWS
) -> DataFrame:
    """``df`` with a dense 0-based position in the given total order, of any types."""
    rows = placed(df, order, name, task_rows)
    totals = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("rows"))
    # One row per partition.
    return rows.join(F.broadcast(_before(totals, ["rows"])), "_part").select(
        *[c(n) for n in df.columns],
        (F.col("_before_rows") + F.col("_place")).cast("bigint").alias(name),
    )


def dense_id(
    df: DataFrame, lead: str, tie: str, name: str = "id", task_rows: int = TASK_ROWS
) -> DataFrame:
    """Number the rows 1, 2, ... by (``lead``, ``tie``), nulls first.

    Both may be of any type that Spark can sort; ``tie`` is unique among rows of equal
    ``lead``. A ``lead`` that many rows share is cut along ``tie``.
    """
    rows = ranked(df, [c(lead).asc(), c(tie).asc()], "_id", task_rows)
    return rows.select((F.col("_id") + 1).alias(name), *[c(n) for n in df.columns])


def running_totals(
    df: DataFrame,
    order: str,
    sums: dict[str, Column],
    descending: bool = True,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Per distinct ``order`` number the sums, and ``cum_*`` up to and including it.

    ``df`` is evaluated once: equal numbers are merged first, the rest works on them.
    """
    keyed = df.select(c(order).alias("_key"), *[e.alias(n) for n, e in sums.items()])
    keyed = keyed.withColumn("_key", -F.col("_key") if descending else F.col("_key"))
    groups = stage(keyed.groupBy("_key").agg(*[F.sum(n).alias(n) for n in sums]), "groups")
    rows = placed(groups, [F.col("_key").asc()], "running", task_rows)
    before = _before(rows.groupBy("_part").agg(*[F.sum(n).alias(n) for n in sums]), list(sums))
    upto = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    value = -F.col("_key") if descending else F.col("_key")
    return (
        rows.select("*", *[F.sum(n).over(upto).alias("_upto_" + n) for n in sums])
        .join(F.broadcast(before), "_part")
        .select(
            value.alias(order),
            *sums,
            *[(F.col("_before_" + n) + F.col("_upto_" + n)).alias("cum_" + n) for n in sums],
        )
    )
