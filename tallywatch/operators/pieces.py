"""Busy keys cut along an order, and times as whole numbers.

Operators that look along a key's rows in order need them together. A key with more rows than
one task should hold is cut: the rows of all such keys are range-partitioned along the order, and
the partition is the piece. An operator then works within (key, piece) and ties the ends of the
pieces, which are few, together by key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tallywatch.functions.columns import c
from tallywatch.operators.ordered import TASK_ROWS, partitions_for
from tallywatch.session import stage

#: A side of a join is broadcast only if it was counted to have no more rows.
BROADCAST_ROWS = 10_000


@dataclass(frozen=True)
class Cut:
    """A key with more than ``task_rows`` rows is cut into pieces of about ``piece_rows`` rows.

    ``piece_rows`` is ``task_rows`` if not given.
    """

    task_rows: int = TASK_ROWS
    piece_rows: int | None = None


def broadcast_if_few(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for a broadcast if it was counted to have at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def same_key(names: Sequence[str], prefix: str) -> Column:
    """Do the columns equal those named with ``prefix``? Null equals null."""
    return reduce(Column.__and__, [c(n).eqNullSafe(c(prefix + n)) for n in names])


def cut_busy(
    rows: DataFrame, key: Sequence[str], order: Sequence[Column], cut: Cut, most: int | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary keys, and the staged rows of busy ones with their ``_piece``.

    Pieces ascend along ``order``; there are at most ``most`` of them. The second is None if
    there is no busy key. ``rows`` is read up to three times.
    """
    counts = rows.groupBy(*[c(n).alias("_busy_" + n) for n in key]).agg(
        F.count(F.lit(1)).alias("_rows")
    )
    busy = stage(counts.filter(F.col("_rows") > cut.task_rows), "busy-keys")
    held = busy.agg(F.sum("_rows")).first()[0]
    if not held:
        return rows, None
    keys = broadcast_if_few(busy.drop("_rows"))
    same = same_key(key, "_busy_")
    # The rows of any one key in a range are no more than all rows in it.
    parts = partitions_for(rows, held, cut.piece_rows or cut.task_rows)
    parts = parts if most is None else max(1, min(parts, most))
    ranges = rows.join(keys, same, "left_semi").repartitionByRange(parts, *order)
    pieces = stage(ranges.withColumn("_piece", F.spark_partition_id()), "pieces")
    return rows.join(keys, same, "left_anti"), pieces


def ticks(df: DataFrame, name: str) -> Column:
    """A time as microseconds, a date too; whole numbers as they are."""
    kind = dict(df.dtypes)[name]
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return c(name).cast("bigint")
    if kind == "timestamp":
        return F.unix_micros(c(name))
    if kind in ("timestamp_ntz", "date"):
        zero = F.lit("1970-01-01").cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", zero, c(name).cast("timestamp_ntz"))
    raise TypeError(f"{name} is {kind}, neither a time nor a whole number")


def span(width: timedelta | int) -> int:
    """A width in ticks."""
    wide = width // timedelta(microseconds=1) if isinstance(width, timedelta) else width
    if wide < 0:
        raise ValueError("a width must not be negative")
    return wide
