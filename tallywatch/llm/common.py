"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A side of a join is broadcast only if it was counted and has no more rows than this.
BROADCAST_ROWS = 10_000

#: What ends a word: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever else the table holds.

    Columns are taken by position, so further columns whose names differ only in case, or
    repeat a name, do no harm: the first exact match wins, else the first in any case.
    """
    return positional(df).select(
        *[F.col(f"_{place(df.columns, name)}").alias(name) for name in names]
    )


def positional(df: DataFrame) -> DataFrame:
    """``df`` with its columns named ``_0``, ``_1``, ...: no name can clash."""
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))])


def place(columns: list[str], name: str) -> int:
    """Where the column is: the first exact match, else the first in any case."""
    exact = [i for i, n in enumerate(columns) if n == name]
    return (exact or [i for i, n in enumerate(columns) if n.lower() == name.lower()])[0]


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def bounded(
    df: DataFrame, rows: int = BROADCAST_ROWS, weight: Column | None = None
) -> DataFrame:
    """``df`` marked for a broadcast if it was counted to have at most ``rows`` rows.

    ``weight`` is the length of a row's array; all together may be ``100 * rows``. A larger
    table stays as it is: the join then shuffles, and AQE splits its skewed partitions.
    """
    heavy = F.sum(F.lit(0) if weight is None else weight)
    found, held = df.limit(rows + 1).agg(F.count(F.lit(1)), heavy).first()
    return F.broadcast(df) if found <= rows and (held or 0) <= 100 * rows else df


def unit_draw(*parts: Column) -> Column:
    """A draw from 0 to 1 that depends on nothing but ``parts`` (48 bits of their MD5)."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Give this package to the Python workers of every executor, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parent.parent
        target = f"{tempfile.mkdtemp()}/{package.name}"
        # Spark's own file server hands the archive to the executors.
        spark.sparkContext.addPyFile(
            shutil.make_archive(target, "zip", package.parent, package.name)
        )
        _shipped.add(app)
