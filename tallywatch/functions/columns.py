"""Column lookup by type, and names that may hold dots."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

# The dtypes treated as quantitative.
QUANTITATIVE = ("int", "bigint", "double", "float")


def c(name: str) -> Column:
    """Column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def string_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    return [n for n, t in df.dtypes if t == "string" and n not in set(exclude)]


def quantitative_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    return [n for n, t in df.dtypes if t in QUANTITATIVE and n not in set(exclude)]


def time_columns(df: DataFrame) -> list[str]:
    return [n for n, t in df.dtypes if t in ("timestamp", "timestamp_ntz", "date")]


def as_number(df: DataFrame, name: str) -> Column:
    """A double that never decreases along the column's order; times in seconds."""
    kind = dict(df.dtypes)[name]
    if kind in ("date", "timestamp_ntz"):
        day = F.datediff(c(name).cast("date"), F.lit("1970-01-01").cast("date")) * 86400.0
        if kind == "date":
            return day
        # Fields instead of a cast: time zone changes must not reorder the values.
        return day + F.hour(c(name)) * 3600 + F.minute(c(name)) * 60 + F.second(c(name))
    if kind == "timestamp":
        return F.unix_micros(c(name)) / 1e6
    return c(name).cast("double")


def unpivot(one_row: DataFrame, names: list[str], fields: dict[str, str]) -> DataFrame:
    """Turn a one-row aggregate into one row per profiled column.

    ``fields`` maps an output field to the suffix its aggregate columns carry.
    """
    entries = [
        F.struct(
            F.lit(name).alias("column"),
            *[c(f"{i}{suffix}").alias(field) for field, suffix in fields.items()],
        )
        for i, name in enumerate(names)
    ]
    return one_row.select(F.inline(F.array(*entries)))
