"""Counts, profiles and the summary tables behind a dashboard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tallywatch.functions.columns import c, quantitative_columns, string_columns, unpivot
from tallywatch.operators.sequence import SequenceRule


def distinct_users(df: DataFrame, user: str) -> DataFrame:
    return df.select(c(user).alias(user)).distinct()


def filter_eq(df: DataFrame, **values) -> DataFrame:
    """Rows equal to every given value."""
    for name, value in values.items():
        df = df.filter(c(name) == F.lit(value))
    return df


def class_distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(c(column)).agg(F.count(F.lit(1)).alias("count"))


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, count, mean, stddev, min, max`` of numeric columns, as numbers."""
    columns = list(columns) if columns is not None else quantitative_columns(df)
    stats = {"mean": F.mean, "stddev": F.stddev_samp, "min": F.min, "max": F.max}
    aggregates = []
    for i, name in enumerate(columns):
        value = c(name).cast("double")
        aggregates.append(F.count(value).alias(f"{i}_count"))
        aggregates += [f(value).alias(f"{i}_{stat}") for stat, f in stats.items()]
    return unpivot(df.agg(*aggregates), columns, {s: "_" + s for s in ("count", *stats)})


def describe_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, count, min, max`` of string columns."""
    columns = list(columns) if columns is not None else string_columns(df)
    stats = {"count": F.count, "min": F.min, "max": F.max}
    aggregates = [
        f(c(name)).alias(f"{i}_{stat}") for i, name in enumerate(columns) for stat, f in stats.items()
    ]
    return unpivot(df.agg(*aggregates), columns, {s: "_" + s for s in stats})


def prediction_counts(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    """One row: ``normal`` predictions of 0 and ``anomaly`` predictions of 1."""
    return df.agg(
        F.count_if(c(prediction) == 0).alias("normal"),
        F.count_if(c(prediction) == 1).alias("anomaly"),
    )


def kpi_summary(labeled: DataFrame, rule: SequenceRule = SequenceRule()) -> DataFrame:
    """One row: ``events``, ``users`` with a failure or reset, ``anomalies``.

    A missing user name counts as one user.
    """
    counted = F.coalesce(rule.counted(), F.lit(False))
    per_user = labeled.groupBy(c(rule.key).alias("user")).agg(
        F.count(F.lit(1)).alias("events"),
        F.max(counted).alias("seen"),
        F.count_if(F.col("label") == 1).alias("anomalies"),
    )
    return per_user.agg(
        F.coalesce(F.sum("events"), F.lit(0)).alias("events"),
        F.count_if("seen").alias("users"),
        F.coalesce(F.sum("anomalies"), F.lit(0)).alias("anomalies"),
    )


def top_users(hits: DataFrame, n: int = 10, user: str = "user") -> DataFrame:
    """Users with the most flagged rows, ties by user."""
    counts = hits.groupBy(c(user)).agg(F.count(F.lit(1)).alias("anomalies"))
    return counts.orderBy(F.desc("anomalies"), c(user)).limit(n)


def rule_counts(hits: DataFrame) -> DataFrame:
    return hits.groupBy("rule").agg(F.count(F.lit(1)).alias("anomalies"))


def class_by_dimension(df: DataFrame, dimension: str, cls: str) -> DataFrame:
    """Rows per value of ``dimension`` and class."""
    return df.groupBy(c(dimension), c(cls)).agg(F.count(F.lit(1)).alias("count"))


def preview(df: DataFrame, order: str, n: int = 10, label: str = "label") -> DataFrame:
    """The first ``n`` rows by ``order`` with a mark on flagged ones."""
    return df.orderBy(c(order)).limit(n).withColumn("is_flagged", c(label) == 1)
