"""Class balancing and the train/test split, both repeatable row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallywatch.functions.columns import c
from tallywatch.functions.keys import digest_bucket, row_digest
from tallywatch.operators.ordered import ranked

# Leading hex digits of the digest by which the larger class is counted first: 65,536 counts.
DIGITS = 4


def balance(
    df: DataFrame,
    label: str = "label",
    key: str = "id",
    ratio: float | None = 1.0,
    minority: int = 1,
    majority: int = 0,
) -> DataFrame:
    """All ``minority`` rows and exactly ``int(minority count * ratio)`` of the others.

    Majority rows are taken in the order of their key's digest. Counts per digest prefix
    find the prefix where the quota runs out: prefixes before it are kept by a filter, and
    the rows of that one are put in order by ranges, as many as their number asks for. Rows
    of neither class go. ``ratio=None`` keeps both classes whole.
    """
    rare, common = c(label) == minority, c(label) == majority
    if ratio is None:
        return df.filter(rare | common)
    prefix = F.substring(row_digest(c(key)), 1, DIGITS)
    edge = _edge(df.filter(rare | common), rare, prefix, ratio)
    if edge is None:
        return df.filter(rare | common)
    at_edge, left = edge
    # Rows of one key are told apart by their content; equal rows are interchangeable.
    ties = {
        "_digest": row_digest(c(key)),
        "_row": F.xxhash64(*map(c, df.columns)),
        "_any": F.monotonically_increasing_id(),
    }
    last = ranked(
        df.filter(common & (prefix == at_edge)).withColumns(ties),
        [F.col(n).asc() for n in ties],
        "_rank",
    )
    last = last.filter(F.col("_rank") < left).select(*[c(n) for n in df.columns])
    return df.filter(rare | (common & (prefix < at_edge))).unionByName(last)


def _edge(df: DataFrame, rare: Column, prefix: Column, ratio: float) -> tuple[str, int] | None:
    """The prefix in which the quota runs out and how many of its rows are left
    to take; None when there are too few rows to run out."""
    # One pass over the rows leaves at most 16 ** DIGITS counts and one more.
    counts = df.groupBy(F.when(~rare, prefix).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    found = {r["prefix"]: r["n"] for r in counts.collect()}
    quota = int(found.pop(None, 0) * ratio)
    for name in sorted(found):
        if found[name] >= quota:
            return name, quota
        quota -= found[name]
    return None


def train_test_split(
    df: DataFrame, key: str = "id", train_tenths: int = 8
) -> tuple[DataFrame, DataFrame]:
    """Rows split by their key's digest into ten parts, ``train_tenths`` for training."""
    part = digest_bucket(c(key), 10)
    return df.filter(part < train_tenths), df.filter(part >= train_tenths)
