"""The labeled table: adding ids and labels, and raising labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallywatch.functions.columns import c
from tallywatch.operators.ordered import dense_id


def create_labeled(df: DataFrame, lead: str, tie: str) -> DataFrame:
    """``df`` with a dense increasing ``id`` in front and ``label`` 0 at the end."""
    return dense_id(df, lead, tie, "id").withColumn("label", F.lit(0))


def update_label(df: DataFrame, flagged: DataFrame, key: str = "id", label: str = "label") -> DataFrame:
    """Set ``label`` to 1 where ``key`` is in ``flagged``; a 1 is never taken back.

    Keys are unique in ``df``, so the join cannot skew. Whether the flagged
    keys are broadcast is decided from their measured size.
    """
    keys = flagged.select(c(key).alias(key)).distinct().withColumn("_hit", F.lit(1))
    raised = F.greatest(F.coalesce(c(label), F.lit(0)), F.coalesce(F.col("_hit"), F.lit(0)))
    return (
        df.join(keys, key, "left")
        .withColumn(label, raised.cast(dict(df.dtypes)[label]))
        .select(*[c(n) for n in df.columns])
    )
