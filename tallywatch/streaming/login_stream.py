"""The failure rule and failure counts on a stream; Spark keeps watermark, state and commits.

Both results are append-only streams: a row appears once the watermark has passed it and is
final then. Rows may arrive in any order within ``delay``; later ones are left out, as Spark does
with late rows, and so are rows without a time. Times are ``timestamp`` or ``timestamp_ntz``
columns, the latter read in the session's time zone.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallywatch.functions.columns import c
from tallywatch.operators.sequence import SequenceRule


def _interval(width: timedelta) -> str:
    return f"{width // timedelta(microseconds=1)} microseconds"


def failure_windows(
    stream: DataFrame, rule: SequenceRule, time: str, width: timedelta, delay: timedelta
) -> DataFrame:
    """``started``, ``ended``, ``user``, ``failures`` per window of ``width`` and user.

    The counts are Spark's own windowed aggregation: each task adds its rows up before the
    shuffle, so a user with most of the rows is no more to the state than another one.
    """
    return (
        stream.filter(rule.failed() & c(time).isNotNull())
        .select(c(time).cast("timestamp").alias("_at"), c(rule.key).alias("user"))
        .withWatermark("_at", _interval(delay))
        .groupBy(F.window("_at", _interval(width)), "user")
        .agg(F.count(F.lit(1)).alias("failures"))
        .select(F.col("window.start").alias("started"), F.col("window.end").alias("ended"), "user", "failures")
    )


def _judged(threshold: int):
    # Shipped as a whole to the Python workers, so it refers to nothing around it.
    def judged(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Judge the rows the watermark has passed, in order; the others wait in the state."""
        import pandas

        run, ids, times, fails = state.get if state.exists else (0, [], [], [])
        ids, times, fails = list(ids), list(times), list(fails)
        for part in parts:
            ids += part["_id"].tolist()
            times += part["_micros"].tolist()
            fails += part["_fail"].tolist()
        mark = state.getCurrentWatermarkMs()
        flagged, flagged_at, waiting = [], [], []
        for i, time, fail in sorted(zip(ids, times, fails)):
            if time > mark * 1000:
                waiting.append((i, time, fail))
                continue
            run = run + 1 if fail else 0
            if fail and run >= threshold:
                flagged.append(i)
                flagged_at.append(time)
        ids, times, fails = ([w[x] for w in waiting] for x in range(3))
        state.update((run, ids, times, fails))
        if waiting:
            state.setTimeoutTimestamp(min(times) // 1000 + 1)
        yield pandas.DataFrame({"user": [key[0]] * len(flagged), "id": flagged, "micros": flagged_at})

    return judged


def flagged_failures(stream: DataFrame, rule: SequenceRule, time: str, delay: timedelta) -> DataFrame:
    """``user``, ``id``, ``micros``: the failures that the rule flags.

    Per user the state holds the failures since the last reset and the counted rows that the
    watermark has not passed, at most those of the last ``delay``. The order column must not
    run against the time column.
    """
    rows = (
        stream.filter(rule.counted() & c(time).isNotNull())
        .select(
            c(rule.key).alias("user"),
            c(rule.order).cast("bigint").alias("_id"),
            c(time).cast("timestamp").alias("_at"),
            rule.failed().alias("_fail"),
        )
        .withColumn("_micros", F.unix_micros("_at"))
        .withWatermark("_at", _interval(delay))
    )
    kind = rows.schema["user"].dataType.simpleString()
    return rows.groupBy("user").applyInPandasWithState(
        _judged(rule.threshold),
        f"user {kind}, id bigint, micros bigint",
        "run bigint, ids array<bigint>, times array<bigint>, fails array<boolean>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def write_stream(result: DataFrame, folder: str, trigger: dict | None = None) -> StreamingQuery:
    """Append a result to parquet files in ``folder``; a restart goes on where it ended."""
    return (
        result.writeStream.format("parquet")
        .outputMode("append")
        .option("path", folder + "/output")
        .option("checkpointLocation", folder + "/checkpoint")
        .trigger(**(trigger or {"processingTime": "1 minute"}))
        .start()
    )
