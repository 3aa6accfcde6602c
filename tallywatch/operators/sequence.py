"""The consecutive-failure rule and the per-user state it leaves behind.

A failure is flagged when it is at least the ``threshold``-th failure since the
user's last reset. Only failures and resets matter to that question, and a
failure qualifies exactly when the ``threshold - 1`` such events before it were
failures too. So the rule is a look-back of fixed length within the user, one
shuffle of the failures and resets; all other rows stay where they are.

A user who holds too many rows for one task is cut into pieces along the order
column: the rows of such users are range-partitioned by it, and the partition is the piece.
The first ``threshold - 1`` rows of a piece need rows of earlier pieces: these heads, and the
last ``threshold - 1`` rows of every piece, meet in a second, far smaller shuffle by user.
Users are counted exactly; how many are cut, and into how many pieces, follows from their rows.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallywatch.functions.columns import c
from tallywatch.operators.ordered import TASK_ROWS, partitions_for
from tallywatch.session import stage

#: A side of a join is broadcast only if it was counted to have no more rows.
BROADCAST_ROWS = 10_000


@dataclass(frozen=True)
class SequenceRule:
    """``threshold`` failures of one ``key`` in a row, in ``order``.

    ``order`` is never null and unique within a user. A user with more than ``task_rows``
    failures and resets is cut, along ranges that hold about ``piece_rows`` of such users'
    rows (``task_rows`` if not given).
    """

    # The rule's title, the log's column names and task names.
    name: str = "Anomalous Login Failure Attempted"
    key: str = "TargetUserName"
    order: str = "id"
    event: str = "Task"
    fail: str = "LoginFailure"
    reset: str = "LogOn"
    threshold: int = 3
    task_rows: int = TASK_ROWS
    piece_rows: int | None = None

    def __post_init__(self) -> None:
        if self.threshold < 1:
            raise ValueError("threshold must be at least 1")

    def failed(self) -> Column:
        return c(self.event).eqNullSafe(self.fail)

    def counted(self) -> Column:
        """Rows that move the counter."""
        return c(self.event).isin(self.fail, self.reset)


def _split(rows: DataFrame, rule: SequenceRule) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary users, and those of busy ones with their ``_piece``, if there are any.

    Pieces ascend along the order. The busy rows are staged, so that all their readers see
    the same pieces.
    """
    counts = rows.groupBy(c(rule.key).alias("_busy")).agg(F.count(F.lit(1)).alias("_rows"))
    users = stage(counts.filter(F.col("_rows") > rule.task_rows), "busy-users")
    found, held = users.agg(F.count(F.lit(1)), F.sum("_rows")).first()
    if not found:
        return rows, None
    keys = users.select("_busy")
    keys = F.broadcast(keys) if found <= BROADCAST_ROWS else keys
    same = c(rule.key).eqNullSafe(F.col("_busy"))
    # The rows of any one user in a range are no more than all rows in it.
    parts = partitions_for(rows, held, rule.piece_rows or rule.task_rows)
    busy = rows.join(keys, same, "left_semi").repartitionByRange(parts, c(rule.order))
    pieces = stage(busy.withColumn("_piece", F.spark_partition_id()), "pieces")
    return rows.join(keys, same, "left_anti"), pieces


def _runs(df: DataFrame, rule: SequenceRule, thresholds: list[int]) -> DataFrame:
    """The failure rows of ``df``, and per threshold ``_run_<n>``: failures in the last n rows.

    All thresholds share one shuffle and one sort.
    """
    columns = [n for n in df.columns if n.lower() != "label"]
    back = max(thresholds) - 1
    held = (rule.key.lower(), rule.order.lower())
    # A reset row only has to be present: its other columns stay behind.
    rows = df.filter(rule.counted()).select(
        *[c(n) if n.lower() in held else F.when(rule.failed(), c(n)).alias(n) for n in columns],
        rule.failed().cast("int").alias("_fail"),
    )
    user = Window.partitionBy(c(rule.key)).orderBy(c(rule.order))

    def runs(window) -> dict[str, Column]:
        return {
            f"_run_{n}": F.sum("_fail").over(window.rowsBetween(1 - n, 0)) for n in thresholds
        }

    whole, pieces = _split(rows, rule)
    flagged = whole.withColumns(runs(user))
    if pieces is not None:
        group = Window.partitionBy(c(rule.key), "_piece").orderBy(c(rule.order))
        ends = {
            "_position": F.row_number().over(group),
            "_tail": F.lead(c(rule.order), back).over(group).isNull() if back else F.lit(False),
        }
        local = pieces.withColumns({**ends, **runs(group)})
        head = F.col("_position") <= back
        heads = local.filter(head | F.col("_tail")).withColumns(runs(user)).filter(head)
        for part in (local.filter(~head), heads):
            flagged = flagged.unionByName(part.select(*flagged.columns))
    return flagged.filter("_fail = 1").drop("_fail")


def flag_failures(df: DataFrame, rule: SequenceRule) -> DataFrame:
    """The failure rows of ``df`` with their ``label`` (0 or 1)."""
    columns = [n for n in df.columns if n.lower() != "label"]
    if rule.threshold == 1:
        return df.filter(rule.failed()).select(*map(c, columns), F.lit(1).alias("label"))
    hit = F.col(f"_run_{rule.threshold}") == rule.threshold
    return _runs(df, rule, [rule.threshold]).select(
        *map(c, columns), hit.cast("int").alias("label")
    )


def consecutive_failures(df: DataFrame, rule: SequenceRule = SequenceRule()) -> DataFrame:
    """``df`` with ``label`` = 1 on every third-in-a-row-or-later failure."""
    columns = [n for n in df.columns if n.lower() != "label"]
    others = df.filter(~rule.failed()).select(*map(c, columns), F.lit(0).alias("label"))
    return others.unionByName(flag_failures(df, rule))


def rule_hits(df: DataFrame, rules: list[SequenceRule]) -> DataFrame:
    """One row per flagged event and rule: ``rule``, ``user``, ``id``.

    Rules that differ in name and threshold only are judged in one pass.
    """
    alike: dict[SequenceRule, list[SequenceRule]] = {}
    for r in rules:
        alike.setdefault(replace(r, name="", threshold=1), []).append(r)
    result = None
    for shared, group in alike.items():
        narrow = df.select(*map(c, dict.fromkeys((shared.key, shared.order, shared.event))))
        runs = _runs(narrow, shared, sorted({r.threshold for r in group}))
        names = F.array(
            *[
                F.when(F.col(f"_run_{r.threshold}") == r.threshold, F.lit(r.name))
                for r in group
            ]
        )
        hits = runs.select(
            F.explode(F.array_compact(names)).alias("rule"),
            c(shared.key).alias("user"),
            c(shared.order).alias("id"),
        )
        result = hits if result is None else result.unionByName(hits)
    return result


def user_state(df: DataFrame, rule: SequenceRule = SequenceRule()) -> DataFrame:
    """Failures since the last reset, per user with a failure or a reset.

    Each piece of a user is reduced to one row first, so a busy user reaches
    the last step as one row per piece.
    """
    rows = df.filter(rule.counted()).select(
        c(rule.key), c(rule.order), rule.failed().alias("_fail")
    )
    whole, pieces = _split(rows, rule)
    cut = whole.withColumn("_piece", F.lit(0))
    if pieces is not None:
        cut = cut.unionByName(pieces)
    group = Window.partitionBy(c(rule.key), "_piece")
    reset_at = F.max(F.when(~F.col("_fail"), c(rule.order))).over(group)
    still_open = F.col("_reset").isNull() | (c(rule.order) > F.col("_reset"))
    parts = (
        cut.withColumn("_reset", reset_at)
        .groupBy(c(rule.key).alias("user"), "_piece")
        .agg(F.count_if(F.col("_fail") & still_open).alias("_n"), F.max("_reset").alias("_reset"))
    )
    if pieces is None:
        return parts.select("user", F.col("_n").alias("failures"))
    last = F.max(F.when(F.col("_reset").isNotNull(), F.col("_piece"))).over(
        Window.partitionBy("user")
    )
    counts = F.when(F.col("_last").isNull() | (F.col("_piece") >= F.col("_last")), F.col("_n"))
    return (
        parts.withColumn("_last", last)
        .groupBy("user")
        .agg(F.coalesce(F.sum(counts), F.lit(0)).cast("bigint").alias("failures"))
    )
