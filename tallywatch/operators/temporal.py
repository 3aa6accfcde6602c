"""Joins and groups along time: as-of, overlap, sessions and time-range frames.

A key may hold any share of the rows: busy ones are cut into pieces (``pieces.cut_busy``), and
what crosses the border of a piece is one row per key and piece, or rows within the width of a
frame. Times are timestamps, dates or whole numbers; widths are ``timedelta`` or whole numbers.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallywatch.functions.columns import c
from tallywatch.operators.pieces import Cut, broadcast_if_few, cut_busy, same_key, span, ticks
from tallywatch.session import stage

# ---------------------------------------------------------------- as-of join


def asof_join(
    left: DataFrame,
    right: DataFrame,
    key: Sequence[str],
    at: str,
    take: dict[str, str],
    tie: str | None = None,
    strict: bool = False,
    within: timedelta | int | None = None,
    cut: Cut = Cut(),
) -> DataFrame:
    """Every row of ``left`` with columns of the last row of ``right`` up to its time.

    ``take`` maps columns of ``right`` to their names in the result. Rows at the very time of
    the left row count unless ``strict``; of several at the last time the highest ``tie`` wins
    (without one, the highest row of ``take``). ``within`` bounds how long ago it may be. As in
    other joins a null key matches nothing, nor does a null time; such rows of ``left`` stay
    with nulls.

    Both tables are merged into one sequence, in which the last right row is carried on: one
    shuffle of both, no pairs. A busy key is cut along time and rows, and the last right row of
    each piece is handed to the pieces after it.
    """
    names = left.columns
    matchable = [c(n).isNotNull() for n in (*key, at)]
    found = F.struct(
        ticks(right, at).alias("_at"),
        (c(tie) if tie else F.lit(None).cast("int")).alias("_tie"),
        *[c(n).alias(f"_{i}") for i, n in enumerate(take)],
    )
    keys = [f"_key_{i}" for i in range(len(key))]
    # At one time: right rows first, or last if only earlier ones count.
    rows = left.filter(_all(matchable)).select(
        *[c(n).alias(k) for n, k in zip(key, keys)],
        ticks(left, at).alias("_time"),
        F.lit(1).alias("_side"),
        F.struct(*[c(n).alias(f"l{i}") for i, n in enumerate(names)]).alias("_left"),
        F.lit(None).cast(right.select(found.alias("f")).schema["f"].dataType).alias("_right"),
    )
    others = right.filter(_all(matchable)).select(
        *[c(n).alias(k) for n, k in zip(key, keys)],
        ticks(right, at).alias("_time"),
        F.lit(2 if strict else 0).alias("_side"),
        F.lit(None).cast(rows.schema["_left"].dataType).alias("_left"),
        found.alias("_right"),
    )
    # The last part only lets rows of one time go to different pieces.
    order = [F.col("_time").asc(), F.col("_side").asc(), F.col("_right").asc(), F.xxhash64("_left").asc()]
    whole, pieces = cut_busy(rows.unionByName(others), keys, order, cut)

    def carried(*group: str) -> Column:
        window = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return F.last("_right", ignorenulls=True).over(window)

    is_left = F.col("_left").isNotNull()
    met = whole.withColumn("_last", carried(*keys)).filter(is_left).select("_left", "_time", "_last")
    if pieces is not None:
        local = pieces.withColumn("_last", carried(*keys, "_piece")).filter(is_left)
        # One row per key and piece: the last right row in it, null if there is none.
        ends = pieces.groupBy(*keys, "_piece").agg(F.max("_right").alias("_end"))
        earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
        before = ends.select(
            *[F.col(k).alias("_of" + k) for k in keys],
            F.col("_piece").alias("_of_piece"),
            F.last("_end", ignorenulls=True).over(earlier).alias("_before"),
        )
        held = _all([F.col(k) == F.col("_of" + k) for k in (*keys, "_piece")])
        filled = local.join(before, held).select(
            "_left", "_time", F.coalesce("_last", "_before").alias("_last")
        )
        met = met.unionByName(filled)
    if within is not None:
        near = F.col("_time") - F.col("_last._at") <= span(within)
        met = met.withColumn("_last", F.when(near, F.col("_last")))
    result = met.select(
        *[F.col(f"_left.l{i}").alias(n) for i, n in enumerate(names)],
        *[F.col(f"_last._{i}").alias(new) for i, new in enumerate(take.values())],
    )
    alone = left.filter(~_all(matchable)).select(
        *[c(n) for n in names],
        *[F.lit(None).cast(right.schema[n].dataType).alias(new) for n, new in take.items()],
    )
    return result.unionByName(alone)


def _all(conditions: Sequence[Column]) -> Column:
    held = F.lit(True)
    for one in conditions:
        held = held & one
    return held


# ---------------------------------------------------------------- interval overlap

#: The intervals of a level are up to so many times as long as those of the level below, and
#: as its buckets are wide.
GROWTH = 4

#: A side of a full bucket is dealt to so many tasks at most, or to more if the other side,
#: which every one of them needs, is so much smaller: copies stay in proportion to the rows.
PARTS = 8


def _level(length: Column) -> Column:
    """The lowest level whose intervals may be ``length`` ticks long."""
    level = F.lit(0)
    longest = 1
    for i in range(1, 32):
        level = F.when(length > longest, i).otherwise(level)
        longest *= GROWTH
    return level


def _width(level: int) -> int:
    return GROWTH ** max(level - 1, 0)


def _down(value: Column, width: Column) -> Column:
    """The number of the bucket: division that rounds down, in whole numbers."""
    return F.call_function("div", value - F.pmod(value, width), width)


def _bucketed(rows: DataFrame, levels: list[int], home: bool) -> DataFrame:
    """Intervals in the buckets they touch at their own level, or in which they begin at ``levels``."""
    if not home:
        widths = {i: F.lit(_width(i)).cast("bigint") for i in levels}
        begins = [
            F.struct(F.lit(i).alias("_level"), _down(F.col("_from"), w).alias("_bucket"))
            for i, w in widths.items()
        ]
        return rows.select("*", F.inline(F.array(*begins)))
    leveled = rows.withColumn("_level", _level(F.col("_to") - F.col("_from")))
    widths = F.array(*[F.lit(_width(i)).cast("bigint") for i in range(32)])
    width = F.element_at(widths, F.col("_level") + 1)
    first, last = _down(F.col("_from"), width), _down(F.col("_to"), width)
    return leveled.withColumn("_bucket", F.explode(F.sequence(first, last)))


def _met(points: DataFrame, intervals: DataFrame, keys: list[str], task_rows: int, strict: bool) -> DataFrame:
    """Pairs of a row of ``points`` that begins in one of ``intervals``; a full bucket is a grid of tasks.

    A row begins in one bucket of a level, so a pair is met once. ``strict`` leaves out those
    that begin together.
    """
    place = [*keys, "_level", "_bucket"]
    yes, no = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    full = (
        points.select(*place, yes.alias("_p"), no.alias("_i"))
        .unionByName(intervals.select(*place, no.alias("_p"), yes.alias("_i")))
        .groupBy(*[F.col(n).alias("_full" + n) for n in place])
        .agg(F.sum("_p").alias("_p"), F.sum("_i").alias("_i"))
        .filter((F.least("_p", "_i") > 0) & (F.greatest("_p", "_i") > task_rows))
    )

    def parts(own: str, other: str) -> Column:
        most = F.greatest(F.lit(PARTS), F.ceil(F.col(own) / F.col(other)))
        return F.least(F.ceil(F.col(own) / task_rows), most).cast("int")

    # A full bucket has more than task_rows rows, so these are few.
    full = stage(full.withColumns({"_p": parts("_p", "_i"), "_i": parts("_i", "_p")}), "full-buckets")
    grid = broadcast_if_few(full)
    met = _all([F.col(n) == F.col("_full" + n) for n in place])

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        joined = side.join(grid, met, "left")
        part = F.pmod(F.xxhash64("_id"), F.coalesce(own, F.lit(1))).cast("int")
        all_parts = F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)
        return joined.withColumn(f"_part{own}", part).withColumn(f"_part{other}", F.explode(all_parts))

    on = place
    if not full.isEmpty():
        points, intervals = dealt(points, "_p", "_i"), dealt(intervals, "_i", "_p")
        on = [*place, "_part_p", "_part_i"]

    def values(side: DataFrame) -> list[str]:
        return [n for n in side.columns if n.startswith(("_left_", "_right_"))]

    # The points pass by; a task holds the intervals of one bucket, or of a part of it.
    a = points.select(*on, F.col("_from").alias("_at"), *values(points))
    b = intervals.select(*on, "_from", "_to", *values(intervals))
    begun = F.col("_from") < F.col("_at") if strict else F.col("_from") <= F.col("_at")
    met_in = a.hint("merge").join(b, on).filter(begun & (F.col("_at") <= F.col("_to")))
    return met_in.select(*values(points), *values(intervals))


def interval_join(
    left: DataFrame,
    right: DataFrame,
    left_ends: tuple[str, str],
    right_ends: tuple[str, str],
    take: dict[str, str],
    key: Sequence[str] = (),
    task_rows: int = 100_000,
) -> DataFrame:
    """All pairs whose closed intervals overlap: ``left``'s columns and those ``take`` names.

    ``left_ends`` and ``right_ends`` name the first and last time; both may be the same
    column, for points. ``take`` maps columns of ``right`` to their names in the result.
    Columns of ``key`` must be equal. A null end, a null key or an end before its begin
    matches nothing.

    Two intervals overlap if one begins within the other. So the rows of each side are looked up,
    by their begin alone, among the intervals of the other; rows that begin together count on the
    left. An interval lies in the buckets of its own length's level, where it touches
    ``GROWTH + 1`` at most, and a begin in one bucket of each level that the other side
    has. So a long interval is never cut into many, a short one is never compared with what
    is far away, and a pair is met once. A bucket with more than ``task_rows`` rows of a side
    is dealt to several tasks; the copies that this needs stay in proportion to the rows.
    """
    keys = [f"_key_{i}" for i in range(len(key))]
    sides = []
    for df, (begin, end), names, side in (
        (left, left_ends, left.columns, "_left"),
        (right, right_ends, list(take), "_right"),
    ):
        rows = df.select(
            *[c(n).alias(k) for n, k in zip(key, keys)],
            ticks(df, begin).alias("_from"),
            ticks(df, end).alias("_to"),
            *[c(n).alias(f"{side}_{i}") for i, n in enumerate(names)],
        ).filter(F.col("_from") <= F.col("_to"))
        # Read several times, and its rows numbered: equal ones may go to different tasks.
        sides.append(stage(rows.withColumn("_id", F.monotonically_increasing_id()), "intervals"))

    def begun_in(points: DataFrame, intervals: DataFrame, strict: bool) -> DataFrame | None:
        found = intervals.select(_level(F.col("_to") - F.col("_from")).alias("l")).distinct().collect()
        levels = sorted(r[0] for r in found)  # 32 at most
        if not levels:
            return None
        begins = _bucketed(points, levels, False)
        return _met(begins, _bucketed(intervals, [], True), keys, task_rows, strict)

    a, b = sides
    # Nothing begins later than a point and within it.
    both = (begun_in(a, b, False), begun_in(b, a.filter("_from < _to"), True))
    met = [part for part in both if part is not None]
    wanted = [
        *[F.col(f"_left_{i}").alias(n) for i, n in enumerate(left.columns)],
        *[F.col(f"_right_{i}").alias(new) for i, new in enumerate(take.values())],
    ]
    if not met:
        return a.join(b, a["_id"] == b["_id"]).filter(F.lit(False)).select(*wanted)
    return reduce(DataFrame.unionByName, [part.select(*wanted) for part in met])


# ---------------------------------------------------------------- sessions


def sessions(
    df: DataFrame,
    key: Sequence[str],
    at: str,
    gap: timedelta | int,
    sums: dict[str, Column] | None = None,
    cut: Cut = Cut(),
) -> DataFrame:
    """One row per session: a key's rows with no pause longer than ``gap`` between them.

    The key, ``started``, ``ended``, ``events`` and, by name, the sums. Null keys are
    one key; rows without a time are in no session.

    The rows of a busy key are merged per time, so any number may share one, and cut along
    time. Sessions inside a piece are final; the first and the last of each piece are tied to
    those of the pieces around by the same rule, so a session may run over any number of pieces.
    """
    if not key:
        raise ValueError("name at least one key")
    sums = sums or {}
    keys = [f"_key_{i}" for i in range(len(key))]
    values = [f"_sum_{i}" for i in range(len(sums))]
    rows = df.select(
        *[c(n).alias(k) for n, k in zip(key, keys)],
        c(at).alias("_from"),
        c(at).alias("_to"),
        ticks(df, at).alias("_first"),
        ticks(df, at).alias("_last"),
        F.lit(1).cast("bigint").alias("_n"),
        *[e.alias(v) for e, v in zip(sums.values(), values)],
    ).filter("_first is not null")
    wide = span(gap)

    def merged(part: DataFrame, *group: str) -> DataFrame:
        """Runs of rows, or of sessions in order, without a long pause: one row each."""
        window = Window.partitionBy(*group).orderBy("_first", "_last")
        pause = F.col("_first") - F.lag("_last").over(window) > wide
        number = F.sum(F.when(pause, 1).otherwise(0)).over(
            window.rowsBetween(Window.unboundedPreceding, 0)
        )
        return (
            part.withColumn("_number", number)
            .groupBy(*group, "_number")
            .agg(
                F.min("_from").alias("_from"),
                F.max("_to").alias("_to"),
                F.min("_first").alias("_first"),
                F.max("_last").alias("_last"),
                F.sum("_n").alias("_n"),
                *[F.sum(v).alias(v) for v in values],
            )
        )

    busy, ordinary = _busy_rows(rows, keys, cut)
    done = merged(ordinary, *keys).drop("_number")
    if busy is not None:
        sums_of = [F.sum(v).alias(v) for v in ("_n", *values)]
        ends = [F.min("_from").alias("_from"), F.max("_to").alias("_to"), F.max("_last").alias("_last")]
        times = stage(busy.groupBy(*keys, "_first").agg(*ends, *sums_of), "busy-times")
        # All keys here are busy: none has fewer rows than none.
        _, pieces = cut_busy(times, keys, [F.col("_first").asc()], Cut(0, cut.piece_rows or cut.task_rows))
        group = [*keys, "_piece"]
        of_piece = Window.partitionBy(*group)
        local = stage(
            merged(pieces, *group).withColumn(
                "_border", (F.col("_number") == 0) | (F.col("_number") == F.max("_number").over(of_piece))
            ),
            "piece-sessions",
        )
        inner = local.filter("not _border").select(*done.columns)
        # Two rows per key and piece at most.
        tied = merged(local.filter("_border").drop("_number", "_border", "_piece"), *keys)
        done = done.unionByName(inner).unionByName(tied.select(*done.columns))
    return done.select(
        *[F.col(k).alias(n) for k, n in zip(keys, key)],
        F.col("_from").alias("started"),
        F.col("_to").alias("ended"),
        F.col("_n").alias("events"),
        *[F.col(v).alias(n) for v, n in zip(values, sums)],
    )


# ---------------------------------------------------------------- frames

_MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def range_frame(
    df: DataFrame,
    key: Sequence[str],
    at: str,
    before: timedelta | int,
    values: dict[str, tuple[str, Column]],
    after: timedelta | int = 0,
    cut: Cut = Cut(),
) -> DataFrame:
    """``df`` with aggregates over its key's rows from ``before`` earlier to ``after`` later.

    ``values`` maps a name to a kind (``count``, ``sum``, ``min``, ``max``) and an expression;
    nulls do not count. Rows at the same time are in each other's frame. Null keys are one
    key; the aggregates of a row without a time are null (a count 0).

    The rows of a busy key are first merged per time, so any number of them may share one, and
    then cut along time. A piece gets copies of the rows of other pieces that its frames reach.
    No more pieces are made than the rows' times hold frames, so a row is copied about twice.
    """
    if not key:
        raise ValueError("name at least one key")
    back, ahead = span(before), span(after)
    names = df.columns
    keys = [f"_key_{i}" for i in range(len(key))]
    held = [f"_value_{i}" for i in range(len(values))]
    kinds = [kind for kind, _ in values.values()]
    inputs = [
        F.when(e.isNotNull(), 1).cast("bigint") if kind == "count" else e for kind, e in values.values()
    ]
    rows = df.select(
        *[c(n).alias(k) for n, k in zip(key, keys)],
        ticks(df, at).alias("_time"),
        F.struct(*[c(n).alias(f"_{i}") for i, n in enumerate(names)]).alias("_row"),
        *[e.alias(h) for e, h in zip(inputs, held)],
    )

    def framed(part: DataFrame, *group: str) -> DataFrame:
        frame = Window.partitionBy(*group).orderBy("_time").rangeBetween(-back, ahead)
        return part.withColumns({f"_in{h}": _MERGE[k](h).over(frame) for k, h in zip(kinds, held)})

    def result(part: DataFrame) -> DataFrame:
        found = [F.col(f"_in{h}") for h in held]
        none = F.lit(0).cast("bigint")
        found = [F.coalesce(f, none) if k == "count" else f for k, f in zip(kinds, found)]
        return part.select(
            *[F.col(f"_row._{i}").alias(n) for i, n in enumerate(names)],
            *[f.alias(n) for f, n in zip(found, values)],
        )

    timed, timeless = rows.filter("_time is not null"), rows.filter("_time is null")
    types = dict(timed.dtypes)
    nulls = {
        f"_in{h}": F.lit(None).cast("bigint" if k == "count" else types[h]) for k, h in zip(kinds, held)
    }
    alone = timeless.withColumns(nulls)
    busy_rows, ordinary = _busy_rows(timed, keys, cut)
    done = result(framed(ordinary, *keys)).unionByName(result(alone))
    if busy_rows is None:
        return done
    times = stage(
        busy_rows.groupBy(*keys, "_time").agg(*[_MERGE[k](h).alias(h) for k, h in zip(kinds, held)]),
        "busy-times",
    )
    low, high = times.agg(F.min("_time"), F.max("_time")).first()
    frames = (high - low) // max(back + ahead, 1) + 1
    # All keys here are busy: none has fewer rows than none.
    _, pieces = cut_busy(times, keys, [F.col("_time").asc()], Cut(0, cut.piece_rows or cut.task_rows), frames)
    copies = _copies(pieces, back, ahead)
    owned = pieces.withColumn("_own", F.lit(True)).unionByName(copies.withColumn("_own", F.lit(False)))
    of_time = framed(owned, *keys, "_piece").filter("_own").select(
        *[F.col(k).alias("_of" + k) for k in keys], F.col("_time").alias("_of_time"), *[f"_in{h}" for h in held]
    )
    joined = busy_rows.join(of_time.hint("merge"), same_key(keys, "_of") & (F.col("_time") == F.col("_of_time")))
    return done.unionByName(result(joined))


def _busy_rows(rows: DataFrame, keys: list[str], cut: Cut) -> tuple[DataFrame | None, DataFrame]:
    """The rows of busy keys, if there are any, and the others."""
    counts = rows.groupBy(*[F.col(k).alias("_busy_" + k) for k in keys]).agg(F.count(F.lit(1)).alias("_rows"))
    busy = stage(counts.filter(F.col("_rows") > cut.task_rows).drop("_rows"), "busy-keys")
    if busy.isEmpty():
        return None, rows
    few = broadcast_if_few(busy)
    same = same_key(keys, "_busy_")
    return rows.join(few, same, "left_semi"), rows.join(few, same, "left_anti")


def _copies(pieces: DataFrame, back: int, ahead: int) -> DataFrame:
    """Rows that frames of another piece reach, with that piece: each row once per such piece."""
    bounds = pieces.groupBy("_piece").agg(F.min("_time").alias("_low"), F.max("_time").alias("_high"))
    width = F.lit(max(back, ahead, 1)).cast("bigint")
    # What a piece wants on either side of it, in buckets of which it touches two or three.
    wants = F.array(
        F.struct((F.col("_low") - back).alias("a"), (F.col("_low") - 1).alias("b")),
        F.struct((F.col("_high") + 1).alias("a"), (F.col("_high") + ahead).alias("b")),
    )
    wanted = bounds.select(F.col("_piece").alias("_for"), F.inline(wants)).filter("a <= b")
    buckets = F.sequence(_down(F.col("a"), width), _down(F.col("b"), width))
    wanted = broadcast_if_few(stage(wanted.withColumn("_bucket", F.explode(buckets)), "wanted"))
    near = (F.col("_in_bucket") == F.col("_bucket")) & F.col("_time").between(F.col("a"), F.col("b"))
    return (
        pieces.withColumn("_in_bucket", _down(F.col("_time"), width))
        .join(wanted, near)
        .withColumn("_piece", F.col("_for"))
        .select(*pieces.columns)
    )
