"""Quantiles of many columns at once, approximate or exact."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallywatch.functions.columns import c
from tallywatch.session import stage

#: Values still in question are sorted, each search in a task of its own, below this count.
TASK_VALUES = 1_000_000
#: Ranks that a sketch tells apart.
ACCURACY = 1000
WHOLE = ("tinyint", "smallint", "int", "bigint")


def _value(df: DataFrame, name: str) -> Column:
    """The column with NaN read as missing."""
    if dict(df.dtypes)[name] in ("double", "float"):
        return F.when(~F.isnan(c(name)), c(name))
    return c(name)


def approx_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], error: float
) -> dict[str, list]:
    """Per column the values at ``probabilities``, rank error ``error`` * rows.

    One aggregate for all columns; partial sketches merge before the shuffle.
    A column without values is left out.
    """
    if error <= 0:
        return exact_quantiles(df, columns, probabilities)
    if not columns:
        return {}
    accuracy = math.ceil(1 / error)
    row = df.agg(
        *[
            F.percentile_approx(_value(df, n), list(probabilities), accuracy).alias(f"q{i}")
            for i, n in enumerate(columns)
        ]
    ).first()
    return {n: list(row[i]) for i, n in enumerate(columns) if row[i] is not None}


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]
) -> dict[str, list]:
    """The value at rank ``ceil(p * n)`` (1 at least) of each column.

    Three scans whatever the size: a sketch encloses each quantile by two values, the rows
    around those are counted (in the column's own type), and the values between them, about
    a two-hundredth, are staged. A bad guess leaves more values, never a wrong one. On what is
    staged the same is repeated until each search has few enough values for one task to sort.
    """
    values = {n: _value(df, n) for n in columns}
    points = sorted(
        {min(1.0, max(0.0, p + d / ACCURACY)) for p in probabilities for d in (-2, 2)}
    )
    row = df.agg(
        *[F.count(v).alias(f"n{i}") for i, v in enumerate(values.values())],
        *[
            F.percentile_approx(v, points, ACCURACY).alias(f"q{i}")
            for i, v in enumerate(values.values())
        ],
    ).first()
    searches = []
    guessed: dict[str, list] = {}
    for i, n in enumerate(columns):
        if row[f"n{i}"]:
            guessed[n] = sorted(set(row[f"q{i}"]))
            searches += [_Search(n, len(searches) + k, p, row[f"n{i}"]) for k, p in enumerate(probabilities)]
    if not searches:
        return {}
    counted = _count_around(df, values, guessed)
    for s in searches:
        s.narrow(counted[s.column])
    kinds = dict(df.dtypes)
    wide = [s for s in searches if s.answer is None]
    if wide:
        near = _inside(df, values, kinds, wide)
        while large := [s for s in wide if s.size > TASK_VALUES]:
            before = sum(s.size for s in large)
            _halve(near, large, kinds)
            wide = [s for s in wide if s.answer is None]
            if sum(s.size for s in large if s.answer is None) >= before:
                # Values that a sketch cannot tell apart: their range halves each time.
                _bisect(near, large, kinds)
                wide = [s for s in wide if s.answer is None]
            near = stage(_between(near, wide, kinds), "near")
        _sort(near, wide)
    found: dict[str, list] = {}
    for s in searches:
        found.setdefault(s.column, []).append(s.answer)
    return found


class _Search:
    """The value of one rank, known to lie in an open interval: ranks before + 1 to upto."""

    def __init__(self, column: str, number: int, probability: float, rows: int) -> None:
        self.column, self.number = column, number
        self.rank = max(1, math.ceil(probability * rows))
        self.low = self.high = self.answer = None
        self.before, self.upto = 0, rows

    @property
    def size(self) -> int:
        return self.upto - self.before

    def narrow(self, counted: list[tuple]) -> None:
        """``counted``: bounds in order, with the rows of the column below and equal to each."""
        for bound, below, equal in counted:
            if self.rank <= below:
                self.high, self.upto = bound, below
                return
            if self.rank <= below + equal:
                self.answer = bound
                return
            self.low, self.before = bound, below + equal


def _count_around(
    df: DataFrame, values: dict[str, Column], bounds: dict[str, list]
) -> dict[str, list[tuple]]:
    """Rows below and equal to every bound, all columns in one grouped count."""
    kinds = dict(df.dtypes)
    places = []

    def searched(value: Column, found: list, kind: str, low: int, high: int) -> Column:
        """Twice the number of bounds below, one more at a bound: a binary search."""
        if low == high:
            return F.lit(2 * low)
        k = (low + high) // 2
        at = F.lit(found[k]).cast(kind)
        left, right = searched(value, found, kind, low, k), searched(value, found, kind, k + 1, high)
        return F.when(value < at, left).when(value == at, 2 * k + 1).otherwise(right)

    for i, (name, found) in enumerate(bounds.items()):
        place = searched(values[name], found, kinds[name], 0, len(found))
        place = F.when(values[name].isNotNull(), place)
        places.append(F.struct(F.lit(i).alias("i"), place.alias("place")))
    rows = df.select(F.inline(F.array(*places))).groupBy("i", "place").count().collect()
    counted: dict[str, list[tuple]] = {}
    for i, (name, found) in enumerate(bounds.items()):
        held = {r["place"]: r["count"] for r in rows if r["i"] == i and r["place"] is not None}
        below = 0
        for k, bound in enumerate(found):
            below += held.get(2 * k, 0)
            equal = held.get(2 * k + 1, 0)
            counted.setdefault(name, []).append((bound, below, equal))
            below += equal
    return counted


def _inside(
    df: DataFrame, values: dict[str, Column], kinds: dict[str, str], searches: list[_Search]
) -> DataFrame:
    """Staged rows ``s``, ``d`` or ``l``: the values in each search's interval, in its type."""
    entries = []
    for s in searches:
        value = values[s.column]
        inside = value.isNotNull()
        if s.low is not None:
            inside &= value > F.lit(s.low).cast(kinds[s.column])
        if s.high is not None:
            inside &= value < F.lit(s.high).cast(kinds[s.column])
        whole = kinds[s.column] in WHOLE
        entries.append(
            F.when(
                inside,
                F.struct(
                    F.lit(s.number).alias("s"),
                    (F.lit(None) if whole else value).cast("double").alias("d"),
                    (value if whole else F.lit(None)).cast("bigint").alias("l"),
                ),
            )
        )
    return stage(df.select(F.inline(F.array_compact(F.array(*entries)))), "near")


def _limits(df: DataFrame, searches: list[_Search], kinds: dict[str, str]) -> DataFrame:
    """The intervals as a table, one row per search."""
    rows = []
    for s in searches:
        pair = (s.low, s.high)
        whole = kinds[s.column] in WHOLE
        rows.append((s.number, *((None, None) if whole else pair), *(pair if whole else (None, None))))
    return df.sparkSession.createDataFrame(
        rows, "s int, low_d double, high_d double, low_l bigint, high_l bigint"
    )


def _between(near: DataFrame, searches: list[_Search], kinds: dict[str, str]) -> DataFrame:
    """The values that are still in question."""
    # One row per search.
    held = near.join(F.broadcast(_limits(near, searches, kinds)), "s")
    inside = F.lit(True)
    for v in ("d", "l"):
        inside &= F.col(f"low_{v}").isNull() | (F.col(v) > F.col(f"low_{v}"))
        inside &= F.col(f"high_{v}").isNull() | (F.col(v) < F.col(f"high_{v}"))
    return held.filter(inside).select("s", "d", "l")


def _halve(near: DataFrame, searches: list[_Search], kinds: dict[str, str]) -> None:
    """Enclose each search anew, by a sketch of its own values, and count around that."""
    held = near.join(F.broadcast(_limits(near, searches, kinds)), "s")
    # Whole numbers as offsets, which a sketch of doubles keeps exact.
    offset = F.coalesce(F.col("d"), (F.col("l") - F.coalesce("low_l", F.lit(0))).cast("double"))
    grid_ = F.expr("array(" + ", ".join(f"{i / ACCURACY!r}D" for i in range(ACCURACY + 1)) + ")")
    sketches = held.groupBy("s").agg(F.percentile_approx(offset, grid_, 10 * ACCURACY).alias("q"))
    found = {r["s"]: r["q"] for r in sketches.collect()}
    rows = []
    for s in searches:
        at = (s.rank - s.before) / s.size * ACCURACY
        around = [found[s.number][max(0, min(ACCURACY, int(k)))] for k in (at - 2, at + 3)]
        if kinds[s.column] in WHOLE:
            rows += [(s.number, None, round(x) + (s.low or 0)) for x in set(around)]
        else:
            rows += [(s.number, x, None) for x in set(around)]
    _narrow(near, searches, rows)


def _bisect(near: DataFrame, searches: list[_Search], kinds: dict[str, str]) -> None:
    """Count around the middle of each search's range of values, whatever lies there."""
    ends = near.groupBy("s").agg(F.min("d"), F.max("d"), F.min("l"), F.max("l")).collect()
    wanted = {s.number: s for s in searches if s.answer is None}
    rows = []
    for s, low_d, high_d, low_l, high_l in ends:
        if s not in wanted:
            continue
        if kinds[wanted[s].column] in WHOLE:
            rows.append((s, None, low_l + (high_l - low_l) // 2))
        else:
            rows.append((s, low_d / 2 + high_d / 2 if low_d < high_d else low_d, None))
    _narrow(near, list(wanted.values()), rows)


def _narrow(near: DataFrame, searches: list[_Search], rows: list[tuple]) -> None:
    """Narrow each search by the values below and equal to its bounds."""
    bounds = near.sparkSession.createDataFrame(rows, "s int, bound_d double, bound_l bigint")
    below = (F.col("d") < F.col("bound_d")) | (F.col("l") < F.col("bound_l"))
    equal = (F.col("d") == F.col("bound_d")) | (F.col("l") == F.col("bound_l"))
    counts = (
        near.join(F.broadcast(bounds), "s")
        .groupBy("s", "bound_d", "bound_l")
        .agg(F.count_if(below).alias("below"), F.count_if(equal).alias("equal"))
        .collect()
    )
    for s in searches:
        own = [
            (r["bound_l"] if r["bound_d"] is None else r["bound_d"], s.before + r["below"], r["equal"])
            for r in counts
            if r["s"] == s.number
        ]
        s.narrow(sorted(own))


def _sort(near: DataFrame, searches: list[_Search]) -> None:
    """Answer what is left: each search's values are sorted in a task of their own."""
    if not searches:
        return
    wanted = near.sparkSession.createDataFrame(
        [(s.number, s.rank - s.before) for s in searches], "s int, at bigint"
    )
    place = F.row_number().over(Window.partitionBy("s").orderBy("d", "l"))
    rows = (
        near.join(F.broadcast(wanted), "s").withColumn("place", place).filter("place = at").collect()
    )
    picked = {r["s"]: r["l"] if r["d"] is None else r["d"] for r in rows}
    for s in searches:
        s.answer = picked[s.number]


def quantile_table(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], error: float = 0.05
) -> DataFrame:
    """Quantiles as rows ``column, probability, value``."""
    found = approx_quantiles(df, columns, probabilities, error)
    rows = [(n, float(p), float(v)) for n, vs in found.items() for p, v in zip(probabilities, vs)]
    return df.sparkSession.createDataFrame(rows, "column string, probability double, value double")
