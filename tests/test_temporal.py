"""Operators along time against plain Python, with hot keys cut into pieces."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallywatch.operators import grouping, temporal
from tallywatch.operators.pieces import Cut, cut_busy, span, ticks
from tallywatch.session import stage

SCHEMA = "id int, user string, at bigint, kind string, value int"
CUTS = [Cut(), Cut(5, 7), Cut(1, 3)]


def made(seed, n=300, ties=0.3):
    """Rows of one hot user and some others, with equal times, null users and null times."""
    rng = random.Random(seed)
    rows, at = [], 0
    for i in range(n):
        at += 0 if rng.random() < ties else rng.choice([1, 2, 5, 40])
        user = rng.choice(["hot", "hot", "hot", "a", "b", None])
        rows.append((i, user, None if rng.random() < 0.03 else at, rng.choice("LRRF"), rng.choice([None, 1, 2, 7])))
    rng.shuffle(rows)
    return rows


def table(spark, rows, parts=4):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def as_set(df):
    return sorted(map(tuple, df.collect()), key=str)


# ---------------------------------------------------------------- as-of


@pytest.mark.parametrize("cut", CUTS)
@pytest.mark.parametrize("strict,within", [(False, None), (True, None), (False, 10), (True, 3)])
def test_asof_equals_plain_code(spark, cut, strict, within):
    rows = made(1)
    df = table(spark, rows)
    left, right = df.filter("kind = 'L'"), df.filter("kind = 'R'")
    found = temporal.asof_join(left, right, ["user"], "at", {"id": "r_id", "at": "r_at"}, "id", strict, within, cut)
    expected = []
    for l in rows:
        if l[3] != "L":
            continue
        met = [
            (r[2], r[0]) for r in rows
            if r[3] == "R" and None not in (l[1], r[1], l[2], r[2]) and r[1] == l[1]
            and (r[2] < l[2] if strict else r[2] <= l[2])
        ]
        at, i = max(met, default=(None, None))
        if at is not None and within is not None and l[2] - at > within:
            at = i = None
        expected.append((*l, i, at))
    assert found.columns == ["id", "user", "at", "kind", "value", "r_id", "r_at"]
    assert as_set(found) == sorted(expected, key=str)
    assert any(r[5] is not None for r in expected) and any(r[5] is None for r in expected)


def test_asof_of_two_keys_times_and_clashing_names(spark):
    day = datetime(2024, 3, 1)
    left = spark.createDataFrame([("u", 1, day, "x")], "user string, host int, at timestamp_ntz, mark string")
    right = spark.createDataFrame(
        [("u", 1, day - timedelta(minutes=5), "near"), ("u", 2, day, "other host")],
        "user string, host int, at timestamp_ntz, mark string",
    )
    found = temporal.asof_join(left, right, ["user", "host"], "at", {"mark": "last"}, within=timedelta(minutes=5))
    assert found.first()["last"] == "near"
    found = temporal.asof_join(left, right, ["user", "host"], "at", {"mark": "last"}, within=timedelta(minutes=4))
    assert found.first()["last"] is None
    none = temporal.asof_join(left, right.limit(0), ["user"], "at", {"mark": "last"})
    assert none.count() == 1 and none.first()["last"] is None
    assert temporal.asof_join(left.limit(0), right, ["user"], "at", {"mark": "last"}).count() == 0


# ---------------------------------------------------------------- intervals


def made_intervals(seed, n, width):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        begin = rng.randrange(-500, 500) if rng.random() < 0.7 else 17
        end = begin + rng.choice([0, 0, 1, 3, width, 10 * width, -2])
        rows.append((i, rng.choice(["x", "y", None]), None if rng.random() < 0.03 else begin, end))
    return rows


@pytest.mark.parametrize("task_rows", [100_000, 4])
@pytest.mark.parametrize("key", [[], ["k"]])
def test_intervals_equal_plain_code(spark, task_rows, key):
    """Points, long intervals, a bucket with a third of all rows, ends before begins."""
    rows, others = made_intervals(1, 120, 16), made_intervals(2, 90, 50)
    kind = "id int, k string, a bigint, b bigint"
    left, right = spark.createDataFrame(rows, kind), spark.createDataFrame(others, kind)
    found = temporal.interval_join(left, right, ("a", "b"), ("a", "b"), {"id": "other"}, key, task_rows)
    expected = [
        (*l, r[0]) for l in rows for r in others
        if None not in (l[2], r[2]) and l[2] <= l[3] and r[2] <= r[3] and l[2] <= r[3] and r[2] <= l[3]
        and (not key or (l[1] is not None and l[1] == r[1]))
    ]
    assert as_set(found) == sorted(expected, key=str) and len(expected) > 50


def test_intervals_make_no_nested_loops(spark):
    rows = spark.createDataFrame(made_intervals(3, 50, 9), "id int, k string, a bigint, b bigint")
    found = temporal.interval_join(rows, rows, ("a", "a"), ("a", "b"), {"id": "other"})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_long_intervals_touch_few_buckets(spark):
    """An interval of ten years among points of microseconds is two rows, not 10^14."""
    year = 365 * 86_400_000_000
    rows = spark.createDataFrame([(1, "k", 0, 10 * year)], "id int, k string, a bigint, b bigint")
    points = spark.createDataFrame([(i, "k", i * year, i * year) for i in range(-2, 13)], "id int, k string, a bigint, b bigint")
    found = temporal.interval_join(points, rows, ("a", "b"), ("a", "b"), {"id": "other"})
    assert sorted(r.id for r in found.collect()) == list(range(11))
    staged = points.select(F.col("a").alias("_from"), F.col("b").alias("_to"))
    assert temporal._bucketed(staged, [], True).count() == 15
    empty = temporal.interval_join(points.limit(0), rows, ("a", "b"), ("a", "b"), {"id": "other"})
    assert empty.count() == 0


def test_copies_of_a_full_bucket_stay_in_proportion(spark, monkeypatch):
    """300 intervals at one time, three to a task, are not copied 100 times each."""
    grids = []

    def staged(df, name, **options):
        found = stage(df, name, **options)
        if name == "full-buckets":
            grids.append(found)
        return found

    monkeypatch.setattr(temporal, "stage", staged)
    rows = spark.createDataFrame([(i, i, 1000 + i) for i in range(300)], "id int, a bigint, b bigint")
    found = temporal.interval_join(rows, rows, ("a", "b"), ("a", "b"), {"id": "other"}, task_rows=3)
    assert found.distinct().count() == found.count() == 300 * 300
    parts = [v for g in grids for r in g.collect() for n, v in r.asDict().items() if not n.startswith("_full")]
    assert max(parts) == temporal.PARTS


def test_points_and_intervals_meet_in_one_join(spark):
    """Points begin in intervals, never the other way round; what nobody wants is not read."""
    kind = "id int, k string, a bigint, b bigint"
    rows = spark.createDataFrame(made_intervals(4, 50, 9), kind)
    found = temporal.interval_join(rows, rows, ("a", "a"), ("a", "b"), {"id": "other"}).select("id", "other")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1
    scans = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert scans and not any("string" in line for line in scans)


# ---------------------------------------------------------------- sessions


@pytest.mark.parametrize("cut", CUTS)
@pytest.mark.parametrize("gap", [0, 4, 1000])
def test_sessions_equal_plain_code(spark, cut, gap):
    rows = made(2)
    sums = {"failed": F.when(F.col("kind") == "F", 1).otherwise(0), "total": F.col("value")}
    found = temporal.sessions(table(spark, rows), ["user"], "at", gap, sums, cut)
    expected = []
    by_user = defaultdict(list)
    for r in rows:
        if r[2] is not None:
            by_user[r[1]].append(r)
    for user, own in by_user.items():
        own.sort(key=lambda r: r[2])
        parts = [[own[0]]]
        for r in own[1:]:
            if r[2] - parts[-1][-1][2] > gap:
                parts.append([])
            parts[-1].append(r)
        for part in parts:
            values = [r[4] for r in part if r[4] is not None]
            failed = sum(r[3] == "F" for r in part)
            expected.append((user, part[0][2], part[-1][2], len(part), failed, sum(values) if values else None))
    assert found.columns == ["user", "started", "ended", "events", "failed", "total"]
    assert as_set(found) == sorted(expected, key=str)


def test_a_session_over_many_pieces(spark):
    """All rows of one key are one session, whatever the pieces."""
    rows = [(i, "hot", i, "F", 1) for i in range(200)]
    found = temporal.sessions(table(spark, rows), ["user"], "at", 1, {"total": F.col("value")}, Cut(10, 10))
    assert as_set(found) == [("hot", 0, 199, 200, 200)]
    _, pieces = cut_busy(table(spark, rows), ["user"], [F.col("at").asc()], Cut(10, 10))
    assert pieces.select("_piece").distinct().count() > 5


# ---------------------------------------------------------------- frames


@pytest.mark.parametrize("cut", CUTS)
@pytest.mark.parametrize("before,after", [(0, 0), (10, 0), (7, 30), (100_000, 0)])
def test_frames_equal_plain_code(spark, cut, before, after):
    rows = made(3)
    values = {
        "n": ("count", F.col("value")), "total": ("sum", F.col("value")),
        "low": ("min", F.col("value")), "high": ("max", F.col("value")),
    }
    found = temporal.range_frame(table(spark, rows), ["user"], "at", before, values, after, cut)
    expected = []
    for r in rows:
        met = [
            x[4] for x in rows
            if r[2] is not None and x[2] is not None and x[1] == r[1] and r[2] - before <= x[2] <= r[2] + after
        ]
        met = [v for v in met if v is not None]
        expected.append((*r, len(met), sum(met) if met else None, min(met, default=None), max(met, default=None)))
    assert as_set(found) == sorted(expected, key=str)


def test_copies_are_bounded(spark):
    """Pieces are not cut shorter than a frame, so rows are copied about twice at most."""
    rows = [(i, "hot", i, "F", 1) for i in range(1000)]
    times = table(spark, rows).select("user", F.col("at").alias("_time"))
    for width in (1, 50, 2000):
        most = 999 // width + 1
        _, pieces = cut_busy(times, ["user"], [F.col("_time").asc()], Cut(0, 10), most)
        assert temporal._copies(pieces, width, 0).count() <= 2 * 1000


def test_many_rows_at_one_time(spark):
    rows = [(i, "hot", i // 500, "F", 1) for i in range(1000)]
    found = temporal.range_frame(table(spark, rows), ["user"], "at", 0, {"n": ("count", F.lit(1))}, cut=Cut(5, 5))
    assert {r.n for r in found.collect()} == {500} and found.count() == 1000


def test_frames_of_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert temporal.range_frame(none, ["user"], "at", 5, {"n": ("count", F.lit(1))}).count() == 0
    assert temporal.sessions(none, ["user"], "at", 5).count() == 0
    with pytest.raises(ValueError):
        temporal.sessions(none, [], "at", 5)


def test_ticks(spark):
    day = datetime(1969, 12, 31, 23, 59, 59, 999_999)
    df = spark.createDataFrame([(day, day, day.date(), 7)], "a timestamp, b timestamp_ntz, c date, d int")
    found = df.select(*[ticks(df, n) for n in df.columns]).first()
    assert tuple(found) == (-1, -1, -86_400_000_000, 7)
    assert span(timedelta(hours=1)) == 3_600_000_000 and span(3) == 3
    with pytest.raises(ValueError):
        span(-1)
    with pytest.raises(TypeError):
        ticks(spark.createDataFrame([("x",)], "a string"), "a")


# ---------------------------------------------------------------- subtotals


def test_cube_tells_nulls_from_subtotals(spark):
    rows = [("a", None, 1), ("a", None, 2), ("a", "x", None), (None, "x", 5)]
    df = spark.createDataFrame(rows, "p string, q string, v int")
    values = {"n": ("count", F.col("v")), "s": ("sum", F.col("v")), "m": ("min", F.col("v"))}
    found = {(r.p, r.q, r.level): (r.n, r.s, r.m) for r in grouping.cube(df, ["p", "q"], values).collect()}
    assert found == {
        ("a", None, 0): (2, 3, 1), ("a", "x", 0): (0, None, None), (None, "x", 0): (1, 5, 5),
        ("a", None, 1): (2, 3, 1), (None, None, 1): (1, 5, 5),
        (None, None, 2): (2, 3, 1), (None, "x", 2): (1, 5, 5),
        (None, None, 3): (3, 8, 1),
    }
    down = grouping.rollup(df, ["p", "q"], values)
    assert {(r.p, r.q, r.level) for r in down.collect()} == {k for k in found if k[2] != 2}
    total = grouping.grouping_sets(df, [[]], values).collect()
    assert [tuple(r) for r in total] == [(0, 3, 8, 1)]
    assert grouping.cube(df.limit(0), ["p", "q"], values).count() == 0


def test_subtotals_come_from_groups(spark):
    """The rows are expanded after they are grouped: the expansion reads groups only."""
    df = spark.range(1000).select((F.col("id") % 2).alias("p"), (F.col("id") % 3).alias("q"), "id")
    found = grouping.cube(df, ["p", "q"], {"n": ("count", F.col("id"))})
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Expand") < plan.rindex("Aggregate") < plan.index("Range")
