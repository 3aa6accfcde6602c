"""Sketches, frequent values, multisets, JSON texts and series against plain Python."""

import json
import random
from collections import Counter
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tallywatch.operators import difference, documents, series, sketches
from tallywatch.session import stage


# ---------------------------------------------------------------- distinct counts


def test_sketches_of_unions_stay_within_their_error(spark):
    rng = random.Random(5)
    rows = [(d, rng.randrange(20_000 * d + 1)) for d in range(4) for _ in range(15_000)]
    df = spark.createDataFrame(rows, "d int, u int")
    stored = stage(sketches.distinct_sketches(df, ["d"], "u"), "sketches")
    for by, expected in (
        (["d"], {(d,): len({u for e, u in rows if e == d}) for d in range(4)}),
        ([], {(): len({u for _, u in rows})}),
    ):
        found = sketches.with_distinct(sketches.merged_sketches(stored, by)).collect()
        for r in found:
            exact = expected[tuple(r[n] for n in by)]
            assert abs(r["distinct"] - exact) <= exact * sketches.distinct_error()
        assert len(found) == len(expected)
    # A union counts what its parts share once.
    once, twice = (
        {r.d: r["distinct"] for r in sketches.with_distinct(sketches.merged_sketches(t, ["d"])).collect()}
        for t in (stored, stored.unionByName(stored))
    )
    assert once == twice


def test_trailing_sketches(spark):
    day = date(2024, 1, 1)
    rows = [(day, 1), (day, 2), (day + timedelta(1), 2), (day + timedelta(3), None), (day + timedelta(3), 9)]
    df = spark.createDataFrame(rows, "day date, u int")
    stored = sketches.distinct_sketches(df, ["day"], "u")
    found = sketches.with_distinct(sketches.trailing_sketches(stored, "day", 3)).collect()
    assert {(r.day - day).days: (r["distinct"], r["rows"]) for r in found} == {0: (2, 2), 1: (2, 3), 3: (2, 2)}
    assert sketches.distinct_sketches(df.limit(0), ["day"], "u").count() == 0


# ---------------------------------------------------------------- frequent values


@pytest.mark.parametrize("share", [0.5, 0.05, 0.004])
def test_heavy_hitters_are_exact(spark, share):
    """Many rare values between the frequent ones, which are spread over all tasks."""
    rng = random.Random(7)
    rows = [int(rng.paretovariate(0.7)) % 5000 for _ in range(20_000)] + [None] * 900
    rng.shuffle(rows)
    df = spark.createDataFrame([(v,) for v in rows], "v int").repartition(7)
    counts = Counter(rows)
    expected = {v: n for v, n in counts.items() if n >= share * len(rows)}
    found = {r.value: r["rows"] for r in sketches.heavy_hitters(df, "v", share).collect()}
    assert found == expected
    texts = df.select(F.concat(F.lit("user "), F.col("v").cast("string")).alias("v"))
    found = {r.value: r["rows"] for r in sketches.heavy_hitters(texts, "v", share).collect()}
    assert found == {v if v is None else f"user {v}": n for v, n in expected.items()}


def test_heavy_hitters_at_the_border_and_of_no_rows(spark):
    rows = [(i,) for i in range(1000) for _ in range(2)] + [(0,)] * 18
    found = sketches.heavy_hitters(spark.createDataFrame(rows, "v int"), "v", 20 / 2018)
    assert [tuple(r) for r in found.collect()] == [(0, 20)]
    assert sketches.heavy_hitters(spark.createDataFrame([], "v int"), "v", 0.1).count() == 0
    with pytest.raises(ValueError):
        sketches.heavy_hitters(spark.createDataFrame([], "v int"), "v", 0)


# ---------------------------------------------------------------- multisets

KIND = "k string, v int, w double"


def made(seed, n):
    rng = random.Random(seed)
    return [(rng.choice(["a", "b", None]), rng.choice([1, 2, None]), rng.choice([0.5, None])) for _ in range(n)]


def test_multisets_equal_counters(spark):
    old, new = made(1, 60), made(2, 45)
    a, b = spark.createDataFrame(old, KIND), spark.createDataFrame(new, KIND).select("w", "k", "v")
    left, right = Counter(old), Counter(new)
    assert Counter(map(tuple, difference.except_all(a, b).collect())) == left - right
    assert Counter(map(tuple, difference.intersect_all(a, b).collect())) == left & right
    net = {r: right[r] - left[r] for r in left | right if right[r] != left[r]}
    expected = set()
    for r, n in net.items():
        signs = {m > 0 for s, m in net.items() if s[0] == r[0]}
        expected.add((*r, "changed" if len(signs) == 2 else "added" if n > 0 else "removed", n))
    found = {tuple(r) for r in difference.changes(a, b, ["k"]).collect()}
    assert found == expected
    assert {r[3] for r in {tuple(x) for x in difference.changes(a, b, ["k", "v", "w"]).collect()}} == {"added", "removed"}


def test_multisets_of_no_rows_and_other_columns(spark):
    df = spark.createDataFrame(made(1, 9), KIND)
    none = df.limit(0)
    assert difference.except_all(df, none).count() == 9 and difference.except_all(none, df).count() == 0
    assert difference.changes(df, df, ["k"]).count() == 0
    assert {r.change for r in difference.changes(none, df, ["k"]).collect()} == {"added"}
    with pytest.raises(ValueError):
        difference.row_counts(df, df.drop("w"))


# ---------------------------------------------------------------- JSON

TEXTS = [
    '{"a": {"b": [1, 2.5, "x", null, [true]]}, "c": "t"}', '{"a": 7}', "[{}, []]", '"only"', "3", "null",
    "{bad", "", None, '{"a.b": 1, "é": {"": 2}}', '{"a": {"b": {"c": {"d": {"e": {"f": [[[1]]]}}}}}}',
]


def walked(value, path="$"):
    kinds = {dict: "OBJECT", list: "ARRAY", str: "STRING", bool: "BOOLEAN", type(None): "NULL"}
    yield path, kinds.get(type(value), "NUMBER")
    parts = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    for key, part in parts:
        yield from walked(part, path + ("[]" if isinstance(value, list) else "." + key))


def test_json_profile_equals_a_walk(spark):
    expected = Counter()
    for text in TEXTS:
        try:
            expected.update(walked(json.loads(text)) if text is not None else [("$", "MISSING")])
        except ValueError:
            expected[("$", "MALFORMED")] += 1
    df = spark.createDataFrame([(t,) for t in TEXTS], "`j.x` string")
    found = {(r.path, r.type): r["values"] for r in documents.json_profile(df, "j.x").collect()}
    assert found == dict(expected)
    assert documents.json_profile(df.limit(0), "j.x").count() == 0


def test_json_values(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, j string")
    paths = {"a": ("$.a", "int"), "second": ("$.a.b[1]", "double"), "c": ("$.c", "int")}
    found = {r.i: (r.a, r.second, r.c) for r in documents.json_values(df, "j", paths).collect()}
    assert found.pop(0) == (None, 2.5, None) and found.pop(1) == (7, None, None)
    assert set(found.values()) == {(None, None, None)}


# ---------------------------------------------------------------- series


def test_series_fills_empty_steps(spark):
    rows = [("a", 5, 1), ("a", 7, 2), ("a", 39, 4), ("b", -15, 3), (None, 20, 5), ("c", None, 6)]
    df = spark.createDataFrame(rows, "k string, at bigint, v int")
    values = {"n": ("count", F.lit(1)), "total": ("sum", F.col("v")), "low": ("min", F.col("v"))}
    found = series.regular_series(df, ["k"], "at", 10, values)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(
        [
            ("a", 0, 2, 3, 1), ("a", 10, 0, None, None), ("a", 20, 0, None, None), ("a", 30, 1, 4, 4),
            ("b", -20, 1, 3, 3), (None, 20, 1, 5, 5),
        ],
        key=str,
    )
    changed = series.with_change(found, ["k"], "n", 20)
    assert {(r.k, r.step): (r.n_before, r.n_change) for r in changed.collect() if r.k == "a"} == {
        ("a", 0): (None, None), ("a", 10): (None, None), ("a", 20): (2, -2), ("a", 30): (0, 1),
    }
    whole = series.regular_series(df, [], "at", 10, {"n": ("count", F.lit(1))})
    assert sorted(map(tuple, whole.collect())) == [(-20, 1), (-10, 0), (0, 2), (10, 0), (20, 1), (30, 1)]
    assert series.regular_series(df.limit(0), ["k"], "at", 10, values).count() == 0


def test_series_makes_no_table_of_all_keys(spark):
    """The calendar is made from each key's ends; no join without a key."""
    df = spark.createDataFrame([("a", 5), ("b", 50)], "k string, at bigint")
    found = series.regular_series(df, ["k"], "at", 10, {"n": ("count", F.lit(1))})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert found.count() == 2
