"""Exact quantiles, dense ids and running totals against sorting in Python."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from tallywatch.operators import ordered, quantiles

PROBABILITIES = [0.0, 0.25, 0.5, 0.99]


def sample(kind, n, rnd):
    nan = float("nan")
    make = {
        "normal": lambda: rnd.gauss(0, 1),
        "one hot value": lambda: float(rnd.choice([1, 2, 2, 2, 2, 2, 9])),
        "long tail": lambda: rnd.expovariate(1) ** 6,
        "holes": lambda: rnd.choice([None, nan, 3.0, rnd.random(), -0.0, 0.0]),
        "infinite": lambda: rnd.choice([float("inf"), -float("inf"), rnd.random()]),
        "constant": lambda: 7.0,
    }[kind]
    return [make() for _ in range(n)]


KINDS = ["normal", "one hot value", "long tail", "holes", "infinite", "constant"]


@pytest.mark.parametrize("small", [True, False])
def test_exact(spark, monkeypatch, small):
    """Small limits force rounds of guessing and counting."""
    if small:
        monkeypatch.setattr(quantiles, "TASK_VALUES", 30)
        monkeypatch.setattr(quantiles, "ACCURACY", 200)
    rnd = random.Random(11)
    values = {kind: sample(kind, 1500, rnd) for kind in KINDS}
    schema = ", ".join(f"`{k}` double" for k in KINDS)
    df = spark.createDataFrame(list(zip(*values.values())), schema).repartition(3).cache()
    found = quantiles.exact_quantiles(df, KINDS, PROBABILITIES)
    for name, column in values.items():
        present = sorted(v for v in column if v is not None and v == v)
        expected = [present[max(1, math.ceil(p * len(present))) - 1] for p in PROBABILITIES]
        assert found[name] == expected


def test_exact_integers_and_empty(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "TASK_VALUES", 3)
    df = spark.range(1, 101).select("id", F.lit(None).cast("double").alias("none"))
    assert quantiles.exact_quantiles(df, ["id", "none"], [0.25, 0.5]) == {"id": [25, 50]}


def test_approximate(spark):
    df = spark.range(1, 1001)
    (found,) = quantiles.approx_quantiles(df, ["id"], [0.25, 0.75], 0.05).values()
    assert abs(found[0] - 250) <= 50 and abs(found[1] - 750) <= 50
    four = spark.createDataFrame([(1,), (2,), (3,), (4,), (None,)], "x int")
    assert quantiles.approx_quantiles(four, ["x"], [0.25, 0.75], 0.05) == {"x": [1, 3]}
    rows = quantiles.quantile_table(four, ["x"], [0.5], 0).collect()
    assert [tuple(r) for r in rows] == [("x", 0.5, 2.0)]


@pytest.mark.parametrize("kind", ["int", "date", "timestamp", "timestamp_ntz", "double"])
def test_dense_id(spark, kind):
    """A third of the rows share one lead value; some leads are null."""
    rnd = random.Random(3)
    rows = [
        (rnd.choice([None, 50, 50, rnd.randrange(100), rnd.randrange(100)]), i) for i in range(600)
    ]
    rnd.shuffle(rows)
    lead = {
        "int": F.col("n"),
        "double": F.col("n") / 7,
        "date": F.date_add(F.lit("2024-01-01").cast("date"), F.col("n")),
        "timestamp": F.timestamp_seconds(F.col("n") * 86400 * 30),
        "timestamp_ntz": F.timestamp_seconds(F.col("n") * 3600).cast("timestamp_ntz"),
    }[kind]
    df = spark.createDataFrame(rows, "n int, key bigint").select(lead.alias("lead"), "key", "n")
    result = ordered.dense_id(df.repartition(5), "lead", "key")
    assert result.columns == ["id", "lead", "key", "n"]
    found = [(r["id"], r["n"], r["key"]) for r in result.orderBy("id").collect()]
    expected = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert found == [(i + 1, n, key) for i, (n, key) in enumerate(expected)]


@pytest.mark.parametrize("value", [5, None])
@pytest.mark.parametrize("rows", [1000, 8000])
def test_frequent_lead_is_cut(spark, value, rows):
    """No task sorts much more than asked for, however many rows share the lead."""
    lead = F.when(F.col("id") < 0.9 * rows, F.lit(value)).otherwise(F.col("id")).cast("int")
    df = spark.range(rows).select(lead.alias("lead"), F.exp(F.col("id") / rows).alias("key"), "id")
    placed = ordered.placed(df, [F.col("lead").asc(), F.col("key").asc()], "test", 100)
    sizes = [r["count"] for r in placed.groupBy("_part").count().collect()]
    assert max(sizes) <= 250
    ids = ordered.dense_id(df.withColumnRenamed("id", "n"), "lead", "key", task_rows=100)
    assert ids.filter(F.col("id") != F.col("n") + 1).isEmpty()


@pytest.mark.parametrize("kind", ["burst", "bigint", "string"])
def test_dense_id_of_close_values(spark, kind):
    """Times within one second, numbers beyond 2 ** 53, and texts keep their order."""
    rnd = random.Random(8)
    n = 1000
    lead = {
        "burst": F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("n") * 7).cast("timestamp_ntz"),
        "bigint": F.lit((1 << 60) + 1) + F.col("n"),
        "string": F.lpad(F.col("n").cast("string"), 9, "0"),
    }[kind]
    numbers = list(range(n))
    rnd.shuffle(numbers)
    df = spark.createDataFrame([(x,) for x in numbers], "n bigint").select("n", lead.alias("lead"))
    ids = ordered.dense_id(df, "lead", "n", task_rows=100)
    assert ids.filter(F.col("id") != F.col("n") + 1).isEmpty()


def test_exact_beyond_doubles(spark, monkeypatch):
    """Whole numbers that no double tells apart; and three scans, however many rounds."""
    for limit in (1, 50, 10**6):
        monkeypatch.setattr(quantiles, "TASK_VALUES", limit)
        df = spark.range(1001).select((F.lit((1 << 60) + 1) + F.col("id") * 2).alias("x"))
        found = quantiles.exact_quantiles(df, ["x"], [0.25, 0.5])
        assert found == {"x": [(1 << 60) + 1 + 2 * 250, (1 << 60) + 1 + 2 * 500]}


def test_scores_are_evaluated_once(spark):
    """The running totals read their input in one pass."""
    passes = spark.sparkContext.accumulator(0)

    def count(batches):
        passes.add(1)
        yield from batches

    df = spark.range(100, numPartitions=1).mapInArrow(count, "id bigint")
    ordered.running_totals(df, "id", {"n": F.lit(1)}).collect()
    assert passes.value == 1


def test_running_totals(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice([0.5, rnd.random(), -1.0]), rnd.randrange(3)) for _ in range(500)]
    df = spark.createDataFrame(rows, "s double, v int")
    for descending in (True, False):
        result = ordered.running_totals(df, "s", {"v": F.col("v")}, descending).collect()
        for r in result:
            ahead = [v for s, v in rows if (s >= r["s"] if descending else s <= r["s"])]
            assert r["cum_v"] == sum(ahead)
            assert r["v"] == sum(v for s, v in rows if s == r["s"])
        assert len(result) == len({s for s, _ in rows})


def test_ranked(spark):
    df = spark.createDataFrame([(f"v{i % 37:02}", i) for i in range(300)], "s string, i int")
    order = [F.col("s").desc(), F.col("i")]
    found = ordered.ranked(df.repartition(4), order, "at").orderBy("at").collect()
    expected = sorted(((f"v{i % 37:02}", i) for i in range(300)), key=lambda r: r[1])
    expected.sort(key=lambda r: r[0], reverse=True)
    assert [(r["s"], r["i"], r["at"]) for r in found] == [(*e, n) for n, e in enumerate(expected)]


def test_time_order_is_kept(spark):
    times = [datetime.datetime(2024, 3, 31, h, m) for h in range(4) for m in (0, 59)]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    from tallywatch.functions.columns import as_number

    numbers = [r[0] for r in df.orderBy("t").select(as_number(df, "t")).collect()]
    assert numbers == sorted(set(numbers))


@pytest.mark.parametrize("kind,values", [
    ("bigint", [2**62 + i % 37 for i in range(400)] + [-(2**62)] * 5),
    ("double", [1e-300 * (i % 41) for i in range(300)] + [1e300, -1e300]),
])
def test_exact_without_any_help_of_a_sketch(spark, monkeypatch, kind, values):
    """Values that no sketch tells apart: their range is halved until few are left."""
    monkeypatch.setattr(quantiles, "TASK_VALUES", 3)
    monkeypatch.setattr(quantiles, "_halve", lambda near, searches, kinds: None)
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    found = quantiles.exact_quantiles(df, ["v"], [0.0, 0.3, 0.5, 0.99, 1.0])["v"]
    order = sorted(values)
    assert found == [order[max(1, math.ceil(p * len(order))) - 1] for p in (0.0, 0.3, 0.5, 0.99, 1.0)]
