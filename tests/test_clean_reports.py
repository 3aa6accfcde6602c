"""Cleaning, profiling and dashboard tables on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from tallywatch.operators import clean, labels, reports
from tallywatch.operators.sequence import SequenceRule


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_normalize_names(spark):
    df = spark.createDataFrame([(1, 2)], ["a.b", "c"])
    assert clean.normalize_names(df).columns == ["a_b", "c"]
    with pytest.raises(ValueError):
        clean.normalize_names(spark.createDataFrame([(1, 2)], ["a.b", "A_b"]))


def test_drop_empty_columns(spark):
    data = [(None, "", " ", 1, None), (None, None, " ", None, 2.0)]
    df = spark.createDataFrame(data, "gone int, blank string, space string, n int, `late.d` double")
    assert clean.drop_empty_columns(df).columns == ["space", "n", "late.d"]
    empty = df.limit(0)
    assert clean.drop_empty_columns(empty).columns == df.columns


def test_nulls(spark):
    nan = float("nan")
    df = spark.createDataFrame(
        [(1, None, None, nan), (None, "x", 2.5, 1.0), (None, "y", None, 2.0)],
        "i int, s string, `d.1` double, e double",
    )
    assert rows(clean.null_profile(df)) == [
        ("d.1", 2, True), ("e", 0, False), ("i", 2, True), ("s", 1, True)
    ]
    filled = clean.fill_nulls(df)
    assert filled.dtypes == df.dtypes
    assert rows(filled) == [(0, "x", 2.5, 1.0), (0, "y", 0.0, 2.0), (1, None, 0.0, 0.0)]
    assert clean.fill_nulls(df, strings="?").filter("s = '?'").count() == 1
    # Only columns with more than one null.
    few = clean.fill_nulls(df, strings="?", threshold=1)
    assert few.filter("s is null").count() == 1 and few.filter("i is null").count() == 0


def test_drop_outliers(spark):
    data = [(i, float(i % 10), 0, None) for i in range(100)] + [(100, 1000.0, 1, None)]
    df = spark.createDataFrame(data, "id int, x double, label int, none double")
    for error in (0, 0.05):
        assert clean.drop_outliers(df.drop("none"), error=error).count() == 100
    # The rare label survives, since it is not judged; a column without values is skipped.
    flagged = df.withColumn("x", F.lit(1.0)).drop("none")
    assert clean.drop_outliers(flagged).filter("label = 1").count() == 1
    with_null = df.withColumn("x", F.when(F.col("id") != 5, F.col("x")))
    assert clean.drop_outliers(with_null, ["x", "none"], error=0).count() == 99
    assert clean.drop_outliers(with_null, ["x"], error=0, keep_nulls=True).count() == 100


def test_drop_outliers_sequential(spark):
    """The second column's quartiles come from what the first filter left."""
    data = [(float(i % 4), float(i % 4)) for i in range(40)] + [(1e6, 1e3 * i) for i in range(13)]
    df = spark.createDataFrame(data, "a double, b double")
    assert clean.drop_outliers_sequential(df, ["a", "b"], error=0).count() == 40


def test_profiles(spark):
    df = spark.createDataFrame([(1, 2.0, "x"), (3, None, "b"), (5, 4.0, None)], "i int, d double, s string")
    assert rows(reports.describe(df)) == [
        ("d", 2, 3.0, pytest.approx(2**0.5), 2.0, 4.0), ("i", 3, 3.0, 2.0, 1.0, 5.0)
    ]
    assert rows(reports.describe_text(df)) == [("s", 2, "b", "x")]
    assert rows(reports.shape(df)) == [(3, 3)]
    assert rows(reports.class_distribution(df, "s")) == [("b", 1), ("x", 1), (None, 1)]
    assert rows(reports.filter_eq(df, i=3, s="b")) == [(3, None, "b")]


def test_counts_default_to_zero(spark):
    none = spark.createDataFrame([], "prediction double")
    assert rows(reports.prediction_counts(none)) == [(0, 0)]
    some = spark.createDataFrame([(1.0,), (1.0,), (None,)], "prediction double")
    assert rows(reports.prediction_counts(some)) == [(0, 2)]


def test_dashboard(spark):
    data = [
        (1, "a", "LoginFailure", 1), (2, "a", "LoginFailure", 1), (3, None, "LogOn", 0),
        (4, "b", "LogOff", 0), (5, "c", "LoginFailure", 1), (6, None, None, 0),
    ]
    df = spark.createDataFrame(data, "id int, TargetUserName string, Task string, label int")
    # a, c and the missing user; b only logged off.
    assert rows(reports.kpi_summary(df, SequenceRule())) == [(6, 3, 3)]
    assert rows(reports.kpi_summary(df.limit(0), SequenceRule())) == [(0, 0, 0)]
    hits = df.filter("label = 1").select(F.col("TargetUserName").alias("user"), F.lit("r").alias("rule"))
    assert [tuple(r) for r in reports.top_users(hits, 1).collect()] == [("a", 2)]
    assert rows(reports.rule_counts(hits)) == [("r", 3)]
    assert rows(reports.class_by_dimension(df, "Task", "label"))[0] == ("LogOff", 0, 1)
    assert rows(reports.distinct_users(df, "TargetUserName")) == [("a",), ("b",), ("c",), (None,)]
    assert [tuple(r) for r in reports.preview(df, "id", 2).select("id", "is_flagged").collect()] == [
        (1, True), (2, True)
    ]


def test_labels(spark):
    log = spark.createDataFrame([(30, "z"), (10, "x"), (20, "y")], "t int, s string")
    made = labels.create_labeled(log, "t", "t")
    assert made.columns == ["id", "t", "s", "label"]
    assert rows(made) == [(1, 10, "x", 0), (2, 20, "y", 0), (3, 30, "z", 0)]
    first = labels.update_label(made, spark.createDataFrame([(2,), (2,), (99,)], "id bigint"))
    assert rows(first.select("id", "label")) == [(1, 0), (2, 1), (3, 0)]
    second = labels.update_label(first, spark.createDataFrame([(3,)], "id bigint"))
    assert rows(second.select("id", "label")) == [(1, 0), (2, 1), (3, 1)]
    assert second.dtypes == made.dtypes
