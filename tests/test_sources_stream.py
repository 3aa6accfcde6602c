"""Reading and writing, staging, and the rule on a stream."""

import random
from collections import Counter
from datetime import timedelta

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tallywatch import session
from tallywatch.operators.sequence import SequenceRule, consecutive_failures
from tallywatch.plans import catalog
from tallywatch.sources import tables
from tallywatch.streaming import login_stream


def test_csv(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a, \"b\"", 0.1), (2, None, None)], "i int, s string, d double")
    tables.write_csv(df, path)
    tables.write_csv(df, path)
    assert sorted(tables.scan_csv(spark, path, df.schema).collect()) == sorted(df.collect())
    assert dict(tables.scan_csv(spark, path).dtypes) == {"i": "int", "s": "string", "d": "double"}
    nested = spark.createDataFrame([(Vectors.dense([1.0, 2.0]), [1, 2])], ["v", "a"])
    tables.write_csv(nested, path)
    assert tuple(tables.scan_csv(spark, path).first()) == ("[1.0,2.0]", "[1,2]")


def test_scan_prunes_and_pushes(spark):
    lines = tables.scan_table(spark, "/root/testdata/sf0.001/lineitem.parquet")
    plan = lines.filter("l_quantity > 25").select("l_orderkey")._jdf.queryExecution().toString()
    scan = [x for x in plan.splitlines() if "FileScan" in x][-1]
    assert "GreaterThan(l_quantity,25.0)" in scan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in scan
    lines.createOrReplaceTempView("lines_view")
    assert tables.scan_table(spark, "lines_view").count() == lines.count()


def test_jdbc_is_partitioned():
    """The slices that reach the reader; no database is started for this."""
    seen = {}

    class Reader:
        def jdbc(self, url, table, **options):
            seen.update(url=url, table=table, **options)

    class Session:
        read = Reader()

    tables.scan_jdbc(Session(), "jdbc:x", "t", "id", 0, 100, 4)
    assert seen["numPartitions"] == 4 and seen["column"] == "id" and seen["upperBound"] == 100


def test_stage_cuts_lineage(spark):
    staged = session.stage(spark.range(10).withColumn("v", Vectors_column()), "t", even=True)
    assert staged.count() == 10
    plan = staged._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "Range" not in plan


def Vectors_column():
    from pyspark.ml.functions import array_to_vector

    return array_to_vector(F.array(F.col("id").cast("double")))


def test_shared_folder_must_be_named(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def __init__(self, value):
            self.value = value

        def get(self, name, default=None):
            return self.value or default

    class Session:
        sparkContext = Context()
        conf = Conf(None)

    with pytest.raises(ValueError):
        session.shared_dir(Session())
    Session.conf = Conf("hdfs:///shared/")
    assert session.shared_dir(Session()) == "hdfs:///shared"


LOG = "id bigint, ts timestamp_ntz, TargetUserName string, Task string"


def stream_rows(spark, rows):
    return spark.createDataFrame(rows, "id bigint, s bigint, TargetUserName string, Task string").select(
        "id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "TargetUserName", "Task"
    )


def run_stream(spark, folder, make):
    """Read the files in ``folder`` one by one, as far as there are any, and append the result."""
    schema = spark.createDataFrame([], LOG).schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder + "/input")
    result = make(source)
    query = login_stream.write_stream(result, folder, {"availableNow": True})
    query.awaitTermination()
    assert query.exception() is None
    return spark.read.schema(result.schema).parquet(folder + "/output")


def test_stream_equals_batch(spark):
    """Several micro-batches and a restart, rows out of order within the delay."""
    rnd = random.Random(9)
    rows = [
        (i, i * 60, rnd.choice(["a", "a", "b", None]), rnd.choice(["LoginFailure", "LoginFailure", "LogOn", "X"]))
        for i in range(200)
    ]
    # The last row only moves the watermark on.
    rows.append((999, 10**6, "z", "LoginFailure"))
    df = stream_rows(spark, rows)
    rule = SequenceRule()
    delay = timedelta(minutes=20)
    flagged = consecutive_failures(df, rule).filter("label = 1 and id < 999")
    expected = sorted((r.TargetUserName or "", r.id) for r in flagged.collect())
    failed = df.filter("Task = 'LoginFailure' and id < 999").select("TargetUserName", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    hours = Counter((r.TargetUserName, r.t // 3_600_000_000) for r in failed.collect())
    made = {
        "flags": lambda s: login_stream.flagged_failures(s, rule, "ts", delay),
        "windows": lambda s: login_stream.failure_windows(s, rule, "ts", timedelta(hours=1), delay),
    }
    folders = {n: session.scratch_path(spark, n) for n in made}
    # Files of 50 rows; every file holds rows of the one before it and the one after it.
    for start in (0, 50, 100, 150, 200):
        ids = list(range(start, start + 50)) if start < 200 else [999]
        if start + 50 < 200:
            ids = [i for i in ids if i != start + 45] + [start + 52]
        if 0 < start < 200:
            ids = [i for i in ids if i != start + 2] + [start - 5]
        for folder in folders.values():
            df.filter(F.col("id").isin(ids)).coalesce(1).write.mode("append").parquet(folder + "/input")
        if start in (100, 200):
            found = {n: run_stream(spark, folders[n], make) for n, make in made.items()}
    assert sorted((r.user or "", r.id) for r in found["flags"].collect()) == expected and expected
    windows = found["windows"].select("user", F.unix_micros("started").alias("t"), "failures").collect()
    assert {(r.user, r.t // 3_600_000_000): r.failures for r in windows} == hours


def test_late_rows_and_rows_without_time_are_left_out(spark):
    folder = session.scratch_path(spark, "late")

    def add(*rows):
        data = [(i, s, u, "LoginFailure") for i, s, u in rows]
        stream_rows(spark, data).coalesce(1).write.mode("append").parquet(folder + "/input")

    rule = SequenceRule(threshold=3)

    def make(source):
        return login_stream.flagged_failures(source, rule, "ts", timedelta(minutes=1))

    add((1, 10, "a"), (2, 20, "a"), (9, 5000, "a"), (8, None, "a"))
    run_stream(spark, folder, make)
    add((3, 30, "a"))
    run_stream(spark, folder, make)
    add((10, 9000, "a"))
    found = run_stream(spark, folder, make).collect()
    # The third failure is row 9: row 3 came too late, row 8 at no time.
    assert [(r.user, r.id, r.micros) for r in found] == [("a", 9, 5_000_000_000)]


def test_stream_query_labels_every_event(spark, tmp_path):
    """Also those of the last hour, without a time or a user, early ones, and other types."""
    rnd = random.Random(12)
    rows = [
        (i, None if rnd.random() < 0.1 else i * 60 - 3000, rnd.choice([1, 1, 2, None]),
         rnd.choice(["error", "error", "error", "purchase", "click", None]), 1.0)
        for i in range(200)
    ]
    df = spark.createDataFrame(rows, "event_id bigint, s bigint, user_id bigint, event_type string, value double")
    log = df.withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz")).drop("s")
    log.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    found = catalog.QUERIES["consecutive_failures_stream"](spark, str(tmp_path))
    assert found.columns == ["event_id", "user_id", "event_type", "label"]
    runs, expected = {}, []
    for i, _, user, kind, _ in rows:
        runs[user] = 0 if kind == "purchase" else runs.get(user, 0) + (kind == "error")
        expected.append((i, user, kind, int(kind == "error" and runs[user] >= 3)))
    assert sorted(map(tuple, found.collect())) == expected
    assert sum(r[3] for r in expected[-60:]) > 5


def test_a_window_of_no_rows(spark):
    folder = session.scratch_path(spark, "none")
    stream_rows(spark, []).write.parquet(folder + "/input")

    def make(source):
        return login_stream.failure_windows(source, SequenceRule(), "ts", timedelta(hours=1), timedelta(0))

    assert run_stream(spark, folder, make).count() == 0


TEXTS = [
    "plain", "a\nb", "a\r\nb", "\r", " lead", "trail \t", " ", "", "null", None, 'q"x', '"', '""',
    "\\", "a\\", '\\"', '"\n', "x,y", ",", "#c", "\t", "\\N", "'",
]


def test_csv_keeps_texts(spark, tmp_path):
    """Line breaks, outer blanks, quotes, backslashes; the empty text is not null."""
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string").repartition(3)
    tables.write_csv(df, str(tmp_path / "t"), file_rows=4)
    found = {r.id: r.t for r in tables.scan_csv(spark, str(tmp_path / "t"), "id int, t string").collect()}
    assert found == dict(enumerate(TEXTS))
    assert len(list((tmp_path / "t").glob("part-*"))) >= 6
