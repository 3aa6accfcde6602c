"""The failure rule against a plain loop, on hand-made and on random logs."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallywatch.operators import sequence
from tallywatch.operators.sequence import (
    SequenceRule,
    consecutive_failures,
    rule_hits,
    user_state,
)

SCHEMA = "id bigint, TargetUserName string, Task string, label int, note string"
NAMES = {"F": "LoginFailure", "L": "LogOn", "O": "LogOff", "X": "Other", "-": None}


def log(spark, rows, partitions=3):
    """Rows of (user, letter) in order."""
    data = [(i, u, NAMES[t], 0, f"n{i}") for i, (u, t) in enumerate(rows)]
    random.Random(len(data)).shuffle(data)
    return spark.createDataFrame(data, SCHEMA).repartition(partitions)


def by_loop(rows, threshold=3):
    counter, labels = {}, []
    for user, task in rows:
        if task == "F":
            counter[user] = counter.get(user, 0) + 1
        elif task == "L":
            counter[user] = 0
        labels.append(int(task == "F" and counter[user] >= threshold))
    return labels, counter


def labels_of(df):
    return [r["label"] for r in df.orderBy("id").collect()]


CASES = {
    "below threshold": ("FF", [0, 0], 2),
    "third and later": ("FFFF", [0, 0, 1, 1], 4),
    "reset": ("FFLFF", [0, 0, 0, 0, 0], 2),
    "reset after alert": ("FFFLF", [0, 0, 1, 0, 0], 1),
    "logoff does not reset": ("FFOF", [0, 0, 0, 1], 3),
    "other task does not reset": ("FFXF", [0, 0, 0, 1], 3),
    "missing task does not reset": ("FF-F", [0, 0, 0, 1], 3),
    "only logon": ("L", [0], 0),
    "only logoff": ("O", [0], None),
}


def test_cases(spark):
    """Every case as one user's log, and once more for the missing user."""
    users = [*CASES, None]
    tasks = {u: CASES[u or "third and later"][0] for u in users}
    df = log(spark, [(u, t) for u in users for t in tasks[u]])
    labels = {u: [] for u in users}
    for r in consecutive_failures(df).orderBy("id").collect():
        labels[r["TargetUserName"]].append(r["label"])
    state = dict(user_state(df).collect())
    for u in users:
        _, expected, counter = CASES[u or "third and later"]
        assert labels[u] == expected, u
        assert state.get(u) == counter, u


def test_users_are_separate_and_case_sensitive(spark):
    rows = [("a", "F"), ("b", "F"), ("a", "F"), ("b", "F"), ("a", "F")]
    assert labels_of(consecutive_failures(log(spark, rows))) == [0, 0, 0, 0, 1]
    rows = [("Ram", "F"), ("ram", "F"), ("Ram", "F")]
    assert labels_of(consecutive_failures(log(spark, rows))) == [0, 0, 0]
    assert dict(user_state(log(spark, rows)).collect()) == {"Ram": 2, "ram": 1}


@pytest.mark.parametrize("seed", range(5))
def test_random_logs(spark, seed):
    """Whether and where users are cut never changes the loop's labels; one user
    holds a large part of the rows."""
    rnd = random.Random(seed)
    users = ["hot"] * 5 + [None, "b", "c", "d"]
    rows = [(rnd.choice(users), rnd.choice("FFFLOX")) for _ in range(rnd.choice([5, 60, 300]))]
    threshold = rnd.choice([1, 2, 3, 5])
    rule = SequenceRule(threshold=threshold, task_rows=[1, 5, 40, 100, 10**6][seed])
    labels, counter = by_loop(rows, threshold)
    df = log(spark, rows, rnd.choice([1, 4, 7]))
    result = consecutive_failures(df, rule)
    assert labels_of(result) == labels
    assert dict(user_state(df, rule).collect()) == counter
    # Everything but the label is unchanged.
    rest = result.select("id", "TargetUserName", "Task", "note").collect()
    assert Counter(rest) == Counter(df.select("id", "TargetUserName", "Task", "note").collect())


def test_several_rules(spark):
    rows = [("a", "F")] * 6
    rules = [SequenceRule(name="three"), SequenceRule(name="five", threshold=5)]
    hits = rule_hits(log(spark, rows), rules).groupBy("rule").count().collect()
    assert dict(hits) == {"three": 4, "five": 2}


def test_negative_and_sparse_ids(spark):
    ids = [-(10**12), -70_000_000, -1, 0, 10**15]
    df = spark.createDataFrame(
        [(i, "u", "LoginFailure") for i in ids], "id bigint, TargetUserName string, Task string"
    )
    assert labels_of(consecutive_failures(df)) == [0, 0, 1, 1, 1]
    cut = SequenceRule(task_rows=1)
    assert labels_of(consecutive_failures(df, cut)) == [0, 0, 1, 1, 1]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert consecutive_failures(df).count() == 0
    assert user_state(df).count() == 0


def test_bad_rule():
    with pytest.raises(ValueError):
        SequenceRule(threshold=0)


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan(spark):
    """One shuffle by user; nothing is joined and no task holds everything."""
    df = log(spark, [("a", "F"), ("b", "L")] * 50)
    plan = executed(consecutive_failures(df.filter(F.col("id") >= 0)))
    final = plan.split("== Initial Plan ==")[0]
    assert "SinglePartition" not in plan and "Join" not in plan
    assert final.count("Exchange hashpartitioning") == 1


def test_plan_with_busy_user(spark):
    """Both steps for the busy user share the shuffle of their pieces, and only the
    pieces' ends are shuffled again."""
    df = log(spark, [("a", "F")] * 300 + [(f"u{i}", "L") for i in range(300)])
    result = consecutive_failures(df, SequenceRule(task_rows=100))
    plan = executed(result)
    final = plan.split("== Initial Plan ==")[0].splitlines()
    assert "SinglePartition" not in plan and "SortMergeJoin" not in plan
    shuffles = [x for x in final if "Exchange hashpartitioning" in x]
    reused = [x for x in shuffles if "ReusedExchange" in x]
    # By user, by user and piece, the pieces' ends by user; one of them read twice.
    assert len(shuffles) - len(reused) == 3
    assert labels_of(result)[:5] == [0, 0, 1, 1, 1]


@pytest.mark.parametrize("rows", [400, 4000])
def test_no_piece_grows_with_the_log(spark, rows):
    """However long the log of one user, a piece stays near the wanted size."""
    df = log(spark, [("a", "F")] * rows + [("b", "F")] * 20)
    whole, pieces = sequence._split(df.select("id", "TargetUserName", "Task"), SequenceRule(task_rows=100))
    sizes = [r["count"] for r in pieces.groupBy("TargetUserName", "_piece").count().collect()]
    assert max(sizes) <= 250 and sum(sizes) == rows
    assert whole.count() == 20


def test_rules_share_a_pass(spark, tmp_path):
    """Two rules of equal key read the log and sort it once."""
    log(spark, [("a", "F")] * 9 + [("b", "F")] * 4).write.parquet(str(tmp_path / "log"))
    df = spark.read.parquet(str(tmp_path / "log"))
    rules = [SequenceRule(name="three"), SequenceRule(name="five", threshold=5)]
    result = rule_hits(df, rules)
    plan = executed(result).split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1
    assert dict(result.groupBy("rule").count().collect()) == {"three": 7 + 2, "five": 5}
