"""Encoders, scalers, selection, balancing: fixed examples and MLlib as the yardstick."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.ml.feature import HashingTF, StringIndexer, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import ChiSquareTest
from pyspark.sql import functions as F
from pyspark.sql.utils import IllegalArgumentException

from tallywatch.operators import balance, encode, scale, select
from tallywatch.operators.encode import LabelEncoder
from tallywatch.session import stage


def column(df, name):
    return [r[0] for r in df.select(name).collect()]


def test_hash_encode(spark):
    df = spark.createDataFrame([("a", "k", 1), ("b", "k", 2), (None, "k", 3)], "s string, class string, n int")
    hashed = encode.hash_encode(df)
    assert column(hashed.orderBy("n"), "s") == [1485273170, 1905031361, 42]
    assert dict(hashed.dtypes) == {"s": "int", "class": "string", "n": "int"}


WORDS = ["z", "b", "z", "a", "b", "c"]


def test_label_encode(spark):
    df = spark.createDataFrame([(w, i) for i, w in enumerate(WORDS)] + [(None, 6)], "s string, i int")
    fitted = LabelEncoder.fit(df)
    assert column(fitted.transform(df).orderBy("i"), "s") == [1, 0, 1, 2, 0, 3, 4]
    unseen = spark.createDataFrame([("new", 1), ("b", 2)], "s string, i int")
    assert column(fitted.transform(unseen).orderBy("i"), "s") == [4, 0]
    indexer = StringIndexer(inputCol="s", outputCol="x", handleInvalid="keep").fit(df)
    assert column(indexer.transform(df).orderBy("i"), "x") == [1, 0, 1, 2, 0, 3, 4]


def test_label_encode_many_values(spark, monkeypatch, tmp_path):
    """Values that are not frequent enough for the broadcast; long ones that are."""
    monkeypatch.setattr(encode, "FREQUENT", 12)
    values = [f"w{i}" for i in range(20) for _ in range(1 + i % 4)] + ["a long value" * 99] * 9 + [None]
    df = spark.createDataFrame([(v, v and v[:2]) for v in values], "s string, `t.x` string")
    fitted = LabelEncoder.fit(df)
    for name in ("s", "t.x"):
        counts = Counter(v if name == "s" else v[:2] for v in values if v)
        order = sorted(counts, key=lambda v: (-counts[v], v))
        expected = Counter(order.index(v if name == "s" else v[:2]) if v else len(order) for v in values)
        assert Counter(column(fitted.transform(df), f"`{name}`")) == expected
    fitted.save(str(tmp_path / "encoder"))
    again = LabelEncoder.load(spark, str(tmp_path / "encoder"))
    assert Counter(again.transform(df).collect()) == Counter(fitted.transform(df).collect())


@pytest.mark.parametrize("k", [1, 2, 5])
def test_label_encode_reads_its_input_once(spark, monkeypatch, k):
    """Columns of many values: one scan of the input, and a plan that does not grow with them."""
    monkeypatch.setattr(encode, "FREQUENT", 10)
    rng = random.Random(4)
    rows = [tuple(rng.choice([None, "often", "often", f"v{rng.randrange(60)}"]) for _ in range(k)) for _ in range(300)]
    names = [f"s{i}" for i in range(k)]
    source = stage(spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)), "source")
    fitted = LabelEncoder.fit(source)
    staged = []
    monkeypatch.setattr(encode, "stage", lambda df, name: staged.append(df) or stage(df, name))
    found = fitted.transform(source)

    def leaves(df):
        return df._jdf.queryExecution().optimizedPlan().collectLeaves().size()

    assert len(staged) == 1 and leaves(staged[0]) == 1 + k  # the input, and a broadcast per column
    assert leaves(found) == 4  # closed rows, open rows, open cells, the table
    expected = []
    orders = []
    for i in range(k):
        counts = Counter(r[i] for r in rows if r[i] is not None)
        orders.append(sorted(counts, key=lambda v: (-counts[v], v)))
    for r in rows:
        expected.append(tuple(float(o.index(v)) if v is not None else float(len(o)) for o, v in zip(orders, r)))
    assert Counter(map(tuple, found.collect())) == Counter(expected)


TEXTS = ["  Foo  BAR x", "", "   ", "a\tb\n c  ", "one", "É à b", None]


def test_tokens_and_counts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    split = dict(encode.tokenize(df, "t", "w").select("i", "w").collect())
    assert split[0] == ["", "", "foo", "", "bar", "x"]
    assert split[6] == [""]
    known = df.filter("t is not null")
    words = Tokenizer(inputCol="t", outputCol="w").transform(known)
    assert {r["i"]: r["w"] for r in words.collect()} == {i: w for i, w in split.items() if i < 6}
    counted = HashingTF(inputCol="w", outputCol="v", numFeatures=64).transform(words)
    expected = dict(counted.select("i", "v").collect())
    assert dict(encode.hashing_tf(known, num_features=64).collect()) == expected


def test_assemble(spark):
    df = spark.createDataFrame([(1, 2.0, 3, "s", 1)], "id int, a double, b bigint, s string, label int")
    assert column(encode.assemble(df), "features") == [Vectors.dense([2.0, 3.0])]
    hole = spark.createDataFrame([(1, None)], "id int, a double")
    with pytest.raises(Exception, match="null"):
        encode.assemble(hole).collect()
    times = df.withColumn("t", F.lit("2024-01-07 13:45:00").cast("timestamp_ntz"))
    parts = encode.time_parts(times).select("t_hour", "t_dow").first()
    assert tuple(parts) == (13, 1)


def vectors(spark):
    rows = [(float(i), float((i * 7) % 5) - 2, 3.0) for i in range(1, 9)]
    df = spark.createDataFrame(rows, "a double, b double, one double")
    return encode.assemble(df), rows


def entries(df):
    return [tuple(r[0]) for r in df.orderBy("a").select(vector_to_array("features")).collect()]


def test_scalers(spark):
    df, rows = vectors(spark)
    a, b, _ = zip(*rows)
    assert entries(scale.max_abs_scale(df)) == [
        pytest.approx((x / 8, y / max(map(abs, b)), 1)) for x, y, _ in rows
    ]
    assert entries(scale.min_max_scale(df)) == [
        pytest.approx(((x - 1) / 7, (y - min(b)) / (max(b) - min(b)), 0.5)) for x, y, _ in rows
    ]
    mean, dev = 4.5, 6**0.5
    found = entries(scale.standard_scale(df))
    assert [f[0] for f in found] == pytest.approx([(x - mean) / dev for x in a])
    assert {f[2] for f in found} == {0.0}
    exact = entries(scale.robust_scale(df, exact_from=["a", "b", "one"]))
    assert [f[0] for f in exact] == pytest.approx([x / (6 - 2) for x in a])
    assert {f[2] for f in exact} == {0.0}
    assert {f[2] for f in entries(scale.robust_scale(df))} == {0.0}
    normed = entries(scale.l1_normalize(df))
    assert [sum(map(abs, f)) for f in normed] == pytest.approx([1.0] * 8)


def test_bucketize(spark):
    data = [(-1.0,), (-0.5,), (0.0,), (0.5,), (None,), (float("nan"),)]
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(data)], "id int, x double")
    assert column(scale.bucketize(df).orderBy("id"), "x") == [0, 1, 2, 3, None, 4]


def test_chi_square(spark):
    rows = [(i % 2, float(i % 2 * (i % 5 > 0)), float(i % 3), float(i % 7), i * 1.0) for i in range(420)]
    df = spark.createDataFrame(rows, "label int, a double, b double, c double, d double")
    names = ["a", "b", "c", "d"]
    table = {r[0]: (r[1], r[2]) for r in select.chi_square_table(df, names).collect()}
    ready = encode.assemble(df)
    test = ChiSquareTest.test(ready, "features", "label").first()
    for i, name in enumerate(names):
        assert table[name][0] == pytest.approx(test["statistics"][i], rel=1e-9, abs=1e-6)
        assert table[name][1] == test["degreesOfFreedom"][i]
    kept = select.chi_square_select(ready, top=1).first()["selectedFeatures"]
    assert kept.size == 1 and kept[0] == rows[0][1]
    assert select.selected_indices(df, names, top=1, bins=4) == [0]


def labels(spark, ones=30, zeros=400):
    rows = [(i, int(i < ones)) for i in range(ones + zeros)] + [(-1, 7), (-2, None)]
    return spark.createDataFrame(rows, "id bigint, label int").repartition(4)


@pytest.mark.parametrize("digits", [1, 5])
@pytest.mark.parametrize("ratio", [0.0, 0.5, 1.0, 1.3, 100.0])
def test_balance(spark, monkeypatch, digits, ratio):
    monkeypatch.setattr(balance, "DIGITS", digits)
    found = sorted(map(tuple, balance.balance(labels(spark), ratio=ratio).collect()))
    order = sorted(range(30, 430), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    expected = [(i, 1) for i in range(30)] + [(i, 0) for i in order[: int(30 * ratio)]]
    assert found == sorted(expected)


def test_balance_whole(spark):
    assert balance.balance(labels(spark), ratio=None).count() == 430


def test_split(spark):
    df = spark.range(2000)
    train, test = balance.train_test_split(df, "id")
    assert train.union(test).distinct().count() == 2000
    assert 1500 < train.count() < 1700
    assert train.repartition(7).exceptAll(balance.train_test_split(df.repartition(5), "id")[0]).isEmpty()


def test_discretizer_rejects_nothing(spark):
    """Constant and empty columns still get valid bins."""
    df = spark.createDataFrame([(1.0, None), (1.0, None)], "a double, b double")
    binned = select.discretizer(df, ["a", "b"], 4).transform(df)
    assert column(binned, "_bin_0") == [1.0, 1.0]


def test_selector_refuses_continuous(spark):
    df = spark.range(10_500).select((F.col("id") % 2).alias("label"), F.col("id").cast("double").alias("x"))
    with pytest.raises((IllegalArgumentException, Exception)):
        select.chi_square_select(encode.assemble(df), top=1).collect()
    assert select.selected_indices(df, ["x"], top=1) == [0]
