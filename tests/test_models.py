"""Metrics against MLlib's evaluators, models, stored models and the whole job."""

import random

import pytest
from pyspark.ml.evaluation import (
    BinaryClassificationEvaluator,
    MulticlassClassificationEvaluator,
    RegressionEvaluator,
)
from pyspark.sql import functions as F

from tallywatch.operators import metrics, model
from tallywatch.operators.sequence import SequenceRule
from tallywatch.plans.pipeline import FittedPipeline, PipelineSpec, run_pipeline
from tallywatch.sources import tables


def scored(spark, n=400, seed=1):
    rnd = random.Random(seed)
    rows = [
        (float(rnd.random() < 0.3), rnd.choice([round(rnd.random(), 2), 0.5, rnd.gauss(0.4, 1)]))
        for _ in range(n)
    ]
    return spark.createDataFrame(rows, "label double, prediction double").repartition(3)


def test_fixed_metrics(spark):
    pairs = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0), (1.0, 1.0)]
    df = spark.createDataFrame(pairs, "label double, prediction double")
    m = metrics.multiclass_metrics(df).first().asDict()
    assert m == pytest.approx(
        {
            "f1": 0.6, "weightedPrecision": 0.6, "weightedRecall": 0.6, "accuracy": 0.6,
            "falsePositiveRateByLabel": 1 / 3, "precisionByLabel": 0.5, "recallByLabel": 0.5,
        }
    )
    b = metrics.binary_metrics(df).first()
    assert tuple(b) == pytest.approx((0.583333, 0.655556), abs=1e-6)
    pairs = [(0.0, 0.1), (0.0, 0.3), (1.0, 0.9), (1.0, 0.2), (1.0, 1.2)]
    df = spark.createDataFrame(pairs, "label double, prediction double")
    r = metrics.regression_metrics(df).first()
    assert tuple(r) == pytest.approx((0.397492, 0.158, 0.341667, 0.19, 0.3), abs=1e-6)
    assert metrics.binary_metrics(df).first()[0] == pytest.approx(0.833333, abs=1e-6)


def test_metrics_equal_mllib(spark):
    df = scored(spark).cache()
    found = metrics.binary_metrics(df).first().asDict()
    for name, value in found.items():
        evaluator = BinaryClassificationEvaluator(
            rawPredictionCol="prediction", metricName=name, numBins=0
        )
        assert value == pytest.approx(evaluator.evaluate(df), abs=1e-9)
    for name, value in metrics.regression_metrics(df).first().asDict().items():
        expected = RegressionEvaluator(metricName=name).evaluate(df)
        assert value == pytest.approx(expected, abs=1e-9)
    three = df.withColumn("prediction", F.pmod(F.floor(F.col("prediction") * 4), F.lit(3)).cast("double"))
    for name, value in metrics.multiclass_metrics(three).first().asDict().items():
        expected = MulticlassClassificationEvaluator(metricName=name).evaluate(three)
        assert value == pytest.approx(expected, abs=1e-9), name


def test_one_class_only(spark):
    df = spark.createDataFrame([(1.0, 0.5), (1.0, 0.7)], "label double, prediction double")
    assert metrics.binary_metrics(df).first()["areaUnderROC"] is None


def test_threshold(spark):
    df = spark.createDataFrame([(0.79,), (0.8,), (None,)], "prediction double")
    assert [r[0] for r in metrics.threshold_prediction(df).collect()] == [0, 1, 0]


def logins(spark, n=900):
    """Logins in which one user fails most of the time."""
    rnd = random.Random(4)
    rows = []
    for i in range(n):
        user = rnd.choice(["mallory", "mallory", "ann", "bob"])
        weights = (8, 1, 1) if user == "mallory" else (1, 6, 3)
        task = rnd.choices(["LoginFailure", "LogOn", "LogOff"], weights)[0]
        rows.append((i, user, task, float(rnd.randrange(20)), None, f"ws-{i % 5} floor {i % 3}"))
    schema = "id bigint, TargetUserName string, Task string, `size.kb` double, nothing string, host string"
    return spark.createDataFrame(rows, schema)


def test_each_model(spark, tmp_path):
    df = spark.createDataFrame(
        [(int(i % 4 == 0), float(i % 4 == 0) + i % 3 / 10, float(i % 7)) for i in range(200)],
        "label int, a double, b double",
    )
    from tallywatch.operators.encode import assemble

    ready = assemble(df)
    for run in (model.fit_linear, model.fit_logistic, model.fit_forest):
        out = run(ready)
        assert out.count() == 200
        assert {r[0] for r in out.select("prediction").distinct().collect()} <= {0, 1}
        assert metrics.multiclass_metrics(out).first()["accuracy"] > 0.9
    fitted = model.fit(ready, model.forest())
    path = str(tmp_path / "forest")
    model.save_model(fitted, path)
    model.save_model(fitted, path)
    loaded = model.load_and_score(path, ready)
    assert loaded.columns == ["label", "a", "b", "Threat"]
    assert dict(model.threat_counts(loaded).collect()) == {0.0: 150, 1.0: 50}


SPECS = [
    dict(model="Logistic_regression", scaling="Standered_scaler", selection="Chisqselector"),
    dict(model="Random_forest", formatting="Lebel_encoding", scaling="Bucketizer"),
    dict(model="Linear_regression", formatting="HashingTF_Encoding", scaling="Standered_scaler",
         selection="Chisqselector", text_slots=32, threshold=0.3),
    dict(model="Linear_SVM", scaling="Minmax_scaler"),
]


@pytest.mark.parametrize("options", SPECS, ids=lambda o: o["model"])
def test_pipeline(spark, tmp_path, options):
    cleaning = ("Clean_data", "Handle_null_values", "Remove_outliers", "Balance_data")
    run = run_pipeline(logins(spark), PipelineSpec(cleaning=cleaning, **options))
    counts = run.counts().first()
    assert counts["normal"] + counts["anomaly"] == run.scores.count() == 900
    assert 0 < run.held_out.count() < 300
    # On labels that the features say little about.
    assert run.binary().first()["areaUnderROC"] > 0.4
    assert 0 <= run.multiclass().first()["accuracy"] <= 1
    # A stored pipeline scores new rows, without label, as the fitted one does.
    path = str(tmp_path / "run")
    run.fitted.save(path)
    again = FittedPipeline.load(spark, path)
    assert again.spec == run.fitted.spec
    new = logins(spark).drop("nothing")
    before = dict(run.fitted.transform(new).select("id", "prediction").collect())
    assert dict(again.transform(new).select("id", "prediction").collect()) == before
    assert before == dict(run.scores.select("id", "prediction").collect())


def test_csv_train_and_score(spark, tmp_path):
    """A text label named ``class``, no id, training and test files apart."""
    df = logins(spark, 300).withColumnRenamed("size.kb", "size").drop("nothing", "id")
    labeled = df.withColumn(
        "class", F.when(F.col("Task") == "LoginFailure", "anomaly").otherwise("normal")
    )
    tables.write_csv(labeled, str(tmp_path / "train"))
    tables.write_csv(df, str(tmp_path / "test"))
    train, test = tables.read_data(spark, str(tmp_path / "train"), str(tmp_path / "test"))
    spec = PipelineSpec(
        rule=None, label="class", model="Random_forest", formatting="Lebel_encoding",
        scaling="Standered_scaler", selection="Chisqselector",
    )
    run = run_pipeline(train, spec)
    assert run.multiclass().first()["accuracy"] == 1.0
    threats = dict(model.threat_counts(model.shape_scores(run.fitted.transform(test))).collect())
    classes = dict(labeled.groupBy("class").count().collect())
    assert sorted(threats.values()) == sorted(classes.values())


def test_spec_is_checked():
    with pytest.raises(ValueError):
        PipelineSpec(model="Perceptron")
    with pytest.raises(ValueError):
        PipelineSpec(cleaning=("Scrub",))
    assert PipelineSpec(rule=SequenceRule(threshold=4)).rule.threshold == 4
