"""Training, scoring and stored models."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.base import Estimator
from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame

from tallywatch.functions.columns import c
from tallywatch.operators.metrics import threshold_prediction
from tallywatch.operators.reports import class_distribution
from tallywatch.session import stage

# Columns MLlib adds beside the prediction.
MODEL_COLUMNS = ("rawPrediction", "probability", "features")


def linear(label: str = "label", features: str = "features") -> Estimator:
    # Fixed value: the penalty.
    return LinearRegression(featuresCol=features, labelCol=label, regParam=0.01)


def logistic(label: str = "label", features: str = "features") -> Estimator:
    return LogisticRegression(featuresCol=features, labelCol=label)


def forest(label: str = "label", features: str = "features", seed: int = 42) -> Estimator:
    return RandomForestClassifier(featuresCol=features, labelCol=label, seed=seed)


def svm(label: str = "label", features: str = "features") -> Estimator:
    # Iterations and penalty.
    return LinearSVC(featuresCol=features, labelCol=label, maxIter=100, regParam=0.0001)


def fit(df: DataFrame, estimator: Estimator) -> PipelineModel:
    """Train on the label and features of ``df``.

    They are staged first: a trainer passes over its rows many times, and both
    its tasks and the recovery of a lost executor should start from files.
    """
    columns = (estimator.getLabelCol(), estimator.getFeaturesCol())
    rows = stage(df.select(*map(c, columns)), "training", even=True)
    return Pipeline(stages=[estimator]).fit(rows)


def _staged(df: DataFrame) -> DataFrame:
    """What made ``df`` runs once: training and scoring both read the staged rows."""
    return stage(df, "scored-rows")


def score_linear(model: PipelineModel, df: DataFrame, at: float = 0.8) -> DataFrame:
    """Regression scores turned into classes."""
    return threshold_prediction(model.transform(df), at)


def fit_linear(df: DataFrame, label: str = "label") -> DataFrame:
    rows = _staged(df)
    return score_linear(fit(rows, linear(label)), rows)


def fit_logistic(df: DataFrame, label: str = "label") -> DataFrame:
    rows = _staged(df)
    return fit(rows, logistic(label)).transform(rows)


def fit_forest(df: DataFrame, label: str = "label") -> DataFrame:
    rows = _staged(df)
    return fit(rows, forest(label)).transform(rows)


def fit_svm(df: DataFrame, label: str = "label") -> DataFrame:
    rows = _staged(df)
    return fit(rows, svm(label)).transform(rows)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def shape_scores(df: DataFrame, name: str = "Threat") -> DataFrame:
    """Drop the model's working columns and call the prediction ``name``."""
    return df.drop(*MODEL_COLUMNS).withColumnRenamed("prediction", name)


def load_and_score(path: str, df: DataFrame, name: str = "Threat") -> DataFrame:
    return shape_scores(PipelineModel.load(path).transform(df), name)


def threat_counts(scores: DataFrame, name: str = "Threat") -> DataFrame:
    return class_distribution(scores, name)
