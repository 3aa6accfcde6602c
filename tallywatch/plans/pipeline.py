"""The configurable training job: label, clean, encode, scale, select, train, count."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallywatch.functions.columns import c, string_columns
from tallywatch.operators import clean, encode, model, scale, select
from tallywatch.operators.balance import balance, train_test_split
from tallywatch.operators.metrics import (
    binary_metrics,
    multiclass_metrics,
    regression_metrics,
    threshold_prediction,
)
from tallywatch.operators.reports import prediction_counts
from tallywatch.operators.sequence import SequenceRule, consecutive_failures
from tallywatch.session import stage

# The option names of each step.
CLEANING = ("Clean_data", "Handle_null_values", "Remove_outliers", "Balance_data")
FORMATTING = ("Lebel_encoding", "Hash_encoding", "HashingTF_Encoding")
SCALING = ("Standered_scaler", "Robust_scaler", "Minmax_scaler", "MinAbs_scaler", "Bucketizer")
SELECTION = ("Chisqselector",)
MODELS = ("Random_forest", "Linear_regression", "Logistic_regression", "Linear_SVM")

ESTIMATORS = dict(zip(MODELS, (model.forest, model.linear, model.logistic, model.svm)))


@dataclass(frozen=True)
class PipelineSpec:
    """What to run. ``rule=None`` trains on a ``label`` the input already has."""

    model: str = "Logistic_regression"
    formatting: str = "Hash_encoding"
    scaling: str | None = None
    selection: str | None = None
    cleaning: tuple[str, ...] = ()
    rule: SequenceRule | None = field(default_factory=SequenceRule)
    key: str = "id"
    label: str = "label"
    balance_ratio: float = 1.3
    text_slots: int = 1024
    threshold: float = 0.8

    def __post_init__(self) -> None:
        object.__setattr__(self, "cleaning", tuple(self.cleaning))
        for value, allowed in (
            (self.model, MODELS),
            (self.formatting, FORMATTING),
            (self.scaling, (None, *SCALING)),
            (self.selection, (None, *SELECTION)),
            *((step, CLEANING) for step in self.cleaning),
        ):
            if value not in allowed:
                raise ValueError(f"unknown option {value!r}, expected one of {allowed}")


@dataclass
class FittedPipeline:
    """Encoder and model, fitted once and applied unchanged to any later table."""

    spec: PipelineSpec
    stages: PipelineModel
    encoder: encode.LabelEncoder | None = None

    def features(self, df: DataFrame) -> DataFrame:
        """The cleaning that needs no statistics, then the encoding."""
        if "Clean_data" in self.spec.cleaning:
            df = clean.normalize_names(df)
        if "Handle_null_values" in self.spec.cleaning:
            df = _filled(df, self.spec)
        df = encode.time_parts(df)
        if self.encoder is not None:
            return self.encoder.transform(df)
        if self.spec.formatting == "HashingTF_Encoding":
            texts = string_columns(df, (self.spec.label,))
            return encode.hashing_tf(df, texts, self.spec.text_slots)
        return encode.hash_encode(df, exclude=(self.spec.label,))

    def transform(self, df: DataFrame) -> DataFrame:
        scored = self.stages.transform(self.features(df))
        if self.spec.model == "Linear_regression":
            return threshold_prediction(scored, self.spec.threshold)
        return scored

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        self.stages.write().overwrite().save(path + "/stages")
        if self.encoder is not None:
            self.encoder.save(path + "/encoder")
        text = json.dumps(asdict(self.spec))
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(
            path + "/spec"
        )

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FittedPipeline:
        values = json.loads(spark.read.text(path + "/spec", wholetext=True).first()[0])
        if values["rule"] is not None:
            values["rule"] = SequenceRule(**values["rule"])
        spec = PipelineSpec(**values)
        encoder = None
        if spec.formatting == "Lebel_encoding":
            encoder = encode.LabelEncoder.load(spark, path + "/encoder")
        return cls(spec, PipelineModel.load(path + "/stages"), encoder)


@dataclass
class PipelineRun:
    """``scores`` covers every row, the metrics only the held-out ones with a label."""

    fitted: FittedPipeline
    scores: DataFrame
    held_out: DataFrame

    def counts(self) -> DataFrame:
        return prediction_counts(self.scores)

    def binary(self) -> DataFrame:
        """Areas under the curves of the raw score, or of the linear model's class."""
        raw = "rawPrediction" in self.held_out.columns
        score = "rawPrediction" if raw else "prediction"
        return binary_metrics(self.held_out, self.fitted.spec.label, score)

    def regression(self) -> DataFrame:
        return regression_metrics(self.held_out, self.fitted.spec.label)

    def multiclass(self) -> DataFrame:
        return multiclass_metrics(self.held_out, self.fitted.spec.label)


def clean_data(df: DataFrame, spec: PipelineSpec) -> DataFrame:
    """The row and column cleaning steps in the order given."""
    for step in spec.cleaning:
        if step == "Clean_data":
            df = clean.drop_empty_columns(clean.normalize_names(df))
        elif step == "Handle_null_values":
            df = _filled(df, spec)
    return df


def _filled(df: DataFrame, spec: PipelineSpec) -> DataFrame:
    """Nulls filled in every column but the key and the label, which are never made up."""
    kept = {n.lower() for n in (spec.key, spec.label)}
    return clean.fill_nulls(df, exclude=[n for n in df.columns if n.lower() in kept])


def _feature_stages(train: DataFrame, spec: PipelineSpec, columns: list[str]) -> list[Transformer]:
    """Fitted stages from numeric columns to the vector the model reads."""
    sparse = spec.formatting == "HashingTF_Encoding"
    stages: list[Transformer] = []
    inputs = columns
    if spec.scaling == "Bucketizer":
        vectors = {n for n, t in train.dtypes if t == "vector"}
        numbers = [n for n in columns if n not in vectors]
        buckets = scale.bucketizer(numbers)
        made = dict(zip(numbers, buckets.getOutputCols()))
        inputs = [made.get(n, n) for n in columns]
        stages.append(buckets)
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="error"))
    makers = {
        "Standered_scaler": lambda i, o: scale.standard_scaler(i, o, center=not sparse),
        "Robust_scaler": scale.robust_scaler,
        "Minmax_scaler": scale.min_max_scaler,
        "MinAbs_scaler": scale.max_abs_scaler,
    }
    if spec.scaling in makers:
        ready = PipelineModel(stages).transform(train)
        stages.append(makers[spec.scaling]("features", "scaled").fit(ready))
    if spec.selection:
        indices = select.selected_indices(train, columns, spec.label)
        stages.append(select.slicer(indices, _last(stages), "selectedFeatures"))
    return stages


def _last(stages: list[Transformer]) -> str:
    return stages[-1].getOutputCol()


def run_pipeline(df: DataFrame, spec: PipelineSpec = PipelineSpec()) -> PipelineRun:
    """Label, clean, split, fit every stage on the training rows, score all rows.

    A text label is numbered by falling frequency. Rows without label or key keep that null:
    they are scored, but neither trained on nor evaluated. Outliers leave the training
    rows only.

    The labelled table is staged before the cleaning looks at it, and the cleaned one once
    more: fitting reads it many times, and a lost executor then re-reads files instead of
    repeating the rule's shuffles.
    """
    if spec.rule is not None:
        df = stage(consecutive_failures(df, spec.rule), "labelled")
    df = clean_data(df, spec)
    if spec.key not in df.columns:
        # Equal rows share a key, so they fall on the same side of the split.
        df = df.withColumn(spec.key, F.xxhash64(*map(c, df.columns)))
    table = stage(df, "cleaned")
    if spec.label in string_columns(table):
        missing = c(spec.label).isNull()
        coded = encode.label_encode(table.withColumn("_missing", missing), [spec.label])
        known = F.when(~F.col("_missing"), c(spec.label)).alias(spec.label)
        table = coded.select(*[known if n == spec.label else c(n) for n in table.columns])
    judged = table.filter(c(spec.label).isNotNull() & c(spec.key).isNotNull())
    train, test = train_test_split(judged, spec.key)
    if "Remove_outliers" in spec.cleaning:
        train = clean.drop_outliers(train, exclude=(spec.key, spec.label), keep_nulls=True)
    if "Balance_data" in spec.cleaning:
        train = balance(train, spec.label, spec.key, spec.balance_ratio)

    fitted = FittedPipeline(spec, PipelineModel([]))
    if spec.formatting == "Lebel_encoding":
        fitted.encoder = encode.LabelEncoder.fit(encode.time_parts(train))
    ready = stage(fitted.features(train), "training", even=True)
    columns = encode.feature_columns(ready, (spec.key, spec.label))
    stages = _feature_stages(ready, spec, columns)
    estimator = ESTIMATORS[spec.model](spec.label, _last(stages))
    fitted.stages = Pipeline(stages=[*stages, estimator]).fit(ready)
    return PipelineRun(fitted, fitted.transform(table), fitted.transform(test))
