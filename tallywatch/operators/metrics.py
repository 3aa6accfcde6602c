"""Evaluation of scored rows, each from one small aggregate."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from tallywatch.functions.columns import c
from tallywatch.operators.ordered import running_totals


def threshold_prediction(
    df: DataFrame, at: float = 0.8, column: str = "prediction"
) -> DataFrame:
    """``column`` becomes 1 from ``at`` on and 0 below; null gives 0."""
    hard = F.when(c(column) >= at, 1).otherwise(0)
    return df.withColumn(column, hard)


def regression_metrics(
    df: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """One row: ``rmse, mse, r2, var, mae``."""
    y, p = c(label).cast("double"), c(prediction).cast("double")
    error = y - p
    sums = df.agg(
        F.mean(error * error).alias("mse"),
        F.mean(F.abs(error)).alias("mae"),
        F.var_pop(y).alias("spread"),
        F.var_pop(p).alias("p_spread"),
        (F.mean(p) - F.mean(y)).alias("shift"),
    )
    return sums.select(
        F.sqrt("mse").alias("rmse"),
        "mse",
        (1 - F.col("mse") / F.col("spread")).alias("r2"),
        (F.col("p_spread") + F.col("shift") * F.col("shift")).alias("var"),
        "mae",
    )


def binary_metrics(df: DataFrame, label: str = "label", score: str = "prediction") -> DataFrame:
    """One row: exact ``areaUnderROC`` and ``areaUnderPR`` of a score.

    The score is a number, or a vector such as ``rawPrediction`` whose second entry is
    taken. Scored rows are evaluated once, equal scores merged before the shuffle; the
    cumulative counts come from ranges of scores, not from one globally sorted task.
    """
    if dict(df.dtypes)[score] == "vector":
        df = df.select(c(label), vector_to_array(c(score))[1].alias(score))
    hit = F.when(c(label) == 1, 1).otherwise(0).cast("bigint")
    curve = running_totals(
        df.filter(c(label).isNotNull() & c(score).isNotNull()),
        score,
        {"pos": hit, "neg": 1 - hit},
    )
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    tp, fp = F.col("cum_pos").cast("double"), F.col("cum_neg").cast("double")
    precision = tp / (tp + fp)
    earlier = (tp - pos) + (fp - neg)
    # The curve starts at recall 0 with the first point's precision.
    before = F.when(earlier > 0, (tp - pos) / F.nullif(earlier, F.lit(0.0))).otherwise(precision)
    sums = curve.agg(
        F.sum(neg * (tp - pos / 2)).alias("roc"),
        F.sum(pos * (precision + before) / 2).alias("pr"),
        F.sum(pos).alias("p"),
        F.sum(neg).alias("n"),
    )
    pairs = F.nullif(F.col("p") * F.col("n"), F.lit(0.0))
    return sums.select(
        (F.col("roc") / pairs).alias("areaUnderROC"),
        (F.col("pr") / F.nullif(F.col("p"), F.lit(0.0))).alias("areaUnderPR"),
    )


def class_metrics(
    df: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Per class ``support, tp, fp`` and the rates made from them.

    One count per (label, prediction) pair; the rest works on those pairs.
    """
    pairs = (
        df.groupBy(c(label).cast("double").alias("y"), c(prediction).cast("double").alias("p"))
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("y is not null and p is not null")
    )
    same = F.col("y") == F.col("p")
    none = F.lit(0).cast("bigint")
    roles = F.array(
        F.struct(
            F.col("y").alias("class"),
            F.col("n").alias("support"),
            F.when(same, F.col("n")).otherwise(none).alias("tp"),
            none.alias("fp"),
        ),
        F.struct(
            F.col("p").alias("class"),
            none.alias("support"),
            none.alias("tp"),
            F.when(same, none).otherwise(F.col("n")).alias("fp"),
        ),
    )
    counts = pairs.select(F.inline(roles)).groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp")
    )

    def ratio(part, whole):
        return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))

    precision = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = ratio(F.col("tp"), F.col("support"))
    both = F.col("precision") + F.col("recall")
    return counts.withColumns({"precision": precision, "recall": recall}).withColumn(
        "f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0)
    )


def multiclass_metrics(
    df: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    of_class: float = 0.0,
) -> DataFrame:
    """One row: weighted scores over all classes and the rates of ``of_class``."""
    per_class = class_metrics(df, label, prediction)
    total = F.sum("support")
    weighted = {
        "f1": F.sum(F.col("f1") * F.col("support")) / total,
        "weightedPrecision": F.sum(F.col("precision") * F.col("support")) / total,
        "weightedRecall": F.sum(F.col("recall") * F.col("support")) / total,
        "accuracy": F.sum("tp") / total,
    }
    this = F.col("class") == of_class
    own = F.sum(F.when(this, F.col("support")).otherwise(0))
    rates = {
        "falsePositiveRateByLabel": F.coalesce(
            F.sum(F.when(this, F.col("fp"))) / F.nullif(total - own, F.lit(0)), F.lit(0.0)
        ),
        "precisionByLabel": F.coalesce(F.max(F.when(this, F.col("precision"))), F.lit(0.0)),
        "recallByLabel": F.coalesce(F.max(F.when(this, F.col("recall"))), F.lit(0.0)),
    }
    return per_class.agg(*[e.alias(n) for n, e in {**weighted, **rates}.items()])
