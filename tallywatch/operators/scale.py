"""Scalers of the ``features`` vector and bucketing of numeric columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.base import Estimator, Transformer
from pyspark.ml.feature import (
    Bucketizer,
    ElementwiseProduct,
    MaxAbsScaler,
    MinMaxScaler,
    Normalizer,
    RobustScaler,
    StandardScaler,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame

from tallywatch.functions.columns import c, quantitative_columns
from tallywatch.operators.quantiles import exact_quantiles

# The bucket bounds.
SPLITS = (-float("inf"), -0.5, 0.0, 0.5, float("inf"))


def bucketizer(columns: Sequence[str], splits: Sequence[float] = SPLITS) -> Bucketizer:
    return Bucketizer(
        inputCols=list(columns),
        outputCols=[f"_{i}_bucket" for i in range(len(columns))],
        splitsArray=[list(splits)] * len(columns),
        handleInvalid="keep",
    )


def bucketize(
    df: DataFrame, columns: Sequence[str] | None = None, splits: Sequence[float] = SPLITS
) -> DataFrame:
    """Numeric columns become the number of their bucket; null stays null, NaN is last."""
    names = df.columns
    columns = list(columns) if columns is not None else quantitative_columns(df, ("id", "label"))
    stage = bucketizer(columns, splits)
    made = dict(zip(columns, stage.getOutputCols()))
    known = stage.transform(df)
    return known.select(
        *[c(made[n]).alias(n) if n in made else c(n) for n in names]
    )


def _apply(df: DataFrame, stage: Estimator | Transformer, column: str) -> DataFrame:
    fitted = stage.fit(df) if isinstance(stage, Estimator) else stage
    names = df.columns
    out = fitted.getOutputCol()
    return fitted.transform(df).select(
        *[c(out).alias(n) if n == column else c(n) for n in names]
    )


def l1_normalizer(column: str, output: str) -> Normalizer:
    return Normalizer(p=1.0, inputCol=column, outputCol=output)


def max_abs_scaler(column: str, output: str) -> MaxAbsScaler:
    return MaxAbsScaler(inputCol=column, outputCol=output)


def min_max_scaler(column: str, output: str) -> MinMaxScaler:
    return MinMaxScaler(inputCol=column, outputCol=output)


def standard_scaler(column: str, output: str, center: bool = True) -> StandardScaler:
    """``center=False`` keeps sparse vectors sparse."""
    return StandardScaler(inputCol=column, outputCol=output, withStd=True, withMean=center)


def robust_scaler(column: str, output: str) -> RobustScaler:
    return RobustScaler(inputCol=column, outputCol=output)


def l1_normalize(df: DataFrame, column: str = "features") -> DataFrame:
    return _apply(df, l1_normalizer(column, "_scaled"), column)


def max_abs_scale(df: DataFrame, column: str = "features") -> DataFrame:
    return _apply(df, max_abs_scaler(column, "_scaled"), column)


def min_max_scale(df: DataFrame, column: str = "features") -> DataFrame:
    return _apply(df, min_max_scaler(column, "_scaled"), column)


def standard_scale(df: DataFrame, column: str = "features", center: bool = True) -> DataFrame:
    return _apply(df, standard_scaler(column, "_scaled", center), column)


def robust_scale(
    df: DataFrame, column: str = "features", exact_from: Sequence[str] | None = None
) -> DataFrame:
    """Divide by the quartile range; a range of 0 gives 0.

    The quartiles are approximate (rank error 0.001) unless ``exact_from``
    names the columns the vector was assembled from.
    """
    if exact_from is None:
        return _apply(df, robust_scaler(column, "_scaled"), column)
    bounds = exact_quantiles(df, exact_from, [0.25, 0.75])
    ranges = [float(bounds[n][1]) - float(bounds[n][0]) for n in exact_from]
    weights = Vectors.dense([1 / r if r else 0.0 for r in ranges])
    product = ElementwiseProduct(scalingVec=weights, inputCol=column, outputCol="_scaled")
    return _apply(df, product, column)
