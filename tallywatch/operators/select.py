"""Chi-square feature selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer, UnivariateFeatureSelector, VectorAssembler, VectorSlicer
from pyspark.sql import DataFrame, Window, functions as F

from tallywatch.functions.columns import c
from tallywatch.operators.quantiles import approx_quantiles

# Fixed value: how many features are kept.
TOP = 5


def chi_square_table(df: DataFrame, columns: Sequence[str], label: str = "label") -> DataFrame:
    """``feature, statistic, dof`` of each column against the label.

    Rows are counted per (feature, value, label) before anything is shuffled;
    everything after works on those counts. Empty cells enter through
    ``sum(observed^2 / expected) - n``, which needs only the filled ones.
    """
    pairs = F.array(
        *[
            F.struct(F.lit(n).alias("feature"), c(n).cast("double").alias("value"))
            for n in columns
        ]
    )
    cells = (
        df.select(c(label).cast("double").alias("label"), F.inline(pairs))
        .filter("label is not null and value is not null")
        .groupBy("feature", "value", "label")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    per_value = Window.partitionBy("feature", "value")
    first = F.row_number().over(per_value.orderBy("label")) == 1
    cells = cells.withColumn("n_value", F.sum("n").over(per_value)).withColumn("first", first)
    # A label's total divides what all its cells add up to, so no cell needs to be joined to it.
    part = F.col("n") * F.col("n") / F.col("n_value").cast("double")
    by_label = cells.groupBy("feature", "label").agg(
        F.sum(part).alias("part"),
        F.sum("n").alias("n_label"),
        F.count_if(F.col("first")).alias("values"),
    )
    return (
        by_label.groupBy("feature")
        .agg(
            F.sum(F.col("part") / F.col("n_label")).alias("_parts"),
            F.sum("n_label").alias("_total"),
            F.count(F.lit(1)).alias("_labels"),
            F.sum("values").alias("_values"),
        )
        .select(
            "feature",
            ((F.col("_parts") - 1) * F.col("_total")).alias("statistic"),
            ((F.col("_values") - 1) * (F.col("_labels") - 1)).alias("dof"),
        )
    )


def discretizer(df: DataFrame, columns: Sequence[str], bins: int = 32) -> Bucketizer:
    """Equal-frequency bins from one quantile pass over all columns."""
    grid = [i / bins for i in range(1, bins)]
    found = approx_quantiles(df, columns, grid, 0.001)
    inf = float("inf")
    splits = []
    for name in columns:
        inner = sorted({float(v) for v in found.get(name, [])} - {inf, -inf}) or [0.0]
        splits.append([-inf, *inner, inf])
    return Bucketizer(
        inputCols=list(columns),
        outputCols=[f"_bin_{i}" for i in range(len(columns))],
        splitsArray=splits,
        handleInvalid="keep",
    )


def chi_square_selector(
    features: str = "features", label: str = "label", top: int = TOP, output: str = "selectedFeatures"
) -> UnivariateFeatureSelector:
    selector = UnivariateFeatureSelector(
        featuresCol=features, labelCol=label, outputCol=output, selectionMode="numTopFeatures"
    )
    return (
        selector.setFeatureType("categorical").setLabelType("categorical").setSelectionThreshold(top)
    )


def selected_indices(
    df: DataFrame, columns: Sequence[str], label: str = "label", top: int = TOP, bins: int = 32
) -> list[int]:
    """Positions, in a vector of ``columns``, of the ``top`` that depend most on the label.

    The test needs categories: numbers are binned, vector columns enter as they are. A
    missing number is a category of its own, so every row counts.
    """
    vectors = {n for n, t in df.dtypes if t == "vector"}
    numbers = [n for n in columns if n not in vectors]
    inputs = {n: n for n in columns}
    if numbers:
        missing = F.lit(float("nan"))
        df = df.withColumns({n: F.coalesce(c(n).cast("double"), missing) for n in numbers})
        bin_stage = discretizer(df, numbers, bins)
        df = bin_stage.transform(df)
        inputs.update(zip(numbers, bin_stage.getOutputCols()))
    binned = VectorAssembler(
        inputCols=[inputs[n] for n in columns], outputCol="_binned", handleInvalid="error"
    ).transform(df)
    model = chi_square_selector("_binned", label, top, "_kept").fit(binned)
    return sorted(model.selectedFeatures)


def slicer(
    indices: Sequence[int], features: str = "features", output: str = "selectedFeatures"
) -> VectorSlicer:
    return VectorSlicer(inputCol=features, outputCol=output, indices=list(indices))


def chi_square_select(
    df: DataFrame, label: str = "label", top: int = TOP, features: str = "features"
) -> DataFrame:
    """Add ``selectedFeatures``: the ``top`` categorical features by chi-square test."""
    return chi_square_selector(features, label, top).fit(df).transform(df)
