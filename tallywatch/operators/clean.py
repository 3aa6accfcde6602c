"""Names, empty columns, nulls and outliers."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from tallywatch.functions.columns import c, quantitative_columns, string_columns, unpivot
from tallywatch.operators.quantiles import approx_quantiles
from tallywatch.session import stage

def normalize_names(df: DataFrame) -> DataFrame:
    """Dots in column names become underscores; clashing names are an error."""
    names = [n.replace(".", "_") for n in df.columns]
    clashes = [n for n, k in Counter(x.lower() for x in names).items() if k > 1]
    if clashes:
        raise ValueError(f"column names clash after renaming: {clashes}")
    return df.toDF(*names)


def empty_columns(df: DataFrame) -> list[str]:
    """Columns that hold only nulls and empty strings.

    All columns in one aggregate. A table without rows has no empty columns.
    """
    strings = set(string_columns(df))

    def filled(name: str):
        present = c(name).isNotNull()
        return present & (c(name) != "") if name in strings else present

    found = [F.max(filled(n)).alias(str(i)) for i, n in enumerate(df.columns)]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *found).first()
    return [n for i, n in enumerate(df.columns) if row["rows"] and not row[str(i)]]


def drop_empty_columns(df: DataFrame) -> DataFrame:
    dropped = set(empty_columns(df))
    return df.select(*[c(n) for n in df.columns if n not in dropped])


def null_profile(df: DataFrame) -> DataFrame:
    """``column, nulls, has_nulls`` for every column, from one aggregate."""
    counts = df.agg(*[F.count_if(c(n).isNull()).alias(f"{i}_n") for i, n in enumerate(df.columns)])
    return unpivot(counts, df.columns, {"nulls": "_n"}).withColumn("has_nulls", F.col("nulls") > 0)


def fill_nulls(
    df: DataFrame,
    numeric: float = 0,
    strings: Mapping[str, str] | str | None = None,
    threshold: int | None = None,
    exclude: Sequence[str] = (),
) -> DataFrame:
    """Numeric nulls (and NaN) become ``numeric``; strings only when asked for.

    With ``threshold``, only columns with more nulls than that are filled; ``exclude``
    names columns that stay as they are.
    """
    numbers, texts = quantitative_columns(df, exclude), string_columns(df, exclude)
    if threshold is not None:
        many = {r["column"] for r in null_profile(df).filter(F.col("nulls") > threshold).collect()}
        numbers = [n for n in numbers if n in many]
        texts = [n for n in texts if n in many]
    if isinstance(strings, str):
        strings = {n: strings for n in texts}
    values = {n: numeric for n in numbers}
    values.update({n: v for n, v in (strings or {}).items() if n in texts})
    if not values:
        return df
    nan_able = {n for n, t in df.dtypes if t in ("double", "float")}
    types = dict(df.dtypes)

    def filled(name: str):
        if name not in values:
            return c(name)
        base = F.when(~F.isnan(c(name)), c(name)) if name in nan_able else c(name)
        return F.coalesce(base, F.lit(values[name]).cast(types[name])).alias(name)

    return df.select(*map(filled, df.columns))


def _fence(df: DataFrame, bounds: dict[str, list], factor: float, keep_nulls: bool) -> DataFrame:
    keep = F.lit(True)
    for name, (q1, q3) in bounds.items():
        reach = factor * (float(q3) - float(q1))
        inside = c(name).between(float(q1) - reach, float(q3) + reach)
        keep &= (inside | c(name).isNull()) if keep_nulls else inside
    return df.filter(keep)


def drop_outliers(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    error: float = 0.05,
    factor: float = 2.0,
    exclude: Sequence[str] = ("id", "label"),
    keep_nulls: bool = False,
) -> DataFrame:
    """Keep rows within ``factor`` quartile ranges of the quartiles in every column.

    All bounds come from one pass over the input and make one filter.
    ``error=0`` asks for exact quartiles. Rows with a null go unless kept.
    """
    columns = list(columns) if columns is not None else quantitative_columns(df, exclude)
    return _fence(df, approx_quantiles(df, columns, [0.25, 0.75], error), factor, keep_nulls)


def drop_outliers_sequential(
    df: DataFrame,
    columns: Sequence[str],
    error: float = 0.05,
    factor: float = 2.0,
    keep_nulls: bool = False,
) -> DataFrame:
    """As ``drop_outliers``, each column's quartiles taken after the earlier filters.

    The rows left by a column are staged for the next one.
    """
    for i, name in enumerate(columns):
        if i:
            df = stage(df, "within-fences")
        df = _fence(df, approx_quantiles(df, [name], [0.25, 0.75], error), factor, keep_nulls)
    return df
