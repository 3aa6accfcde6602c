"""Columns of JSON texts: which paths they have, of which types, and values at chosen paths.

A text is parsed once into a VARIANT. A text that is no JSON counts as malformed and has no
values; a null text is missing; neither is an error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tallywatch.functions.columns import c
from tallywatch.session import stage

_CONTAINERS = ("OBJECT", "ARRAY")


def parsed(text: Column) -> Column:
    """The text as a VARIANT; null if it is none."""
    return F.try_parse_json(text)


def kind_of(value: Column) -> Column:
    """The type's name without its parts: numbers, texts, objects."""
    said = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    return (
        F.when(said.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "NUMBER")
        .when(said == "VOID", "NULL")
        .otherwise(said)
    )


def json_profile(df: DataFrame, column: str) -> DataFrame:
    """``path``, ``type``, ``values``: how many values of which type lie at each path.

    The root is ``$``, members are ``$.name``, the entries of an array share ``$.name[]``.
    Missing and malformed texts are the types ``MISSING`` and ``MALFORMED`` of the root.

    Each level of nesting is one pass over the containers of the level above, which are staged;
    only counts per path are shuffled. Levels end where the data does.
    """
    texts = df.select(c(column).alias("_text"), parsed(c(column)).alias("value"))
    root = stage(
        texts.select(
            F.lit("$").alias("path"),
            F.when(F.col("_text").isNull(), "MISSING")
            .when(F.col("value").isNull(), "MALFORMED")
            .otherwise(kind_of(F.col("value")))
            .alias("type"),
            "value",
        ),
        "json-level",
    )
    counts = []
    level = root
    while True:
        counts.append(level.groupBy("path", "type").agg(F.count(F.lit(1)).alias("values")))
        inner = level.filter(F.col("type").isin(*_CONTAINERS))
        if inner.isEmpty():
            break
        inner.createOrReplaceTempView("_json_level")
        parts = df.sparkSession.sql(
            "SELECT path, p.key, p.value FROM _json_level, LATERAL variant_explode(_json_level.value) AS p"
        )
        step = F.when(F.col("key").isNull(), "[]").otherwise(F.concat(F.lit("."), F.col("key")))
        level = stage(
            parts.select(
                F.concat("path", step).alias("path"), kind_of(F.col("value")).alias("type"), "value"
            ),
            "json-level",
        )
    df.sparkSession.catalog.dropTempView("_json_level")
    return reduce(DataFrame.unionByName, counts)


def json_values(df: DataFrame, column: str, paths: dict[str, tuple[str, str]]) -> DataFrame:
    """``df`` with values at paths: ``paths`` maps a new column to a path and a type.

    A path that is missing, or a value that cannot be read as the type, gives null. The text is
    parsed once for all paths.
    """
    with_value = df.withColumn("_variant", parsed(c(column)))
    found = {n: F.try_variant_get("_variant", path, kind) for n, (path, kind) in paths.items()}
    return with_value.withColumns(found).drop("_variant")
