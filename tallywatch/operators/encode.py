"""Strings to numbers and columns to a feature vector."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallywatch.functions.columns import (
    QUANTITATIVE,
    c,
    string_columns,
    time_columns,
)
from tallywatch.functions.text import tokens
from tallywatch.operators.ordered import ranked
from tallywatch.session import stage

#: A value with at least one in so many rows is frequent: so many can be, at the most.
FREQUENT = 10_000


def _digest(value: Column) -> Column:
    """16 bytes that stand for a text of any length in a join."""
    return F.unhex(F.md5(value))


@dataclass
class LabelEncoder:
    """String values numbered by falling frequency, ties in alphabetical order.

    ``table`` holds ``column, value, index, frequent``; ``sizes`` per column the number of
    distinct values and of the frequent ones. Nulls and unseen values get the number
    after the last.
    """

    table: DataFrame
    sizes: dict[str, tuple[int, int]]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str] | None = None) -> LabelEncoder:
        """Count all columns in one pass; values never come to the driver."""
        columns = list(columns) if columns is not None else string_columns(df)
        pairs = F.array(
            *[F.struct(F.lit(n).alias("column"), c(n).alias("value")) for n in columns]
        )
        counts = (
            df.select(F.inline(pairs))
            .filter(F.col("value").isNotNull())
            .groupBy("column", "value")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        counts = stage(counts, "label-counts")
        rows = {r[0]: r[1] for r in counts.groupBy("column").agg(F.sum("n")).collect()}
        least = F.lit(1)
        for name, n in rows.items():
            least = F.when(F.col("column") == name, F.lit(n / FREQUENT)).otherwise(least)
        counts = counts.withColumn("frequent", F.col("n") >= least)
        measured = counts.groupBy("column").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("frequent")).alias("frequent")
        )
        sizes = {n: (0, 0) for n in columns}
        sizes.update({r["column"]: (r["n"], r["frequent"]) for r in measured.collect()})
        start, shift = 0, F.lit(0)
        for name in sorted(sizes):
            shift = F.when(F.col("column") == name, start).otherwise(shift)
            start += sizes[name][0]
        order = [F.col("column"), F.desc("n"), F.col("value")]
        index = (F.col("_all") - shift).cast("double").alias("index")
        table = ranked(counts, order, "_all").select("column", "value", index, "frequent")
        return cls(stage(table, "label-index"), sizes)

    def transform(self, df: DataFrame) -> DataFrame:
        """Replace each fitted column that ``df`` has by its index.

        Frequent values are looked up in a broadcast: at most ``FREQUENT`` digests of 16
        bytes, however long the values are. If there are others, the rows are staged once; the
        cells left open, of all columns together, meet the rest of the table in one shuffle
        join and go back to their rows. None of those values was frequent, so that join does
        not skew, and ``df`` is read once, however many columns there are.
        """
        names = [n for n in self.sizes if n in df.columns]
        found = {n: f"_index_{i}" for i, n in enumerate(names)}
        coded = df
        for name in names:
            head = self._head(name).withColumnRenamed("_index", found[name])
            same = _digest(c(name)) == F.col("_value")
            coded = coded.join(F.broadcast(head), same, "left").drop("_value")

        def result(rows: DataFrame) -> DataFrame:
            """Nulls and values without an index come after the last one."""
            last = {n: F.coalesce(c(i), F.lit(float(self.sizes[n][0]))) for n, i in found.items()}
            return rows.select(*[last[n].alias(n) if n in last else c(n) for n in df.columns])

        tails = [n for n in names if self.sizes[n][0] > self.sizes[n][1]]
        if not tails:
            return result(coded)
        rows = stage(coded.withColumn("_row", F.monotonically_increasing_id()), "label-rows")
        still = {n: c(found[n]).isNull() & c(n).isNotNull() for n in tails}
        cells = F.array_compact(
            F.array(
                *[
                    F.when(still[n], F.struct(F.lit(n).alias("_column"), _digest(c(n)).alias("_digest")))
                    for n in tails
                ]
            )
        )
        rest = self.table.filter("not frequent").select(
            F.col("column").alias("_of"), _digest(F.col("value")).alias("_value"), F.col("index").alias("_tail")
        )
        same = (F.col("_column") == F.col("_of")) & (F.col("_digest") == F.col("_value"))
        met = rows.select(F.col("_row").alias("_cell"), F.inline(cells)).join(rest, same)
        # A row has one cell per column at most.
        settled = met.groupBy("_cell").agg(
            *[F.max(F.when(F.col("_column") == n, F.col("_tail"))).alias("_tail" + found[n]) for n in tails]
        )
        is_open = F.size(cells) > 0
        filled = (
            rows.filter(is_open)
            .join(settled, F.col("_row") == F.col("_cell"), "left")
            .withColumns({found[n]: F.coalesce(c(found[n]), c("_tail" + found[n])) for n in tails})
        )
        return result(rows.filter(~is_open)).unionByName(result(filled))

    def _head(self, name: str) -> DataFrame:
        """``_value``, a digest, and ``_index`` of the column's frequent values."""
        return self.table.filter((F.col("column") == name) & F.col("frequent")).select(
            _digest(F.col("value")).alias("_value"), F.col("index").alias("_index")
        )

    def save(self, path: str) -> None:
        self.table.write.mode("overwrite").parquet(path + "/table")
        sizes = self.table.sparkSession.createDataFrame(
            [(name, *size) for name, size in self.sizes.items()],
            "column string, size bigint, frequent bigint",
        )
        sizes.coalesce(1).write.mode("overwrite").parquet(path + "/sizes")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LabelEncoder:
        sizes = spark.read.parquet(path + "/sizes").collect()
        return cls(spark.read.parquet(path + "/table"), {r[0]: (r[1], r[2]) for r in sizes})


def label_encode(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return LabelEncoder.fit(df, columns).transform(df)


def hash_encode(df: DataFrame, exclude: Sequence[str] = ("class",)) -> DataFrame:
    """Every string column becomes its 32-bit Murmur3 hash."""
    hashed = set(string_columns(df, exclude))
    return df.select(*[F.hash(c(n)).alias(n) if n in hashed else c(n) for n in df.columns])


def tokenize(df: DataFrame, column: str, output: str) -> DataFrame:
    return df.withColumn(output, tokens(c(column)))


def hashing_tf(
    df: DataFrame, columns: Sequence[str] | None = None, num_features: int = 1 << 18
) -> DataFrame:
    """Every string column becomes a sparse vector of word counts by hash slot."""
    names = df.columns
    for name in list(columns) if columns is not None else string_columns(df):
        words = df.withColumn("_words", tokens(c(name)))
        counted = HashingTF(numFeatures=num_features, inputCol="_words", outputCol="_counts")
        df = counted.transform(words).drop("_words", name).withColumnRenamed("_counts", name)
    return df.select(*[c(n) for n in names])


def time_parts(df: DataFrame) -> DataFrame:
    """Dates and times as numbers: hour and day of week."""
    times = set(time_columns(df))
    parts = []
    for name in df.columns:
        if name in times:
            parts.append(F.hour(c(name).cast("timestamp")).alias(name + "_hour"))
            parts.append(F.dayofweek(c(name)).alias(name + "_dow"))
        else:
            parts.append(c(name))
    return df.select(*parts)


def feature_columns(df: DataFrame, exclude: Sequence[str] = ("id", "label")) -> list[str]:
    """Columns that can be part of a vector: numbers and vectors, no key, no label."""
    left_out = {n.lower() for n in exclude}
    return [
        f.name
        for f in df.schema.fields
        if f.name.lower() not in left_out
        and (f.dataType.simpleString() in (*QUANTITATIVE, "vector", "smallint", "tinyint", "boolean"))
    ]


def assembler(
    df: DataFrame, exclude: Sequence[str] = ("id", "label"), invalid: str = "error"
) -> VectorAssembler:
    return VectorAssembler(
        inputCols=feature_columns(df, exclude), outputCol="features", handleInvalid=invalid
    )


def assemble(
    df: DataFrame, exclude: Sequence[str] = ("id", "label"), invalid: str = "error"
) -> DataFrame:
    """Add ``features``: all usable columns but the excluded ones, in column order."""
    return assembler(df, exclude, invalid).transform(df)
