"""CSV, parquet, catalog and JDBC tables."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from tallywatch.functions.columns import c


#: Quotes are doubled, blanks kept; null is nothing, the empty text a pair of quotes.
QUOTING = {
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "emptyValue": "",
    "nullValue": None,
    "lineSep": "\n",
}
#: Rows of one file, which one task reads back.
FILE_ROWS = 1_000_000


def scan_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """CSV with a header, as ``write_csv`` and other quoting writers make it.

    Texts come back as they were: line breaks, quotes, backslashes and outer blanks
    included. An unquoted empty field is null, a quoted one the empty text. Without a schema
    the types are inferred, at the cost of reading the files twice. A file is read by one task, as
    quoted line breaks forbid splitting it.
    """
    reader = spark.read.options(header=True, **QUOTING, multiLine=True)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(schema).csv(path)


def read_data(
    spark: SparkSession, train: str, test: str, schema: StructType | str | None = None
) -> tuple[DataFrame, DataFrame]:
    return scan_csv(spark, train, schema), scan_csv(spark, test, schema)


def scan_table(spark: SparkSession, table: str) -> DataFrame:
    """A parquet path or a catalog table; filters and columns reach the scan."""
    if "/" in table:
        return spark.read.parquet(table)
    return spark.table(table)


def scan_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    column: str,
    lower: int,
    upper: int,
    partitions: int,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """A database table read in parallel slices of ``column``."""
    return spark.read.jdbc(
        url,
        table,
        column=column,
        lowerBound=lower,
        upperBound=upper,
        numPartitions=partitions,
        properties=properties or {},
    )


def as_text(df: DataFrame) -> DataFrame:
    """Vectors, arrays, maps and structs as JSON, which CSV can hold."""
    fields = []
    for f in df.schema.fields:
        if isinstance(f.dataType, VectorUDT):
            fields.append(F.to_json(vector_to_array(c(f.name))).alias(f.name))
        elif isinstance(f.dataType, (ArrayType, MapType, StructType)):
            fields.append(F.to_json(c(f.name)).alias(f.name))
        else:
            fields.append(c(f.name))
    return df.select(*fields)


def write_csv(df: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """CSV files of at most ``file_rows`` rows, written by the executors; every text is quoted."""
    options = {**QUOTING, "emptyValue": '""', "quoteAll": False, "escapeQuotes": True}
    writer = as_text(df).write.mode("overwrite").options(header=True, **options)
    writer.option("maxRecordsPerFile", file_rows).csv(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
