"""Text and CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CSV = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true"}


def read_csv_column(spark: SparkSession, path: str, column: str) -> DataFrame:
    """One column of CSV files with a header; quoted commas and line breaks are data.

    Quoted line breaks keep Spark from splitting a file, so give it many files.
    """
    return spark.read.options(**CSV).csv(path).select(column)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines, headers and quotes included."""
    return spark.read.text(path)


def append_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("append").options(quote='"', escape='"').csv(path)


def csv_field(line: Column, schema: str, name: str) -> Column:
    """A named field of a CSV record held in a column."""
    return F.from_csv(line, schema, {"quote": '"', "escape": '"', "multiLine": "true"})[name]
