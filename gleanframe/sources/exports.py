"""Exports of other tools, read for comparison with our own results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanframe.functions.text import file_stem


def read_export(
    spark: SparkSession, path: str, columns: list[str], multi_line: bool = False
) -> DataFrame:
    """A quoted CSV export with a header, every column as text, empty fields NULL.

    ``stem`` is the first column's document name without folder and extension.  Set
    ``multi_line`` only for files with line breaks inside fields: such a file is read by
    one task, while others are split.
    """
    schema = ", ".join(f"`{c}` string" for c in columns)
    raw = spark.read.csv(
        path, schema=schema, header=True, quote='"', escape='"', multiLine=multi_line
    )
    cleaned = [F.nullif(unquote(F.col(f"`{c}`")), F.lit("")).alias(c) for c in columns]
    return raw.select(*cleaned).withColumn("stem", file_stem(F.col(f"`{columns[0]}`")))


def unquote(field: Column) -> Column:
    """Remove the outer quotes of a field that holds unescaped inner quotes.

    The CSV reader returns such a field as written, with its delimiting quotes.
    """
    inner = F.regexp_extract(field, r'(?s)\A"(.*".*)"\z', 1)
    return F.when(inner != "", inner).otherwise(field)
