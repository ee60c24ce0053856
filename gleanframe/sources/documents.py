"""Documents from tables and folders: routing, strict text reading, status.

A documents frame is ``(file, content, status)`` with one row per document.  Only rows
whose status is ``ok`` are cut into chunks.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanframe.functions.text import base_name, normalize_newlines
from gleanframe.session import spread

# Extensions read as text, and those handed to a converter.
TEXT_EXTENSIONS = (".md", ".txt")
CONVERTIBLE_EXTENSIONS = (".pdf", ".docx", ".pptx")


def from_table(table: DataFrame, file: Column, content: Column) -> DataFrame:
    """Use a table with one large text column as the document source."""
    return with_status(table.select(file.alias("file"), content.alias("content")))


def with_status(documents: DataFrame) -> DataFrame:
    status = (
        F.when(F.col("content").isNull(), "missing")
        .when(F.col("content") == "", "empty")
        .otherwise("ok")
    )
    return documents.withColumn("status", status)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``documents`` table as a documents frame."""
    table = spread(
        spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "doc_id", "text"), "doc_id"
    )
    file = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    return from_table(table, file, F.col("text"))


def extension(path: Column) -> Column:
    """Last extension, lower-cased; a name made of leading dots and a stem has none."""
    name = F.regexp_replace(base_name(path), r"\A\.+", "")
    return F.lower(F.regexp_extract(name, r"(\.[^.]*)\z", 1))


def route(path: Column) -> Column:
    """How a file is handled by its extension: text, convertible or unsupported."""
    ext = extension(path)
    return (
        F.when(ext.isin(*TEXT_EXTENSIONS), "text")
        .when(ext.isin(*CONVERTIBLE_EXTENSIONS), "convertible")
        .otherwise("unsupported")
    )


def decode_strict(data: Column) -> Column:
    """UTF-8 text with universal newlines, NULL where the bytes are not valid UTF-8."""
    text = data.cast("string")
    return F.when(F.is_valid_utf8(text), normalize_newlines(text))


def scan_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Regular files directly in ``folder`` as ``(file, data)``.

    Spark leaves out zero-length files and names starting with ``.`` or ``_``.
    """
    return spark.read.format("binaryFile").load(folder).transform(as_files)


def scan_extensions(spark: SparkSession, folder: str, extensions: Iterable[str]) -> DataFrame:
    """As :func:`scan_folder`, reading only files with these extensions, in any case."""

    def any_case(ext: str) -> str:
        return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext)

    pattern = "*{" + ",".join(map(any_case, extensions)) + "}"
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    return as_files(reader.load(folder))


def as_files(binary_files: DataFrame) -> DataFrame:
    return binary_files.select(F.col("path").alias("file"), F.col("content").alias("data"))


def read_text(files: DataFrame) -> DataFrame:
    """Text documents of a file frame; others keep their routing as status.

    ``convertible`` rows go through :func:`gleanframe.sources.convert.convert_files`.
    """
    kind = route(F.col("file"))
    text = F.when(kind == "text", decode_strict(F.col("data")))
    staged = files.select("file", text.alias("content"), kind.alias("kind"))
    status = (
        F.when(F.col("kind") != "text", F.col("kind"))
        .when(F.col("content").isNull(), "undecodable")
        .when(F.col("content") == "", "empty")
        .otherwise("ok")
    )
    return staged.select("file", "content", status.alias("status"))


def status_report(documents: DataFrame) -> DataFrame:
    return documents.groupBy("status").agg(F.count("*").alias("files"))
