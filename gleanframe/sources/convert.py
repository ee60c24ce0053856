"""Convertible documents to text through a registry of per-document converters.

A converter is a plain callable ``bytes -> str | None``.  Spark partitions the work; a
converter that fails, or returns no text, leaves its document with a status and the
error instead of failing the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanframe.sources.documents import (
    CONVERTIBLE_EXTENSIONS,
    TEXT_EXTENSIONS,
    extension,
    read_text,
    route,
    scan_extensions,
    scan_folder,
)

Converter = Callable[[bytes], "str | None"]
DOCUMENT_SCHEMA = "file string, content string, status string, error string"

# Elements without text of their own, and those that end a paragraph.
SILENT = ("script", "style", "title", "nav", "footer")
BLOCKS = ("p", "div", "article", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "br", "tr")


class _TextCollector(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self.silent += 1
        elif tag in BLOCKS:
            self.parts.append("\n\n")

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag in BLOCKS:
            self.parts.append("\n\n")

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)


def html_to_text(data: bytes) -> str:
    """Visible text of a page, one paragraph per block element."""
    collector = _TextCollector()
    collector.feed(data.decode("utf-8"))
    collector.close()
    blocks = "".join(collector.parts).split("\n\n")
    return "\n\n".join(line for line in (" ".join(b.split()) for b in blocks) if line)


def folder_documents(
    spark: SparkSession, folder: str, converters: Mapping[str, Converter] | None = None
) -> DataFrame:
    """Every file of a folder as ``(file, content, status, error)``: read, converted or skipped.

    Each kind is scanned on its own, so no file's bytes are read twice and those of
    unsupported files are not read at all.
    """
    no_error = F.lit(None).cast("string").alias("error")
    text = read_text(scan_extensions(spark, folder, TEXT_EXTENSIONS)).select("*", no_error)
    convertible = scan_extensions(spark, folder, CONVERTIBLE_EXTENSIONS)
    skipped = (
        scan_folder(spark, folder)
        .select("file")
        .where(route(F.col("file")) == "unsupported")
        .select("file", no_error.alias("content"), F.lit("unsupported").alias("status"), no_error)
    )
    return text.unionByName(convert_files(convertible, converters or {})).unionByName(skipped)


def convert_files(files: DataFrame, converters: Mapping[str, Converter]) -> DataFrame:
    """Convert ``(file, data)`` rows by extension into ``(file, content, status, error)``."""
    registry = dict(converters)

    def convert_one(ext: str, data: bytes) -> tuple[str | None, str, str | None]:
        if ext not in registry:
            return None, "unsupported", None
        try:
            text = registry[ext](data)
        except Exception as error:  # one bad document must not end the job
            return None, "failed", f"{type(error).__name__}: {error}"
        if not isinstance(text, str) or not text:
            return None, "empty", None
        return text, "ok", None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [convert_one(e, bytes(d)) for e, d in zip(batch["ext"], batch["data"])]
            out = pd.DataFrame(rows, columns=["content", "status", "error"], dtype=object)
            out.insert(0, "file", batch["file"].to_numpy())
            yield out

    return files.select("file", extension(F.col("file")).alias("ext"), "data").mapInPandas(
        run, DOCUMENT_SCHEMA
    )
