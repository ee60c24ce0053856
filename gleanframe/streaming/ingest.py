"""Pick up new documents while they arrive.

A stream of documents is cut and registered batch by batch.  The source remembers what it
has delivered, so a file is read once; registering is insert-if-absent, so a batch that is
repeated after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleanframe.operators.store import Store
from gleanframe.sources.convert import Converter, convert_files
from gleanframe.sources.documents import as_files, read_text, route

# The columns of Spark's binary file source.
BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
# A micro-batch reads at most this many files, which bounds what registering broadcasts.
MAX_FILES_PER_BATCH = 10_000


def folder_stream(
    spark: SparkSession,
    folder: str,
    max_files: int = MAX_FILES_PER_BATCH,
    converters: Mapping[str, Converter] | None = None,
) -> DataFrame:
    """Documents of a folder as a stream; only files not seen before are delivered.

    Convertible files go through the converters; without one they keep a status that says so.
    """
    files = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE_SCHEMA)
        .option("maxFilesPerTrigger", max_files)
        .load(folder)
    )
    files = as_files(files)
    kind = route(F.col("file"))
    converted = convert_files(files.where(kind == "convertible"), converters or {}).drop("error")
    return read_text(files.where(kind != "convertible")).unionByName(converted)


def ingest(
    documents: DataFrame,
    store: Store,
    checkpoint: str,
    size: int | None = None,
    one_row_per_file: bool = False,
    interval: str | None = None,
) -> StreamingQuery:
    """Register the chunks of streamed documents; stops when the input is used up.

    Give ``interval`` to keep polling instead.  Say ``one_row_per_file`` of a
    :func:`folder_stream`, whose batches are bounded by their file count.
    """
    register = store.register_batch if one_row_per_file else store.register_chunks

    def write(batch: DataFrame, _: int) -> None:
        register(batch, size)

    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return (
        documents.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )
