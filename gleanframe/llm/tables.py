"""Reading, keeping and filtering tables for the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanframe.session import shared_folder

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# Bits of a key filter: 4 MB, however many keys there are.
FILTER_BITS = 1 << 25
# Rows with about so many bytes of text are worked on at a time.
SLICE_BYTES = 4 << 20
# Spark's option to remove a query's shuffle files when it ends.
REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Folders written inside of :func:`settled`.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(frame: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write a frame to the shared folder and read it again, which cuts its lineage."""
    spark = frame.sparkSession
    path = shared_folder(spark)
    if (written := _written.get()) is not None:
        written.append(path)
    before = spark.conf.get(REMOVE_SHUFFLES, "false")
    spark.conf.set(REMOVE_SHUFFLES, "true")
    try:
        frame.write.parquet(path, compression=codec)
    finally:
        spark.conf.set(REMOVE_SHUFFLES, before)
    return spark.read.schema(frame.schema).parquet(path)


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """Keep the frame that ``make`` returns and delete all tables kept on the way to it.

    Of what ``make`` builds only that frame may be read afterwards.
    """
    mark = _written.set([])
    try:
        frame = make()
        inner = _written.get()
    finally:
        _written.reset(mark)
    result = kept(frame)
    spark = frame.sparkSession
    for path in inner:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return result


def cut(batch: pa.RecordBatch, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with about ``size`` bytes in their longest columns; a longer row stands alone.

    Work arrays then follow ``size`` and the longest text, not the rows of a batch.
    """
    strings = [c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_large_string(c.type)]
    if not strings or not batch.num_rows:
        yield batch
        return
    upto = np.zeros(batch.num_rows + 1, np.int64)
    for column in strings:
        upto[1:] += np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy())
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + size, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def map_batches(
    frame: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str
) -> DataFrame:
    """Apply a function to the rows of a frame, in slices of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch):
                if part.num_rows:
                    yield function(part)

    return frame.mapInArrow(run, schema)


def key_filter(keys: Column, frame: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of the keys (bigint) of a frame, of a fixed size whatever the frame holds.

    :func:`maybe` answers true for every key of the frame and for some others, so whatever
    it lets through still meets an exact join.  The driver gets ``bits / 64`` rows at most.
    """
    place = F.pmod(keys, F.lit(bits))
    cells = frame.select((place / 64).cast("int").alias("cell"), (place % 64).cast("int").alias("bit"))
    words = cells.groupBy("cell").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("word"))
    got = words.toArrow()
    bitmap = np.zeros(bits // 64, dtype=np.int64)
    bitmap[got["cell"].to_numpy()] = got["word"].to_numpy()
    return bitmap


def maybe(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key (int64) may be one of the filter's keys."""
    place = keys & (len(bitmap) * 64 - 1)
    return (bitmap[place >> 6] >> (place & 63)) & 1 != 0
