"""The tables a project keeps: chunks, request log, results.

Plain Parquet under one shared folder.  Log and results are partitioned by run tag, run
and wave, and a wave is written by overwriting exactly its own partition, so repeating
a wave after a failure replaces it instead of doubling it.  One writer per store.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanframe.operators.attempts import as_results
from gleanframe.operators.chunks import CHUNK_KEY, chunk_documents, known_files
from gleanframe.operators.pending import run_summary
from gleanframe.spec import CHUNK_SCHEMA, LOG_SCHEMA, RUN_KEYS, ExtractionSpec


class Store:
    def __init__(self, spark: SparkSession, root: str, spec: ExtractionSpec) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self.spec = spec
        self._check_result_columns()

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _exists(self, table: str) -> bool:
        try:
            self.spark.read.schema("x int").parquet(self._path(table))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return False
        return True

    def _read(self, table: str, schema: T.StructType) -> DataFrame:
        if not self._exists(table):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._path(table))

    def _check_result_columns(self) -> None:
        """A store keeps the result columns it was made with; a changed spec needs a new one."""
        if not self._exists("results"):
            return
        try:
            stored = self.spark.read.parquet(self._path("results")).columns
        except AnalysisException:  # no result has been written yet
            return
        expected = self.spec.result_schema.fieldNames()
        if set(stored) != set(expected):
            raise ValueError(
                f"results in {self.root} have columns {stored}, the spec needs {expected}; "
                "use a new store for changed db_columns"
            )

    def has_chunks(self) -> bool:
        return self._exists("chunks")

    def chunks(self) -> DataFrame:
        return self._read("chunks", CHUNK_SCHEMA)

    def log(self) -> DataFrame:
        return self._read("log", LOG_SCHEMA)

    def results(self) -> DataFrame:
        return self._read("results", self.spec.result_schema)

    def register_chunks(self, documents: DataFrame, size: int | None = None) -> None:
        """Cut and append the chunks of documents the store does not know yet.

        The first writer of a file wins: later sizes or contents leave its bounds alone.
        Adaptive execution picks the join by the measured size of the known names.  All rows
        of a file are written by one task, so a file is registered wholly or not at all.
        """
        if self.has_chunks():
            # Names first: texts are neither shuffled nor read where nothing is new.
            names = documents.select("file").join(known_files(self.chunks()), "file", "left_anti")
            if names.isEmpty():
                return
            documents = documents.join(names.distinct(), "file", "left_semi")
        self._append_chunks(documents, size)

    def register_batch(self, documents: DataFrame, size: int | None = None) -> None:
        """As :meth:`register_chunks`, for a batch whose file count the caller bounds.

        The batch's file names are broadcast, so the chunk table is scanned in place
        instead of being shuffled for every small batch.
        """
        if self._exists("chunks"):
            names = documents.select("file")
            seen = self.chunks().join(F.broadcast(names), "file", "left_semi")
            documents = documents.join(F.broadcast(known_files(seen)), "file", "left_anti")
        self._append_chunks(documents, size)

    def _append_chunks(self, documents: DataFrame, size: int | None) -> None:
        new = chunk_documents(documents, size or self.spec.chunk_size)
        # Clustered and sorted by file, so lookups and joins on it prune row groups.
        clustered = new.repartition("file").sortWithinPartitions(*CHUNK_KEY)
        clustered.write.mode("append").parquet(self._path("chunks"))

    def write_wave(self, attempts: DataFrame, run_tag: str, run_id: str, wave: int) -> None:
        """Persist one wave's attempts, then derive its results from what was persisted.

        The attempts are written straight from the tasks that made the calls.
        """
        self._overwrite("log", attempts)
        self.derive_results(run_tag, run_id, wave)

    def derive_results(self, run_tag: str, run_id: str, wave: int | None = None) -> None:
        """(Re)write results from the log; run again on resume, it closes an unfinished wave."""
        attempts = self.run_log(run_tag, run_id)
        if wave is not None:
            attempts = attempts.where(F.col("wave") == wave)
        self._overwrite("results", as_results(attempts, self.spec))

    def summary(self, start: datetime, end: datetime, run_tag: str | None = None) -> DataFrame:
        """Attempts, stored results and skipped chunks of an interval, in one row.

        Without a run tag, failures of all tags active in the interval count together.
        """
        log, results = self.log(), self.results()
        if run_tag:
            log, results = (t.where(F.col("run_tag") == run_tag) for t in (log, results))
        return run_summary(log, results, F.lit(start), F.lit(end), self.spec.max_failures)

    def run_log(self, run_tag: str, run_id: str) -> DataFrame:
        return self.log().where((F.col("run_tag") == run_tag) & (F.col("run_id") == run_id))

    def _overwrite(self, table: str, rows: DataFrame) -> None:
        (
            rows.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*RUN_KEYS)
            .parquet(self._path(table))
        )
