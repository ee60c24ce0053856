"""Failure rates over event time, changed chunks, and registering by names first."""

import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from gleanframe.operators.chunks import chunk_changes, chunk_marks, chunk_texts
from gleanframe.operators.store import Store
from gleanframe.plans.sample import SPEC
from gleanframe.sources.documents import with_status
from gleanframe.streaming.monitor import failure_rate, monitor, tripped_windows

START = datetime(2024, 1, 1)


def test_late_rows_count_inside_the_watermark_only(spark, tmp_path):
    schema = "at timestamp, success boolean, run_tag string"

    def arrive(number, rows):
        frame = spark.createDataFrame([(START + timedelta(hours=h), ok, "a") for h, ok in rows], schema)
        frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        for name in os.listdir(tmp_path / "log"):
            if name.endswith(".parquet") and name not in seen:
                seen.add(name)
                os.utime(tmp_path / "log" / name, (number, number))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
        rates = failure_rate(stream, F.col("at"), "1 day", "1 day")
        monitor(rates, f"{tmp_path}/rates", f"{tmp_path}/progress").awaitTermination()
        return {
            (r.window_start - START).days: (r.attempts, r.failures)
            for r in spark.read.schema(rates.schema).parquet(f"{tmp_path}/rates").collect()
        }

    seen = set()
    arrive(1, [(1, True), (2, False), (30, True)])
    arrive(2, [(3, False), (60, True)])  # hour 3 is late, but inside the watermark
    assert run() == {0: (3, 2)}
    # Started again from its checkpoint: hour 4 is beyond the watermark, hour 31 is not.
    arrive(3, [(4, False), (31, False), (100, True)])
    assert run() == {0: (3, 2), 1: (2, 1), 2: (1, 0)}
    rates = failure_rate(spark.read.parquet(f"{tmp_path}/log"), F.col("at"), "1 day")
    assert {(r.window_start - START).days for r in tripped_windows(rates, 0.4).collect()} == {0, 1}


def test_changes_of_equal_length_and_moves(spark):
    def marks(texts):
        documents = with_status(spark.createDataFrame(list(texts.items()), "file string, content string"))
        return chunk_marks(chunk_texts(documents, 4))

    old = marks({"a": "aa\nbb\ncc\nbb\n", "b": "xx\nyy\n", "gone": "zz\n"})
    new = marks({"a": "aa\nnn\nbb\ncc\nbb\n", "b": "xx\nyz\n", "more": "zz\n"})
    found = sorted((r.file, str(r.old_chunk), str(r.new_chunk), r.change) for r in chunk_changes(old, new).collect())
    assert found == [
        ("a", "0", "0", "kept"), ("a", "1", "2", "moved"), ("a", "2", "3", "moved"), ("a", "3", "4", "moved"),
        ("a", "None", "1", "new"), ("b", "0", "0", "kept"), ("b", "1", "None", "gone"), ("b", "None", "1", "new"),
        ("gone", "0", "None", "gone"), ("more", "None", "0", "new"),
    ]


def test_known_documents_are_told_by_name_alone(spark, tmp_path):
    rows = [(f"s/{i}", "Some words.") for i in range(9)]
    documents = with_status(spark.createDataFrame(rows, "file string, content string"))
    store = Store(spark, f"{tmp_path}/s", SPEC)
    store.register_chunks(documents.where("file < 's/5'"))
    files = set(os.listdir(tmp_path / "s" / "chunks"))
    # Reading a text would fail here; nothing is new, so none is read and nothing is written.
    unread = documents.where("file < 's/5'").withColumn("content", F.raise_error(F.lit("read")).cast("string"))
    store.register_chunks(unread)
    assert set(os.listdir(tmp_path / "s" / "chunks")) == files
    store.register_chunks(documents.unionByName(documents))
    assert sorted(r.file for r in store.chunks().collect()) == sorted([r[0] for r in rows[:5]] + 2 * [r[0] for r in rows[5:]])
