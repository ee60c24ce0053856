"""What the stages of the pipeline leave on disk and how often they move texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gleanframe.llm import jaccard, links, tables

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def groups(n, members):
    """Groups of near copies, every row twice, and rows without ids or words."""
    rng = np.random.default_rng(4)
    rows = []
    for g in range(n):
        for k in range(members):
            edits = set(rng.choice(120, int(rng.integers(0, 5)), replace=False).tolist())
            text = " ".join(f"e{g}_{k}_{i}" if i in edits else f"w{g}_{i}" for i in range(120))
            rows.append((g * members + k, text, "en", "ab"[k % 2], 1))
    return rows * 2 + [(None, rows[0][1], "en", None, 1), (9_000, None, "en", "a", 1), (9_001, "", "en", "a", 1)]


@pytest.fixture
def folder(tmp_path, monkeypatch):
    names = iter(range(1000))
    monkeypatch.setattr(tables, "shared_folder", lambda spark: f"{tmp_path}/{next(names)}")
    return tmp_path


@pytest.mark.parametrize("stage", [corpus_pipeline.drop_near_copies, corpus_pipeline.mix_sources])
def test_a_stage_leaves_one_table_and_moves_texts_once(spark, folder, stage):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.createDataFrame(groups(3, 8), DOCS)
        frame = stage(spark, docs, "")
        plan = frame._jdf.queryExecution().executedPlan().toString()
        rows = frame.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(list(folder.iterdir())) == 1
    # The texts and the keys kept are dealt out once each.
    assert plan.count("Exchange hashpartitioning") == 2
    assert rows and {r.doc_id for r in rows if not r.text} >= ({9_000, 9_001} if stage is corpus_pipeline.drop_near_copies else set())


def test_settled_keeps_what_is_returned_alone(spark, folder):
    def make():
        inner = tables.kept(spark.range(5))
        return tables.settled(lambda: tables.kept(inner.where("id > 1")).where("id < 4")).union(inner.where("id = 0"))

    outside = tables.kept(spark.range(3))
    made = tables.settled(make)
    assert sorted(r.id for r in made.collect()) == [0, 2, 3] and outside.count() == 3
    assert len(list(folder.iterdir())) == 2


@pytest.mark.parametrize("members,meet", [(links.LARGE // 2, False), (links.LARGE * 2, True)])
def test_further_hubs_meet_members_of_large_buckets_only(spark, monkeypatch, members, meet):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(w if rng.random() > 0.08 else f"x{i}{k}" for k, w in enumerate(words))) for i in range(members)]
    met, more = [], links._more_hubs
    monkeypatch.setattr(links, "_more_hubs", lambda rows, number: met.append(not rows.isEmpty()) or more(rows, number))
    found = jaccard.jaccard_classes(spark.createDataFrame(docs, "doc_id long, text string"), jaccard.Join(words=3, num=70, den=100, rounds=2))
    assert found.agg(F.count_distinct("component")).first()[0] == members and met == [meet]
