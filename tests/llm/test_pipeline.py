"""The pipeline: what each stage keeps of its own input, and edge cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from sensorlake.llm import queries as Q

from tests.conftest import SMOKE_DIR
from tests.llm.test_dedup import brute


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMOKE_DIR}/documents.parquet")


def test_quality_and_language_keep_clean_documents(spark, documents):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMOKE_DIR}/labels.parquet").collect()}
    kept = P.quality(spark, documents, SMOKE_DIR)
    assert kept.schema.names == documents.schema.names
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    right = [(i in ids) == (labels[i] == 1) for i in labels if labels[i] is not None]
    assert np.mean(right) > 0.97
    told = P.language(spark, kept, SMOKE_DIR)
    assert told.schema.names == documents.schema.names and told.count() >= 0.99 * len(ids)


def test_one_document_of_each_group_stays(spark, documents):
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    want = {i for i, (_, c) in brute(docs, 5).items() if i == c}
    twice = documents.unionByName(documents.where("doc_id < 20"))
    got = [r.doc_id for r in P.near_duplicates(spark, twice, SMOKE_DIR).select("doc_id").collect()]
    assert sorted(got) == sorted(want)


def test_different_texts_of_one_id_are_judged_by_themselves(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a, 1), (2, a, 2), (2, b, 3), (3, c, 4), (3, b + " more", 5), (4, "", 6), (4, " ", 7), (5, c + " x", 8), (5, c + " x", 8), (6, c, 9), (6, c + " y", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = sorted((r.doc_id, r.text) for r in P.near_duplicates(spark, docs, SMOKE_DIR).collect())
    assert got == sorted([(1, a), (2, b), (3, c), (4, ""), (4, " ")])
    same = [(7, a), (7, a + " z"), (7, a), (8, b)]  # two near copies under one id
    docs = spark.createDataFrame(same, "doc_id long, text string")
    got = sorted(r.doc_id for r in P.near_duplicates(spark, docs, SMOKE_DIR).collect())
    assert got == [7, 8]


def test_the_groups_stand_in_no_join_of_the_documents(spark, documents, capsys):
    P.near_duplicates(spark, documents, SMOKE_DIR).explain()
    plan = capsys.readouterr().out
    assert "Join" in plan and "Aggregate" not in plan


def test_passages_change_texts_and_their_length(spark, documents):
    got = P.repeated_passages(spark, documents, SMOKE_DIR)
    assert got.schema.names == documents.schema.names and got.count() == documents.count()
    changed = got.join(documents.select("doc_id", F.col("text").alias("was")), "doc_id").where("text <> was").collect()
    assert changed and all(r.n_chars == len(r.text) < len(r.was) for r in changed)


def test_run_packs_what_the_stages_keep(spark):
    got = P.run(spark, SMOKE_DIR).collect()
    assert got and set(got[0].asDict()) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    total: dict = {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert all(total[r.doc_id] == r.doc_tokens for r in got)


def test_stages_with_odd_rows(spark):
    rows = [
        (1, None, "en", None, 0, "a"), (2, "", None, "s", None, None), (3, "the cat " * 40_000, "en", "s", 1, "b"),
        (None, "no id here", "en", "s", 1, "c"), (4, "some text here", None, "s", 1, "d"), (4, "some text here", None, "s", 1, "d"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    for _, stage in P.STAGES:
        for d in (docs, docs.where("false")):
            out = stage(spark, d, SMOKE_DIR)
            n = len(out.collect())
            if stage is not P.pack:
                assert out.schema.names == docs.schema.names and n <= d.count()
    once = [r.doc_id for r in P.near_duplicates(spark, docs, SMOKE_DIR).collect()]
    assert sorted(once, key=repr) == sorted([1, 2, 3, 4, None], key=repr)


def test_every_operator_has_a_query():
    assert sorted(int(k[2:].split("_")[0]) for k in Q.QUERIES) == list(range(1, 14))
    assert [n for n, _ in P.STAGES] == ["quality classifier", "language ID", "MinHash near-dedup", "substring dedup", "packing"]
