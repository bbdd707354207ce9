"""Passages in texts, by automata and by their rarest words, against plain search."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from qaloom.operators import containment


def collection(seed):
    rng = random.Random(seed)
    pool = ["a", "ab", "abc", "bcd", "Ünï", "漢字", "x.", "dd"]
    docs = [(i, " ".join(rng.choices(pool, k=rng.randrange(0, 40)))) for i in range(80)] + [(90, None), (91, ""), (92, "ab " * 500)]
    asked = [(f"q{i}", " ".join(rng.choices(pool, k=rng.randrange(1, 4)))) for i in range(40)]
    asked += [(f"l{i}", docs[i][1][:60]) for i in range(20)] + [("same", "ab"), ("same2", "ab"), ("null", None), ("space", " "), ("long", "ab " * 30), ("miss", "ab " * 20 + "zz" + " ab" * 20)]
    return docs, asked


def by_hand(docs, asked):
    return sorted((q, d) for q, p in asked for d, t in docs if p is not None and t is not None and p in t)


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("way", [containment.containing, containment.containing_parts])
def test_containment_is_that_of_plain_search(spark, monkeypatch, small, way):
    if small:
        monkeypatch.setattr(containment, "BLOCK_PASSAGES", 20)
        monkeypatch.setattr(containment, "PART", 5)
    docs, asked = collection(3)
    documents = spark.createDataFrame(docs, "doc_id bigint, text string")
    passages = spark.createDataFrame(asked, "query_id string, passage string")
    found = way(passages, documents)
    assert sorted((r.query_id, r.doc_id) for r in found.collect()) == by_hand(docs, asked)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()


def test_empty_passages_and_tables(spark):
    documents = spark.createDataFrame([(1, "a"), (2, ""), (3, None)], "doc_id bigint, text string")
    passages = spark.createDataFrame([("e", "")], "query_id string, passage string")
    assert sorted(r.doc_id for r in containment.containing_parts(passages, documents).collect()) == [1, 2]
    assert containment.containing_parts(passages.limit(0), documents).count() == 0
    assert containment.containing_parts(passages, documents.where(F.lit(False))).count() == 0
