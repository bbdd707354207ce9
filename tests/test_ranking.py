from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from qaloom.operators import ranking

# actual (rank order), ideal (all judged), then DCG, NDCG, RR, P, R, F1, AP before scaling.
GOLDEN = [
    ([3, 0, 2, 0, 1], [3, 2, 2, 1, 0, 0], 4.386853, 0.770632, 1.0, 0.3, 0.5, 0.375, 0.755556),
    ([0, 0, 0], [1, 1], 0, 0, 0, 0, 0, 0, 0),
    ([0, 0], [0, 0], 0, None, 0, 0, 0, 0, 0),
    ([], [2], 0, 0, 0, 0, 0, 0, 0),
    ([1, 1], [], 1.630930, 0, 1.0, 0.2, 0, 0, 1.0),
    ([-1, 2], [2, 1, -1, 0], 0.261860, 0.119013, 0.5, 0.1, 0.25, 0.142857, 0.5),
    ([1] * 12, [1] * 20, 4.543559, 1.0, 1.0, 1.0, 0.5, 0.666667, 1.0),
]


def frames(spark, cases):
    judged = [(f"q{i}", j + 1, rel) for i, case in enumerate(cases) for j, rel in enumerate(case[0])]
    qrels = [(f"q{i}", f"d{j}", rel) for i, case in enumerate(cases) for j, rel in enumerate(case[1])]
    queries = [(f"q{i}",) for i in range(len(cases))]
    return (
        spark.createDataFrame(judged, "query_id string, rank int, relevance int"),
        spark.createDataFrame(qrels, "query_id string, doc_id string, relevance int"),
        spark.createDataFrame(queries, "query_id string"),
    )


def test_golden_vectors(spark):
    judged, qrels, queries = frames(spark, GOLDEN)
    rows = ranking.ranking_metrics(judged, ranking.ideal_profile(qrels), queries).collect()
    assert len(rows) == len(GOLDEN)
    for row in rows:
        want = GOLDEN[int(row.query_id[1:])][2:]
        scaled = [want[0], *[None if w is None else w * 100 for w in want[1:]]]
        for metric, value in zip(ranking.METRICS, scaled):
            got = row[metric]
            assert got is None if value is None else got == pytest.approx(value, abs=1e-4), (row.query_id, metric)


def test_average_skips_undefined_ndcg(spark):
    judged, qrels, queries = frames(spark, GOLDEN)
    scores = ranking.ranking_metrics(judged, ranking.ideal_profile(qrels), queries)
    rows = {r.query_id: r for r in ranking.with_average(scores).collect()}
    assert len(rows) == len(GOLDEN) + 1
    defined = [c[3] for c in GOLDEN if c[3] is not None]
    assert rows["Average"]["ndcg"] == pytest.approx(100 * sum(defined) / len(defined), abs=1e-3)
    assert rows["Average"]["precision"] == pytest.approx(100 * sum(c[5] for c in GOLDEN) / len(GOLDEN), abs=1e-3)


def test_textbook_denominators(spark):
    judged, qrels, queries = frames(spark, GOLDEN[:1])
    row = ranking.ranking_metrics(
        judged, ranking.ideal_profile(qrels), queries, recall_denominator="relevant", ap_denominator="relevant"
    ).first()
    assert row.recall == pytest.approx(75.0)
    assert row["map"] == pytest.approx(100 * (1 + 2 / 3 + 3 / 5) / 4)


def test_first_judgment_wins_and_unjudged_is_zero(spark):
    qrels = spark.createDataFrame(
        [("q", "a", 2, 0), ("q", "a", 1, 1), ("q", "b", -1, 2)], "query_id string, doc_id string, relevance int, at int"
    )
    hits = spark.createDataFrame(
        [("q", "a", 1), ("q", "c", 2), ("q", "b", 3)], "query_id string, doc_id string, rank int"
    )
    judged = {r.doc_id: r.relevance for r in ranking.judge_hits(hits, qrels, "at").collect()}
    assert judged == {"a": 2, "b": -1, "c": 0}


def test_ideal_ranking_is_the_sorted_list(spark):
    grades = [2, 0, 1, 1, -1, 2, 2]
    qrels = spark.createDataFrame(
        [("q", f"d{i}", g) for i, g in enumerate(grades)], "query_id string, doc_id string, relevance int"
    )
    runs = ranking.ideal_ranking(qrels).orderBy("first_rank").collect()
    unrolled = [r.relevance for r in runs for _ in range(r.first_rank, r.last_rank + 1)]
    assert unrolled == sorted(grades, reverse=True)


def test_ideal_dcg_of_many_judgments(spark):
    qrels = spark.range(5000).select(
        F.lit("q").alias("query_id"), F.col("id").cast("string").alias("doc_id"), (F.col("id") % 4).cast("int").alias("relevance")
    )
    row = ranking.ideal_profile(qrels, 10).first()
    assert row.ideal_dcg == pytest.approx(sum(3 / math.log2(i + 1) for i in range(1, 11)))
    assert (row.judged, row.relevant) == (5000, 3750)


def test_modes_score_queries_without_hits(spark):
    _, qrels, queries = frames(spark, GOLDEN[:2])
    hits = spark.createDataFrame([("keyword", "q0", "d0", 1)], "mode string, query_id string, doc_id string, rank int")
    rows = ranking.evaluate_ranking(hits, qrels, queries, modes=("semantic", "keyword")).collect()
    assert sorted((r["mode"], r.query_id) for r in rows) == sorted(
        (m, q) for m in ("semantic", "keyword") for q in ("q0", "q1", "Average")
    )
    assert [r.mrr for r in rows if r["mode"] == "semantic"] == [0.0, 0.0, 0.0]


def test_metric_ranges(spark):
    cases = [([i % 3, (i * 7) % 2, 0, 1], [2, 2, 1, 1, 1, 0]) for i in range(12)]
    judged, qrels, queries = frames(spark, cases)
    for row in ranking.ranking_metrics(judged, ranking.ideal_profile(qrels), queries).collect():
        assert all(0 <= row[m] <= 100 for m in ranking.METRICS[1:])


def test_top_k_breaks_ties_by_id(spark):
    rows = spark.createDataFrame(
        [("q", d, s) for d, s in ((3, 1.0), (1, 1.0 + 1e-9), (2, 1.0), (9, 2.0))], "query_id string, doc_id int, score double"
    )
    best = ranking.top_k(rows, 3, ["query_id"]).orderBy("rank").collect()
    assert [r.doc_id for r in best] == [9, 1, 2]


def test_two_judgments_of_a_pair_need_an_order(spark):
    qrels = spark.createDataFrame([(1, 5, 1, 0), (1, 5, 2, 1)], "query_id bigint, doc_id bigint, relevance int, at int")
    assert ranking.first_judgments(qrels, "at").first().relevance == 1
    with pytest.raises(Exception, match="judged twice"):
        ranking.first_judgments(qrels).collect()
