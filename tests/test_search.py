from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from qaloom import prompts
from qaloom.operators import blockmax, dense, lexical, pivots, ranking, tiles
from qaloom.operators.context import rag_context
from qaloom.operators.skew import fetch, hot_keys, salted_join
from qaloom.operators.tiles import best_in_tile


def zipf_texts(n, seed, vocabulary=60):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(vocabulary)]
    weights = [1 / (i + 1) for i in range(vocabulary)]
    return [" ".join(rng.choices(pool, weights, k=rng.randint(0, 25))) for _ in range(n)]


def bm25_by_hand(queries, docs, k):
    tokens = {i: t.split() for i, t in docs.items()}
    mean = sum(map(len, tokens.values())) / len(tokens)
    df = Counter(w for t in tokens.values() for w in set(t))
    out = []
    for q, text in queries.items():
        scores = {}
        for d, t in tokens.items():
            tf = Counter(t)
            s = 0.0
            for w, qtf in Counter(text.split()).items():
                if tf[w]:
                    idf = math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5))
                    s += qtf * idf * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(t) / mean))
            if s:
                scores[d] = round(s, 6)
        for r, (d, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k], 1):
            out.append((q, d, r, s))
    return sorted(out)


@pytest.fixture(scope="module")
def collection(spark):
    docs = dict(enumerate(zipf_texts(150, 1)))
    queries = dict(enumerate(zipf_texts(12, 2)))
    return (
        queries,
        docs,
        spark.createDataFrame(list(queries.items()), "query_id bigint, query string"),
        spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(3),
    )


def found(hits):
    return sorted((r.query_id, r.doc_id, r["rank"], round(r.score, 6)) for r in hits.collect())


@pytest.mark.parametrize("direct", [True, False])
def test_bm25_matches_brute_force(collection, direct, monkeypatch):
    monkeypatch.setattr(lexical, "SEED_POSTINGS", 20)
    queries, docs, q, d = collection
    assert found(lexical.bm25_search(q, d, k=5, direct=direct)) == bm25_by_hand(queries, docs, 5)


@pytest.mark.parametrize("direct", [True, False])
def test_bm25_without_broadcasts(collection, direct, shuffle_only):
    queries, docs, q, d = collection
    assert found(lexical.bm25_search(q, d, k=5, direct=direct)) == bm25_by_hand(queries, docs, 5)


@pytest.mark.parametrize("shuffled", [False, True])
@pytest.mark.parametrize("direct", [True, False])
def test_a_task_adds_up_a_bounded_number_of_contributions(collection, direct, shuffled, monkeypatch, request):
    if shuffled:
        request.getfixturevalue("shuffle_only")
    queries, docs, q, d = collection
    dealt = []
    original = type(d).repartition

    def spy(df, n, *columns):
        dealt.append((n, columns))
        return original(df, n, *columns)

    monkeypatch.setattr(type(d), "repartition", spy)
    monkeypatch.setattr(lexical, "PAIRS_PER_TASK", 100)
    hits = lexical.bm25_search(q, d, k=5, direct=direct)
    assert found(hits) == bm25_by_hand(queries, docs, 5)
    wanted = [t for text in queries.values() for t in set(text.lower().split())]
    emitted = sum(t in set(text.lower().split()) for t in wanted for text in docs.values())
    # Whole documents to a task, or whole pairs where the weights are too large to broadcast.
    columns = ("query_id", "doc_id") if shuffled else ("doc_id",)
    most = max(n for n, by in dealt if by == columns)
    assert most > 1 and (not direct or most == -(-emitted // 100))


def test_bm25_stored_index(spark, collection, tmp_path):
    queries, docs, q, d = collection
    lexical.bm25_index(d, path=str(tmp_path / "index"))
    index = lexical.open_bm25_index(spark, str(tmp_path / "index"))
    assert index.documents == len(docs)
    assert found(lexical.bm25_search(q, index, k=5)) == bm25_by_hand(queries, docs, 5)


def test_pruned_search_reads_fewer_terms(collection, monkeypatch):
    staged = {}
    original = lexical.stage

    def spy(df, label, path=None):
        staged[label] = original(df, label, path)
        return staged[label]

    monkeypatch.setattr(lexical, "stage", spy)
    _, _, q, d = collection
    lexical.bm25_search(q, d, k=3, direct=False).count()
    assert staged["query-plan"].where("put_off").count() > 0


@pytest.mark.parametrize("broadcast", [True, False])
def test_dense_matches_brute_force(spark, broadcast, monkeypatch):
    monkeypatch.setattr(dense, "LEFT_ROWS", 4)
    monkeypatch.setattr(dense, "RIGHT_ROWS", 30)
    rng = np.random.default_rng(5)
    q, d = rng.normal(size=(9, 8)), rng.normal(size=(70, 8))
    d[3] = d[4]
    scores = np.round((q / np.linalg.norm(q, axis=1, keepdims=True)) @ (d / np.linalg.norm(d, axis=1, keepdims=True)).T, 6)
    want = []
    for i in range(len(q)):
        order = sorted((j for j in range(len(d)) if j != i), key=lambda j: (-scores[i, j], j))[:4]
        want += [(i, j, r, scores[i, j]) for r, j in enumerate(order, 1)]
    qs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id bigint, vector array<double>")
    ds = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(d)], "doc_id bigint, vector array<double>")
    hits = dense.dense_search(qs, ds, 4, exclude_same_id=True, broadcast=broadcast)
    assert found(hits) == [(i, j, r, pytest.approx(s)) for i, j, r, s in sorted(want)]


def test_dense_string_ids_and_zero_vectors(spark):
    qs = spark.createDataFrame([("a", [1.0, 0.0])], "query_id string, vector array<float>")
    ds = spark.createDataFrame(
        [("y", [0.0, 0.0]), ("x", [0.0, 2.0]), ("z", [3.0, 0.0])], "doc_id string, vector array<float>"
    )
    assert found(dense.dense_search(qs, ds)) == [("a", "x", 2, 0.0), ("a", "y", 3, 0.0), ("a", "z", 1, 1.0)]


def test_best_in_tile_keeps_all_ties_in_order():
    rows, cols = best_in_tile(np.array([[1.0, 1.0, 1.0, 0.5]]), np.array([9, 7, 8, 1]), 2, 6)
    assert rows.tolist() == [0, 0] and cols.tolist() == [1, 2]


def test_rerank_reorders_candidates(spark):
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "query_id bigint, doc_id bigint, rank int")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id bigint, vector array<float>")
    d = spark.createDataFrame(
        [(10, [0.0, 1.0]), (11, [1.0, 1.0]), (12, [1.0, 0.0])], "doc_id bigint, vector array<float>"
    )
    got = dense.rerank(hits, q, d, 2).orderBy("rank").collect()
    assert [(r.doc_id, round(r.score, 6)) for r in got] == [(12, 1.0), (11, round(math.sqrt(0.5), 6))]


def test_context_joins_in_rank_order(spark):
    queries = spark.createDataFrame([(1, "a"), (2, "b")], "query_id bigint, question string")
    hits = spark.createDataFrame(
        [(1, 7, 2), (1, 8, 1), (1, 9, 3), (1, 99, 4)], "query_id bigint, doc_id bigint, rank int"
    )
    corpus = spark.createDataFrame([(7, "seven"), (8, "eight"), (9, None)], "doc_id bigint, text string")
    rows = {r.query_id: r.context for r in rag_context(queries, hits, corpus).collect()}
    assert rows == {1: "eight\n\nseven\n\n", 2: prompts.NO_CONTEXT}


def test_salted_join_and_fetch_keep_every_pair(spark, shuffle_only):
    big = spark.range(300).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("key"), "id")
    small = spark.range(40).select(F.col("id").alias("key"), (F.col("id") * 10).alias("value"))
    plain = sorted(map(tuple, big.join(small, "key").select("key", "id", "value").collect()))
    hot = hot_keys(big.groupBy("key").agg(F.count("*").alias("n")), "key", "n", slice_rows=8)
    assert hot.count() >= 1
    assert sorted(map(tuple, salted_join(big, small, "key", "id", hot).select("key", "id", "value").collect())) == plain
    assert sorted(map(tuple, fetch(big, small, "key", "id").select("key", "id", "value").collect())) == plain
    assert hot_keys(big.groupBy("key").agg(F.count("*").alias("n")), "key", "n", slice_rows=1000) is None


def test_a_stored_index_reads_the_folders_of_its_terms(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blockmax, "FOLDER_POSTINGS", 100)
    docs = spark.createDataFrame([(i, f"word{i} common text{i % 7}") for i in range(200)], "doc_id bigint, text string")
    index = lexical.bm25_index(docs, path=str(tmp_path / "index"))
    # The number of folders follows the postings.
    assert index.folders == 6
    wanted = spark.createDataFrame([("word3",), ("text2",)], "term string")
    part = index.of_terms(wanted)
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "folder" in plan.split("PartitionFilters: ")[1].split("]")[0]
    assert "In(term" in plan
    assert part.select("term").distinct().count() == 2
    stats = {r["term"]: r["df"] for r in lexical.term_statistics(index, wanted).collect()}
    assert stats == {"word3": 1, "text2": 29}
    with pytest.raises(Exception, match="already exists"):
        lexical.bm25_index(docs, path=str(tmp_path / "index"))


@pytest.mark.parametrize("shuffled", [False, True])
def test_blocks_that_cannot_matter_are_not_unpacked(spark, monkeypatch, tmp_path, request, shuffled):
    if shuffled:
        request.getfixturevalue("shuffle_only")
    monkeypatch.setattr(blockmax, "BLOCK_DOCUMENTS", 8)
    monkeypatch.setattr(blockmax, "SEED_DOCUMENTS", 4)
    rng = random.Random(9)
    docs = dict(enumerate(zipf_texts(400, 5)))
    # Some documents are full of rare words; an equal text comes very often.
    docs |= {400 + i: " ".join(rng.choices([f"w{j}" for j in range(40, 60)], k=6)) for i in range(30)}
    docs |= {500 + i: docs[7] for i in range(120)}
    queries = {i: f"w{40 + i} w{41 + i} w{42 + i} w0 w1" for i in range(10)} | {20: "nowhere", 21: "", 22: "w0"}
    asked = spark.createDataFrame(list(queries.items()), "query_id bigint, query string")
    index = lexical.bm25_index(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"), path=str(tmp_path / "index"))
    assert found(lexical.bm25_search(asked, index, k=5)) == bm25_by_hand(queries, docs, 5)
    report = {}
    blockmax.block_scores(lexical.stage(lexical.query_terms(asked), "asked"), index, 5, report).count()
    assert report["unpacked"] < 0.5 * report["blocks"]


def test_blocks_hand_on_the_best_documents_only(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(blockmax, "ASKED", 20)
    monkeypatch.setattr(blockmax, "HELD_SCORES", 1_000)
    monkeypatch.setattr(blockmax, "SEED_DOCUMENTS", 4)
    docs = {f"d{i:03d}": text for i, text in enumerate(zipf_texts(300, 3))} | {f"e{i}": "w0 w1 w2" for i in range(50)}
    queries = {f"q{i}": f"w0 w{i} w{i + 1}" for i in range(30)}
    asked = spark.createDataFrame(list(queries.items()), "query_id string, query string")
    index = lexical.bm25_index(spark.createDataFrame(list(docs.items()), "doc_id string, text string"), path=str(tmp_path / "index"))
    assert found(lexical.bm25_search(asked, index, k=3)) == bm25_by_hand(queries, docs, 3)
    blocks = index.blocks.select("block").distinct().count()
    scores = blockmax.block_scores(lexical.stage(lexical.query_terms(asked), "asked"), index, 3)
    assert scores.groupBy("query_id").count().agg({"count": "max"}).first()[0] <= 3 * blocks < 300


def test_blocks_make_no_row_per_query_and_block(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(blockmax, "BLOCK_DOCUMENTS", 8)
    monkeypatch.setattr(blockmax, "SEED_DOCUMENTS", 4)
    docs = {i: f"common words everywhere w{i}" for i in range(400)}
    queries = {i: f"common words everywhere w{7 * i}" for i in range(50)} | {60: "common common", 61: "words w3 w3 w5 w390"}
    asked = spark.createDataFrame(list(queries.items()), "query_id bigint, query string")
    index = lexical.bm25_index(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"), path=str(tmp_path / "index"))
    staged, real = {}, blockmax.stage

    def counted(df, label):
        table = real(df, label)
        staged[label] = table.count()
        return table

    monkeypatch.setattr(blockmax, "stage", counted)
    assert found(lexical.bm25_search(asked, index, k=3)) == bm25_by_hand(queries, docs, 3)
    blocks = index.blocks.select("block").distinct().count()
    assert blocks >= 40 and staged and max(staged.values()) < len(queries) * blocks


def test_a_block_is_bounded_by_its_words(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(blockmax, "BLOCK_WORDS", 1_000)
    docs = spark.createDataFrame([(i, "a b c d e " * 20) for i in range(60)], "doc_id bigint, text string")
    index = lexical.bm25_index(docs, path=str(tmp_path / "index"))
    assert max(r["n"] for r in index.blocks.where("term = 'a'").collect()) < 30


def test_a_stored_index_of_nothing(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id string, text string")
    asked = spark.createDataFrame([("a", "word")], "query_id string, query string")
    assert lexical.bm25_search(asked, lexical.bm25_index(docs, path=str(tmp_path / "none"))).count() == 0
    docs = spark.createDataFrame([("x", None), ("y", "!"), ("z", "Word word")], "doc_id string, text string")
    index = lexical.bm25_index(docs, path=str(tmp_path / "some"))
    assert index.documents == 3 and [r.doc_id for r in lexical.bm25_search(asked, index).collect()] == ["z"]


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [float("nan"), 1.0]), (2, None), (3, [1.0]), (4, [0.0, 0.0]), (5, [0.9, 0.1]), (6, [None, 1.0])]
    known = spark.createDataFrame(rows, "doc_id bigint, vector array<double>")
    asked = spark.createDataFrame([(9, [1.0, 0.0])], "query_id bigint, vector array<double>")
    for broadcast in (True, False):
        got = dense.dense_search(asked, known, 10, broadcast=broadcast).orderBy("rank").collect()
        assert [r.doc_id for r in got] == [0, 5, 4]
        assert len(dense.dense_search(asked, known, 1, broadcast=broadcast).collect()) == 1


def test_scores_are_computed_in_bounded_slices(monkeypatch):
    monkeypatch.setattr(tiles, "SCORE_CELLS", 1_000)
    rng = np.random.default_rng(0)
    left, right = rng.normal(size=(100, 8)), rng.normal(size=(500, 8))
    best = tiles.BestHits(left, np.arange(100), 3, 6, False)
    best.add(right, np.arange(500))
    assert best.peak <= 1_000
    want = np.argsort(-(left @ right.T), axis=1)[:, :3]
    assert (best.found.reshape(100, 3) == want).all()


def test_few_scores_are_sorted(monkeypatch):
    monkeypatch.setattr(tiles, "SCORE_CELLS", 20_000)
    rng = np.random.default_rng(1)
    left, right = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (rng.normal(size=(100, 16)), rng.normal(size=(40_000, 16))))
    left[7] = 0.0
    right[900:960] = right[900]
    left_ids, right_ids = np.arange(100), rng.permutation(40_000)
    compared, real = [], tiles.best_per_row

    def counted(rows, *others):
        compared.append(len(rows))
        return real(rows, *others)

    monkeypatch.setattr(tiles, "best_per_row", counted)
    best = tiles.BestHits(left, left_ids, 10, 6, True)
    for begin in range(0, 40_000, 5_000):
        best.add(right[begin : begin + 5_000], right_ids[begin : begin + 5_000])
    rows, found_ids, scores = best.rows, best.found, best.scores
    exact = np.round(left @ right.T, 6)
    for i in range(100):
        order = [j for j in np.lexsort((right_ids, -exact[i])) if right_ids[j] != left_ids[i]][:10]
        assert found_ids[rows == i].tolist() == right_ids[order].tolist()
        assert np.abs(scores[rows == i] - exact[i][order]).max() < 1e-6
    assert sum(compared) < 300 * 100 * 10


def test_scores_that_single_precision_cannot_tell_apart():
    rng = np.random.default_rng(5)
    left = rng.normal(size=(20, 64)) / 8
    # Around each left row, many right rows whose scores differ in the sixth decimal.
    right = np.concatenate([left + rng.normal(size=(20, 64)) * 2e-4 for _ in range(200)])
    left, right = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (left, right))
    best = tiles.BestHits(left, np.arange(20), 10, 6, False)
    ids = rng.permutation(len(right))
    for begin in range(0, len(right), 500):
        best.add(right[begin : begin + 500], ids[begin : begin + 500])
    rows, found_ids = best.rows, best.found
    exact = np.round(np.einsum("ik,jk->ij", left, right), 6)
    for i in range(20):
        assert found_ids[rows == i].tolist() == ids[np.lexsort((ids, -exact[i]))[:10]].tolist()
        assert np.abs((left[i].astype(np.float32) @ right.T.astype(np.float32)) - left[i] @ right.T).max() < tiles.single_error(64)


def test_rows_go_to_few_tiles():
    # A row goes to all blocks of the other side.
    assert tiles.blocks_for(720_000, 64, dense.LEFT_ROWS) + tiles.blocks_for(720_000, 64, dense.RIGHT_ROWS) < 50


def test_an_id_that_comes_twice_leaves_itself_out_once():
    left = np.eye(3)[[0, 0, 1]]
    best = tiles.BestHits(left, np.array([5, 5, 6]), 2, 6, True)
    best.add(np.eye(3), np.array([5, 6, 7]))
    rows, found_ids = best.rows, best.found
    assert [found_ids[rows == i].tolist() for i in range(3)] == [[6, 7], [5, 6], [5, 7]]


def test_top_k_beyond_the_limit_of_the_engine(spark):
    rows = spark.range(5000).select(F.lit("q").alias("query_id"), F.col("id").alias("doc_id"), (F.col("id") % 100).cast("double").alias("score"))
    got = ranking.top_k(rows, 1200, ["query_id"]).orderBy("rank").collect()
    want = sorted(range(5000), key=lambda i: (-(i % 100), i))[:1200]
    assert [r.doc_id for r in got] == want


@pytest.mark.parametrize("broadcast", [None, True, False])
@pytest.mark.parametrize("rows", [[], [(9, None)], [(9, [float("nan")])]])
def test_a_search_without_usable_queries_finds_nothing(spark, broadcast, rows):
    known = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "doc_id bigint, vector array<double>")
    asked = spark.createDataFrame(rows, "query_id bigint, vector array<double>")
    assert dense.dense_search(asked, known, 3, broadcast=broadcast).count() == 0
    assert dense.dense_search(asked, pivots.pivot_index(known), 3).count() == 0
    assert dense.dense_search(known.withColumnRenamed("doc_id", "query_id"), known.limit(0), 3, broadcast=broadcast).count() == 0


def clustered(n, clusters, width, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, width))
    return (centres[rng.integers(0, clusters, n)] + 0.08 * rng.normal(size=(n, width))).round(4)


@pytest.mark.parametrize("queries_at_once", [None, 7])
def test_pivots_skip_cells_and_lose_no_hit(spark, monkeypatch, tmp_path, queries_at_once):
    monkeypatch.setattr(pivots, "CELL_ROWS", 25)
    monkeypatch.setattr(pivots, "RUN", 16)
    if queries_at_once:
        monkeypatch.setattr(pivots, "QUERY_ELEMENTS", 8 * queries_at_once)
    rows = clustered(1500, 30, 8, 4)
    rows[100:140] = rows[100]
    known = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)] + [(3000, [0.0] * 8), (None, [1.0] * 8)], "doc_id bigint, vector array<double>")
    asked = known.withColumnRenamed("doc_id", "query_id").where("query_id % 50 = 0")
    pivots.pivot_index(known, str(tmp_path / "index"))
    index, report = pivots.open_pivot_index(spark, str(tmp_path / "index")), {}
    got = pivots.pivot_search(asked, index, 6, exclude_same_id=True, report=report)
    want = dense.dense_search(asked, known, 6, exclude_same_id=True)
    assert found(got) == found(want)
    # The zero query reads all; the others search a small part, and few cells are read for most of them.
    assert len(index.pivots) == 61 and report["pairs_searched"] < 0.2 * report["pairs"]
    one, report = asked.where("query_id = 200"), {}
    assert found(pivots.pivot_search(one, index, 6, report=report)) == found(dense.dense_search(one, known, 6))
    assert report["cells_read"] <= 10 < report["cells"]
    with pytest.raises(Exception, match="already exists"):
        pivots.pivot_index(known, str(tmp_path / "index"))


def test_pivot_search_prunes_folders_and_does_not_shuffle_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(pivots, "CELL_ROWS", 20)
    known = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(clustered(300, 6, 5, 2))], "doc_id string, vector array<float>")
    index = pivots.pivot_index(known)
    asked = known.selectExpr("concat('q', doc_id) AS query_id", "vector").limit(4)
    hits = dense.dense_search(asked, index, 3)
    assert found(hits) == found(dense.dense_search(asked, known, 3))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    # What is shuffled are the hits, by query.
    plan = plan.split("== Initial Plan ==")[-1]
    assert plan.count("Exchange ") == 1 and "Exchange hashpartitioning(_row" in plan


def test_the_bar_of_a_pivot_search_rises():
    hits = pivots._Hits(2, np.full(3, -np.inf))
    hits.last = 1
    hits.add(np.array([0, 0, 0, 2, 0]), np.array([5, 6, 7, 5, 8]), np.array([0.2, 0.5, 0.4, 0.9, 0.1]))
    assert hits.bar.tolist() == [0.4 - pivots.MARGIN, -np.inf, -np.inf]
    hits.add(np.array([0, 2, 2]), np.array([9, 9, 7]), np.array([0.3, 0.8, 0.7]))
    row, doc, score = hits.best()
    assert list(zip(row.tolist(), doc.tolist(), score.tolist(), strict=True)) == [(0, 6, 0.5), (0, 7, 0.4), (2, 5, 0.9), (2, 9, 0.8)]
    assert hits.bar.tolist() == [0.4 - pivots.MARGIN, -np.inf, 0.8 - pivots.MARGIN]


def test_a_pass_of_queries_reads_its_own_folder(spark, monkeypatch):
    monkeypatch.setattr(pivots, "CELL_ROWS", 20)
    monkeypatch.setattr(pivots, "QUERY_ELEMENTS", 5 * 40)
    vectors = [v.tolist() for v in clustered(120, 6, 5, 2)]
    # Zero vectors and copies.
    vectors[3] = vectors[50] = [0.0] * 5
    vectors[60:70] = [vectors[60]] * 10
    known = spark.createDataFrame(list(enumerate(vectors)), "doc_id bigint, vector array<float>")
    asked = known.withColumnRenamed("doc_id", "query_id")
    plans, real = [], pivots._pass

    def seen(left, *others):
        plans.append(left._jdf.queryExecution().executedPlan().toString())
        return real(left, *others)

    monkeypatch.setattr(pivots, "_pass", seen)
    got = found(pivots.pivot_search(asked, pivots.pivot_index(known), 4, exclude_same_id=True))
    assert got == found(dense.dense_search(asked, known, 4, exclude_same_id=True, broadcast=False))
    assert len(plans) == 3 and all("_pass" in plan.split("PartitionFilters: ")[1].split("]")[0] for plan in plans)


def test_reach_bounds_every_cosine():
    rng = np.random.default_rng(3)
    rows, query, pivot = (x / np.linalg.norm(x, axis=-1, keepdims=True) for x in (rng.normal(size=(500, 4)), rng.normal(size=4), rng.normal(size=4)))
    near = rows @ pivot
    for low in np.linspace(-1, 0.8, 10):
        part = rows[(near >= low) & (near <= low + 0.2)]
        assert not len(part) or (part @ query).max() <= reach_of(query @ pivot, low, low + 0.2) + 1e-9


def reach_of(near, least, most):
    return float(pivots.reach(np.array([near]), np.array([least]), np.array([most]))[0])


def test_dense_search_by_short_vectors(spark):
    rows = clustered(120, 5, 8, 9)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "doc_id bigint, vector array<double>")
    short = table.select("doc_id", F.slice("vector", 1, 2).alias("vector"))
    unit = rows[:, :2] / np.linalg.norm(rows[:, :2], axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 6)
    want = [(i, j, r, scores[i, j]) for i in range(120) for r, j in enumerate(sorted((j for j in range(120) if j != i), key=lambda j: (-scores[i, j], j))[:3], 1)]
    got = found(dense.dense_search(short.withColumnRenamed("doc_id", "query_id"), short, 3, exclude_same_id=True))
    assert sorted((q, r, round(s, 5)) for q, _, r, s in got) == sorted((q, r, round(float(s), 5)) for q, _, r, s in want)


def test_a_pass_of_queries_takes_little_memory(spark):
    # What a task holds of the queries of one pass: their vectors, who asks in which cell, and hits of each.
    assert pivots.QUERY_ELEMENTS * 8 <= 16 << 20 and pivots.QUERY_CELLS * 4 <= 16 << 20
    assert tiles.SCORE_CELLS * 8 <= 16 << 20 and dense.BROADCAST_ELEMENTS * 8 <= 16 << 20
    rows = spark.range(40_000).selectExpr("id AS query_id", "transform(sequence(1, 64), x -> rand(1)) AS vector")
    asked = rows.where("query_id < 33000").withColumn("query_id", F.col("query_id") + 100_000)
    index = pivots.pivot_index(rows.where("query_id < 50").withColumnRenamed("query_id", "doc_id"))
    hits = pivots.pivot_search(asked, index, 1)
    assert hits._jdf.queryExecution().analyzed().toString().count("Union") > 1
    assert hits.count() == 33_000
