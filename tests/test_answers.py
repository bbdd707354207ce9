from __future__ import annotations

import random
import time
import tracemalloc
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from qaloom.operators import answers, inference, lanes, overlap
from qaloom.plans.evaluate import long_form_scores, long_form_summary, prompts_with_and_without_context, run_close_ended


def pairs(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "pair_id bigint, answer string, prediction string")


def test_bleu_golden(spark):
    rows = [
        ("the cat sat on the mat", "the cat sat on a mat"),
        ("aspirin thins the blood", "aspirin may thin blood"),
        ("one two three four", "one two three four"),
        ("anything", ""),
        ("", "anything"),
        ("The cat", "the Cat"),
    ]
    got = {r.pair_id: r.bleu for r in overlap.bleu4(pairs(spark, rows)).collect()}
    want = {0: 0.537285, 1: 0.095544, 2: 1.0, 3: 0.0, 4: 0.0, 5: 0.0}
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}


def test_rouge_golden(spark):
    rows = [
        ("The cat sat on the mat.", "the cat sat on a mat"),
        ("Aspirin thins the blood", "blood: aspirin may thin"),
        ("", ""),
        ("same words here", "same words here"),
    ]
    frame = pairs(spark, rows)
    scored = {r.pair_id: (r.rouge1, r.rouge2, r.rougel) for r in long_form_scores(frame).collect()}
    want = {0: (0.833333, 0.6, 0.833333), 1: (0.5, 0.0, 0.25), 2: (0, 0, 0), 3: (1, 1, 1)}
    assert scored == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}
    separate = overlap.rouge_n(frame).where("n = 1").collect()
    assert {r.pair_id: r.f for r in separate} == {k: pytest.approx(v[0], abs=1e-6) for k, v in want.items()}
    assert {r.pair_id: r.bleu for r in overlap.bleu4(frame).collect()} == {
        r.pair_id: pytest.approx(r.bleu) for r in long_form_scores(frame).collect()
    }


def test_overlap_counts_rows_where_they_lie_and_shared_keys_together(spark, monkeypatch):
    monkeypatch.setattr(overlap, "COUNTED_TOKENS", 20)
    rng = random.Random(5)
    text = lambda: None if rng.random() < 0.1 else " ".join(rng.choices(["a", "b", "ab", "a b", "C"], k=rng.randint(0, 9)))
    rows = [(i, text(), text()) for i in range(60)] + [(k, text(), text()) for k in (3, 3, 7, None, None)]
    views = [("rouge", overlap.ascii_terms, (2, 1)), overlap.BLEU_VIEW]

    def by_hand(rows):
        want = {}
        for key in {r[0] for r in rows}:
            own = [r for r in rows if r[0] == key]
            for view, sizes in (("rouge", (2, 1)), ("bleu", (1, 2, 3, 4))):
                for n in sizes:
                    grams = []
                    for side in (1, 2):
                        words = [((r[side] or "").lower() if view == "rouge" else r[side] or "").split() for r in own]
                        grams.append(Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1)))
                    want[key, view, n] = ((grams[0] & grams[1]).total(), grams[0].total(), grams[1].total())
        return want

    for some in (rows, rows[:60]):
        frame = spark.createDataFrame(some, "k long, c string, r string").repartition(3)
        counts = overlap.clipped_matches(frame, "k", "c", "r", views)
        assert {(r.k, r["view"], r.n): (r.matches, r.candidate_grams, r.reference_grams) for r in counts.collect()} == by_hand(some)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan


def lcs_by_table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=30), st.lists(st.sampled_from("abcd"), max_size=30), st.integers(1, 9))
def test_lcs_matches_the_table_method(a, b, bits):
    assert overlap.lcs_length(a, b) == overlap.lcs_length(a, b, bits) == lcs_by_table(a, b)


def test_lcs_in_steps_of_tasks(spark):
    rng = random.Random(5)
    texts = [(" ".join(rng.choices("abcdefg", k=n)), " ".join(rng.choices("abcdefg", k=m))) for n, m in [(40, 33), (8, 90), (64, 8), (7, 7), (0, 50), (1, 1)]]
    rows = pairs(spark, [*texts, (None, "a b c")]).withColumn("pair_id", F.col("pair_id").cast("string"))
    whole = {r.pair_id: r.rougel for r in rows.withColumn("rougel", overlap.rouge_l("prediction", "answer")).collect()}
    stepped = overlap.rouge_l_rows(rows, "pair_id", "prediction", "answer", cells=60, step=8)
    assert stepped.columns == [*rows.columns, "rougel"]
    assert {r.pair_id: pytest.approx(r.rougel) for r in stepped.collect()} == whole
    assert {r.pair_id: r.rougel for r in overlap.rouge_l_rows(rows, "pair_id", "prediction", "answer").collect()} == whole


def test_steps_take_the_blocks_that_meet_alone(spark, monkeypatch):
    rng = random.Random(6)
    short = [(" ".join(rng.choices("abcd", k=8)), " ".join(rng.choices("abcd", k=8))) for _ in range(20)]
    texts = [(" ".join(rng.choices("abcd", k=20)), " ".join(rng.choices("abcd", k=12))), *short]
    rows = pairs(spark, texts).withColumn("pair_id", F.col("pair_id").cast("string"))
    staged = []
    original = overlap.stage
    monkeypatch.setattr(overlap, "stage", lambda df, label: staged.append((label, original(df, label))) or staged[-1][1])
    stepped = overlap.rouge_l_rows(rows, "pair_id", "prediction", "answer", cells=60, step=8)
    whole = rows.withColumn("rougel", overlap.rouge_l("prediction", "answer"))
    assert {r.pair_id: pytest.approx(r.rougel) for r in stepped.collect()} == {r.pair_id: r.rougel for r in whole.collect()}
    # Pairs of one step each are not cut for the joins, and a diagonal has the steps of one pair.
    assert {label: df.count() for label, df in staged if label in ("lcs-rows", "lcs-columns")} == {"lcs-rows": 2, "lcs-columns": 3}
    assert [df.count() for label, df in staged if label == "lcs-step"] == [21, 2, 2, 1]


def test_lcs_of_a_million_tokens_takes_little_memory():
    a, b = [str(i) for i in range(1_000_000)], [str(i) for i in range(500, 700)]
    tracemalloc.start()
    assert overlap.lcs_length(a, b) == 200
    assert tracemalloc.get_traced_memory()[1] < 100_000_000
    tracemalloc.stop()


def test_lcs_of_long_texts():
    rng = random.Random(3)
    a, b = ([str(rng.randrange(500)) for _ in range(1500)] for _ in range(2))
    assert overlap.lcs_length(a, b) == lcs_by_table(a, b)


@pytest.mark.parametrize("block", [2, 2048])
def test_greedy_match(spark, block):
    rows = [
        ("p", "candidate", 0, [1.0, 0.0]),
        ("p", "candidate", 1, [0.0, 1.0]),
        ("p", "candidate", 2, [1.0, 1.0]),
        ("p", "reference", 0, [1.0, 0.0]),
        ("p", "reference", 1, [2.0, 0.0]),
        ("p", "reference", 2, [0.0, -1.0]),
        ("lonely", "candidate", 0, [1.0, 0.0]),
    ]
    tokens = spark.createDataFrame(rows, "pair_id string, side string, position int, vector array<float>")
    got = {r.pair_id: r for r in overlap.greedy_match_f1(tokens, baseline=0.1, block=block).collect()}
    half = 0.5**0.5
    p, r = (1 + 0 + half) / 3, (1 + 1 + 0) / 3
    assert got["p"].precision == pytest.approx(p) and got["p"].recall == pytest.approx(r)
    assert got["p"].f1 == pytest.approx((2 * p * r / (p + r) - 0.1) / 0.9)
    assert got["lonely"].f1 == pytest.approx(-0.1 / 0.9)


def test_close_ended_scoring(spark):
    rows = [
        ("d", "m", True, " Yes", " [doc12]Yes] "),
        ("d", "m", True, "b", "[doc1] B"),
        ("d", "m", True, "maybe", "[maybe]"),
        ("d", "m", True, "no", "[Doc3] no"),
        ("d", "m", True, "yes", "error"),
        ("d", "m", True, None, "yes"),
        ("d", "m", True, "yes", None),
    ]
    frame = spark.createDataFrame(rows, "dataset string, model string, use_rag boolean, answer string, reply string")
    scored = answers.score_close_ended(frame)
    assert [(r.prediction, r.correct) for r in scored.collect()] == [
        ("yes", 1), ("b", 1), ("maybe", 1), ("doc3 no", 0), ("error", 0), ("yes", 0), (None, 0),
    ]
    total = answers.accuracy(scored).first()
    assert (total.questions, total.correct, total.without_gold, total.accuracy) == (7, 3, 1, round(3 / 7, 5))


def test_retries_only_failed_rows_and_waits_on_rate_limits(monkeypatch):
    waits, calls = [], []
    monkeypatch.setattr(inference.time, "sleep", waits.append)

    def predict(rows, _):
        calls.append([r["i"] for r in rows])
        if len(calls) == 1:
            raise inference.RateLimited()
        if len(calls) == 2:
            return ["zero", ValueError("no"), inference.RateLimited()]
        return [ValueError("still no") if r["i"] == 1 else f"late {r['i']}" for r in rows]

    rows = [{"i": i} for i in range(3)]
    replies, attempts = inference.answer_batch(rows, predict, {}, 5, "error", 2.0)
    assert replies == ["zero", "error", "late 2"]
    assert attempts == [2, 5, 3]
    assert calls == [[0, 1, 2], [0, 1, 2], [1, 2], [1], [1]]
    assert waits == [2.0, 4.0]


def test_one_bad_prompt_fails_alone():
    calls = []

    def predict(rows, _):
        calls.append(len(rows))
        if any(r["i"] == 3 for r in rows):
            raise RuntimeError("unreadable")
        return [f"reply {r['i']}" for r in rows]

    replies, attempts = inference.answer_batch([{"i": i} for i in range(8)], predict, {}, 5, "error", 0.0)
    assert replies == [f"reply {i}" if i != 3 else "error" for i in range(8)]
    assert attempts == [5 if i == 3 else 1 for i in range(8)]


def test_restart_with_null_keys_and_after_a_failed_wave(spark, tmp_path):
    rows = spark.createDataFrame([(None, "a"), *((i, f"t{i}") for i in range(20))], "id bigint, text string")
    path, asked = str(tmp_path / "waves"), str(tmp_path / "asked")

    def predict(rows, _):
        with open(asked, "a") as log:
            log.writelines(f"{r['text']}\n" for r in rows)
        return [r["text"].upper() for r in rows]

    def crash(frames):
        raise RuntimeError("the cluster went down")

    real = inference.generate
    waves = []

    def generate(todo, *args, **options):
        if len(waves) == 2:
            crash(todo)
        waves.append(todo)
        return real(todo, *args, **options)

    inference.generate = generate
    try:
        with pytest.raises(RuntimeError, match="went down"):
            inference.generate_to_table(rows, predict, ["text"], ["id"], path, waves=4)
    finally:
        inference.generate = real
    kept = spark.read.parquet(path).count()
    assert 0 < kept < 21
    table = inference.generate_to_table(rows, predict, ["text"], ["id"], path, waves=4)
    assert table.count() == 21
    assert inference.generate_to_table(rows, predict, ["text"], ["id"], path, waves=4).count() == 21
    assert len(open(asked).readlines()) == 21
    with pytest.raises(ValueError, match="more than one row"):
        inference.generate_to_table(rows.union(rows), predict, ["text"], ["id"], path)


def test_prompts_are_sent_in_small_calls(spark):
    def predict(rows, _):
        return [str(len(rows))] * len(rows)

    replies = inference.generate(spark.range(10).coalesce(1), predict, ["id"], batch_rows=4).collect()
    assert [r.reply for r in replies] == ["4"] * 8 + ["2"] * 2


def test_one_attempt_gives_the_error_text():
    def broken(rows, _):
        raise RuntimeError("down")

    assert inference.answer_batch([{"i": 0}], broken, {}, 1, "", 2.0) == ([""], [1])


def test_close_ended_run_end_to_end_and_restart(spark, tmp_path):
    questions = spark.createDataFrame(
        [("d", 1, "is it so", "Yes"), ("d", 2, "is it not", "no")],
        "dataset string, query_id bigint, question string, answer string",
    )
    corpus = spark.createDataFrame([(5, "proof")], "doc_id bigint, text string")
    hits = spark.createDataFrame([(1, 5, 1)], "query_id bigint, doc_id bigint, rank int")
    asked = prompts_with_and_without_context(questions, hits, corpus, ["m1", "m2"], "yesno")
    path = str(tmp_path / "replies")

    def predict(rows, settings):
        assert settings["max_tokens"] == 800
        return ["[doc1] YES" if "proof" in r["messages"][-1]["content"] else "no" for r in rows]

    scored, totals = run_close_ended(asked, predict, path)
    assert scored.count() == 8
    got = {(r.model, r.use_rag): r.accuracy for r in totals.collect()}
    assert got == {(m, rag): (1.0 if rag else 0.5) for m in ("m1", "m2") for rag in (True, False)}

    def forbidden(rows, settings):
        raise AssertionError("asked again")

    again, _ = run_close_ended(asked, forbidden, path)
    assert sorted(r.prediction for r in again.collect()) == sorted(r.prediction for r in scored.collect())


def test_unknown_question_type_is_an_error(spark):
    questions = spark.createDataFrame([(1, "q", "a")], "query_id bigint, question string, answer string")
    corpus = spark.createDataFrame([(5, "x")], "doc_id bigint, text string")
    hits = spark.createDataFrame([(1, 5, 1)], "query_id bigint, doc_id bigint, rank int")
    asked = prompts_with_and_without_context(questions, hits, corpus, ["m"], "essay")
    with pytest.raises(Exception, match="unsupported question type"):
        asked.select("messages").collect()


def test_long_form_summary(spark):
    rows = pairs(spark, [("a b c d", "a b c d"), ("a b c d", "x")]).withColumn("model", F.lit("m"))
    row = long_form_summary(long_form_scores(rows), ["model"]).first()
    assert (row.answers, row.rouge1, row.rougel, row.bleu) == (2, 0.5, 0.5, 0.5)


def test_model_score(spark):
    scored = inference.model_score(pairs(spark, [("aa", "a"), ("b", "b")]), lambda r, c: [len(x) / len(y) for x, y in zip(c, r)])
    assert sorted(r.model_score for r in scored.collect()) == [0.5, 1.0]


class Clock:
    def __init__(self):
        self.now = 1000.0

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.now += seconds + 1e-4


def test_lanes_share_a_budget_of_requests_and_tokens():
    budget = lanes.Budget(requests_per_minute=120, tokens_per_minute=1200, lanes=3)
    calls = []
    for number in range(3):
        clock = Clock()
        lane = lanes.Lane(number, budget, clock, clock.sleep)
        for i in range(40):
            cost = 25 if i % 2 else 5
            lane.take(cost)
            calls.append((clock.now, cost))
    calls.sort()
    # Never two in one slot of half a second, and tokens within the budget but for a request of each lane.
    assert all(b - a >= 0.49 for (a, _), (b, _) in zip(calls, calls[1:], strict=False))
    for start, _ in calls:
        window = [c for t, c in calls if start <= t < start + 20]
        assert len(window) <= 41 and sum(window) <= 1200 * 20 / 60 + 3 * 25


def test_a_run_keeps_to_its_budget_over_all_tasks(spark, tmp_path):
    def predict(rows, settings):
        stamp = time.time()
        if rows[0]["text"].endswith("7") and not (tmp_path / f"once-{rows[0]['text']}").exists():
            (tmp_path / f"once-{rows[0]['text']}").write_text("")
            (tmp_path / f"call-{stamp}-{rows[0]['text']}").write_text("")
            raise inference.RateLimited()
        (tmp_path / f"call-{stamp}-{rows[0]['text']}").write_text("")
        return [f"re {r['text']}" for r in rows]

    frame = spark.range(60).select(F.concat(F.lit("q"), "id").alias("text"))
    budget = lanes.Budget(requests_per_minute=1200, lanes=4)
    # All calls of the run, repeated ones included, share 20 requests a second.
    replies = inference.generate(frame, predict, ["text"], batch_rows=1, budget=budget, wait=0.01).collect()
    assert {r.text: r.reply for r in replies} == {f"q{i}": f"re q{i}" for i in range(60)}
    assert {r.text for r in replies if r.attempts == 2} == {f"q{i}" for i in range(7, 60, 10)}
    stamps = sorted(float(p.name.split("-")[1]) for p in tmp_path.glob("call-*"))
    assert len(stamps) == 66
    assert all(sum(s <= t < s + 1 for t in stamps) <= 21 for s in stamps)


def test_a_lane_is_several_tasks_where_there_are_cores(spark):
    asked = spark.range(400).selectExpr("id", "repeat('x', 100) AS text")
    budget = lanes.Budget(requests_per_minute=600_000, lanes=1)
    replies = inference.generate(asked, lambda rows, settings: ["ok"] * len(rows), ["text"], budget=budget)
    assert replies.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism > 1
    assert replies.where("reply = 'ok'").count() == 400
