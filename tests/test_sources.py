from __future__ import annotations

import json
import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from qaloom import prompts, schemas, session
from qaloom.catalog import files
from qaloom.operators.ranking import first_judgments
from qaloom.plans import prep
from qaloom.session import staged_so_far
from qaloom.sources import readers, writers


def put(folder, name, content):
    path = folder / name
    path.write_text(content, encoding="utf-8")
    return str(path)


def put_lines(folder, name, rows):
    return put(folder, name, "".join(json.dumps(r) + "\n" for r in rows))


BUNDLE = {
    "questions": [
        {"body": "Is A?", "exact_answer": "yes", "ideal_answer": ["long A", "other"], "snippets": [{"text": "s1"}, {}, {"text": "s2"}]},
        {"body": "List B", "exact_answer": [["x"], ["y"]], "ideal_answer": []},
        {"body": "Is C?", "exact_answer": "Yes", "ideal_answer": "plain C"},
        {"body": "Is D?", "exact_answer": "no", "snippets": []},
        {"exact_answer": "no", "ideal_answer": ["no body"]},
        {"body": "Open F", "ideal_answer": ["long F"], "extra": {"a": 1}},
    ]
}


@pytest.fixture
def questions(spark, tmp_path):
    return readers.read_question_bundle(spark, put(tmp_path, "bundle.json", json.dumps(BUNDLE, indent=1)))


def by_id(df, *columns):
    return {r.id: tuple(r[c] for c in columns) for r in df.collect()}


def messages(df):
    return [[(m.role, m.content) for m in r.messages] for r in df.collect()]


def test_bundle_positions(questions):
    rows = sorted(questions.collect(), key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(6))
    assert [r.exact_answer for r in rows if r.position != 1] == ["yes", "Yes", "no", "no", None]
    assert json.loads(rows[1].exact_answer) == [["x"], ["y"]]


def test_yes_no_training_rows(questions):
    train = prep.yes_no_qa(questions)
    assert by_id(train, "question", "answer") == {1: ("Is A?", "yes"), 4: ("Is D?", "no"), 5: (None, "no")}
    first = messages(train.where("id = 1"))[0]
    assert first == [("system", prompts.YES_NO_SYSTEM), ("user", "Is A?"), ("assistant", "yes")]


def test_yes_no_test_rows_have_context(questions):
    asked = {r.id: r.messages[1].content for r in prep.yes_no_qa(questions, include_context=True).collect()}
    assert asked[1] == "Question: Is A?\nContext: s1  s2"
    assert asked[4] == "Question: Is D?\nContext: "


def test_unified_variant_prefixes_training_rows(questions):
    row = prep.yes_no_qa(questions, False, True, prompts.YES_NO_SYSTEM_UNIFIED).where("id = 1").first()
    assert row.messages[1].content == "Question: Is A?"
    assert row.messages[0].content == prompts.YES_NO_SYSTEM_UNIFIED


def test_expert_answers(questions):
    got = by_id(prep.expert_answers(questions), "question", "answer")
    assert got == {1: ("Is A?", "long A"), 3: ("Is C?", "plain C"), 6: ("Open F", "long F")}


def test_several_bundles_are_numbered_in_path_order(spark, tmp_path):
    for i, size in enumerate((3, 1, 4)):
        put(tmp_path, f"b{i}.json", json.dumps({"questions": [{"body": f"{i}-{j}"} for j in range(size)]}))
    rows = readers.read_question_bundle(spark, str(tmp_path)).orderBy("position").collect()
    assert [r.body for r in rows] == ["0-0", "0-1", "0-2", "1-0", "2-0", "2-1", "2-2", "2-3"]
    assert [r.position for r in rows] == list(range(8))


KEYED = {
    "9": {"QUESTION": "Q9", "CONTEXTS": ["c1", "c2"], "LONG_ANSWER": "L9", "reasoning_required_pred": "yes", "final_decision": "yes"},
    "11": {"QUESTION": "Q11", "CONTEXTS": [], "LONG_ANSWER": "L11", "reasoning_required_pred": "yes", "final_decision": "maybe"},
    "10": {"QUESTION": "Q10", "CONTEXTS": ["c"], "reasoning_required_pred": "no", "final_decision": "yes"},
    "2": {"CONTEXTS": ["only"], "reasoning_required_pred": "yes", "final_decision": "no"},
    "3": {"QUESTION": "Q3", "reasoning_required_pred": "yes", "final_decision": "unsure"},
}


@pytest.fixture
def articles(spark, tmp_path):
    return readers.read_keyed_json(spark, put(tmp_path, "keyed.json", json.dumps(KEYED, indent=2)))


def test_keyed_json_keeps_file_order(articles):
    assert [r.key for r in articles.orderBy("position").collect()] == ["9", "11", "10", "2", "3"]


def test_article_questions(articles):
    asked = prep.article_qa(articles)
    assert by_id(asked, "question", "answer") == {1: ("Q9", "yes"), 2: ("Q11", "maybe"), 4: ("", "no")}
    assert {r.id: r.messages[1].content for r in asked.collect()} == {1: "c1 c2 Q9", 2: "Q11", 4: "only"}


def test_article_answers(articles):
    assert by_id(prep.article_answers(articles), "question", "answer") == {1: ("Q9", "L9"), 3: ("Q10", "")}


def test_multiple_choice(spark, tmp_path):
    rows = [
        {"question": "Which?", "options": {"B": "bee", "A": "ay", "D": "dee"}, "answer_idx": "A", "meta": "x"},
        {"question": "What?", "options": {"C": "see"}, "answer_idx": "C"},
    ]
    lines = readers.read_jsonl(spark, put_lines(tmp_path, "mc.jsonl", rows), schemas.MULTIPLE_CHOICE)
    prepared = prep.multiple_choice_qa(lines).collect()
    assert {r.question: r.messages[1].content for r in prepared} == {
        "Which?": "Which?\nOptions:\nB) bee\nA) ay\nD) dee",
        "What?": "What?\nOptions:\nC) see",
    }


def test_close_ended_in_one_call(spark, tmp_path, questions, articles):
    rows = [{"question": "Which?", "options": {"A": "ay"}, "answer_idx": "A"}]
    lines = readers.read_jsonl(spark, put_lines(tmp_path, "mc.jsonl", rows), schemas.MULTIPLE_CHOICE)
    prepared = prep.prepare_close_ended(questions, questions, articles, articles, {"train": lines, "val": lines, "test": lines})
    assert {k: v.count() for k, v in prepared.items()} == {
        ("yesno", "train"): 3, ("yesno", "test"): 3, ("ynm", "train"): 3, ("ynm", "test"): 3,
        ("mc", "train"): 1, ("mc", "val"): 1, ("mc", "test"): 1,
    }
    assert "id" not in prepared["yesno", "train"].columns and "id" not in prepared["ynm", "test"].columns


def test_consumer_questions(spark, tmp_path):
    first = [
        {"NLM_SUMMARY": "q1", "ANSWER": "a1"}, {"NLM_SUMMARY": "", "ANSWER": "a"},
        {"NLM_SUMMARY": "q", "ANSWER": ""}, {"ANSWER": "a"}, {"NLM_SUMMARY": "q2", "ANSWER": "a2"},
    ]
    second = [{"NLM_SUMMARY": "q1", "ANSWER": "a1"}, {"NLM_SUMMARY": "q4", "ANSWER": "a4"}]
    scans = [
        readers.read_jsonl(spark, put_lines(tmp_path, name, rows), schemas.CONSUMER_TRAIN, ordered=True)
        for name, rows in (("z_first.jsonl", first), ("a_second.jsonl", second))
    ]
    assert by_id(prep.consumer_train(scans), "question", "answer") == {
        1: ("q1", "a1"), 2: ("q2", "a2"), 3: ("q1", "a1"), 4: ("q4", "a4")
    }
    test = [
        {"NLM_SUMMARY": "t1", "REFERENCE_ANSWERS": [{"ANSWER": ""}, {"ANSWER": "x"}, {}, {"ANSWER": "y"}]},
        {"NLM_SUMMARY": "t2", "REFERENCE_ANSWERS": [{"ANSWER": ""}]},
        {"NLM_SUMMARY": "t3"},
    ]
    lines = readers.read_jsonl(spark, put_lines(tmp_path, "test.jsonl", test), schemas.CONSUMER_TEST, ordered=True)
    assert [(r.question, r.answer) for r in prep.consumer_test(lines).collect()] == [("t1", "x\ny")]


def test_medication_split(spark, tmp_path):
    rows = [(f"q{i}, \"quoted\"", f"line one\nline {i}") for i in range(11)] + [(None, "a"), ("q", None)]
    path = str(tmp_path / "med")
    writers.write_qa_csv(spark.createDataFrame(rows, schemas.MEDICATION), path)
    prepared = prep.medication_qa(readers.read_qa_csv(spark, path, schemas.MEDICATION)).collect()
    sizes = {s: sorted(r.id for r in prepared if r.split == s) for s in ("train", "test")}
    assert sizes == {"train": list(range(1, 10)), "test": [1, 2]}
    assert {(r.question, r.answer) for r in prepared} == set(rows[:11])


def test_passages(spark, tmp_path):
    path = put(tmp_path, "train.docs", "MED-1\tfirst text, with \"quotes\"\nMED-2\tsecond ' text\n")
    prepared = prep.passage_qa(readers.read_id_text_tsv(spark, path))
    folder = str(tmp_path / "out")
    prep.write_prepared(prepared, folder, "train")
    prep.write_prepared(prepared, folder, "test", with_id=False)
    back = readers.read_qa_csv(spark, f"{folder}/train.csv", "id STRING, question STRING, answer STRING").collect()
    assert {r.id: r.question for r in back} == {"MED-1": 'first text, with "quotes"', "MED-2": "second ' text"}
    assert all(r.question == r.answer for r in back)
    assert spark.read.option("header", True).csv(f"{folder}/test.csv").columns == ["question", "answer"]
    assert readers.read_jsonl(spark, f"{folder}/train.jsonl", schemas.CHAT).count() == 2


METADATA = [
    ("u1", "T1", "A, with \"quotes\"\nand lines", "p/x.json", "p/PMC1.xml.json; p/PMC2.xml.json", "1"),
    ("u2", "T2", None, "p/abc.json", None, "22"),
    ("u3", None, "A3", None, None, "333"),
    ("u4", "T4", "A4", None, None, None),
    ("u4", "T4b", "A4b", None, None, None),
    ("u9", "unjudged", "x", None, None, None),
]


def test_judged_corpus(spark, tmp_path):
    path = str(tmp_path / "metadata")
    writers.write_qa_csv(spark.createDataFrame(METADATA, schemas.CORPUS_METADATA), path)
    metadata = readers.read_qa_csv(spark, path, schemas.CORPUS_METADATA)
    ids = readers.read_id_list(spark, put(tmp_path, "ids.txt", "u1\n u2 \nu3\nu4\nu4\n"))
    out = str(tmp_path / "corpus")
    writers.write_corpus_jsonl(prep.judged_corpus_records(metadata, ids), out)
    rows = sorted(tuple(r[:3]) + (r.metadata.url,) for r in readers.read_jsonl(spark, out, schemas.CORPUS).collect())
    pmc = "https://www.ncbi.nlm.nih.gov/pmc/articles/"
    assert rows == [
        ("u1", "T1", 'A, with "quotes"\nand lines', f"{pmc}PMC1/"),
        ("u2", "T2", "No abstract available", f"{pmc}abc/"),
        ("u3", "Unknown", "A3", "https://www.semanticscholar.org/paper/333"),
        ("u4", "T4", "A4", ""),
        ("u4", "T4b", "A4b", ""),
    ]
    chunks = str(tmp_path / "chunks")
    writers.write_chunked(prep.judged_corpus_texts(metadata, ids), chunks, ["id", "title"], size=2)
    back = readers.read_qa_csv(spark, chunks, "id STRING, title STRING, part INT")
    assert sorted((r.part, r.id) for r in back.collect()) == [(1, "u1"), (1, "u2"), (2, "u3"), (2, "u4"), (3, "u4")]
    assert {r.title for r in back.where("id = 'u3'").collect()} == {" A3"}


def test_topics(spark, tmp_path):
    xml = """<topics task="x">
<topic number="1"><query>virus origin</query><question>what is &lt;it&gt;</question><narrative>seeking</narrative></topic>
<topic number="2"><query>weather</query><question></question></topic>
</topics>"""
    rows = readers.read_topics_xml(spark, put(tmp_path, "topics.xml", xml)).orderBy("query_id").collect()
    assert [tuple(r) for r in rows] == [("1", "virus origin", "what is <it>", "seeking"), ("2", "weather", "", "")]


def test_topic_texts_keep_their_blanks(spark, tmp_path):
    xml = '<topics><topic number="1"><query> padded </query><question>a\n b</question></topic></topics>'
    row = readers.read_topics_xml(spark, put(tmp_path, "topics.xml", xml)).first()
    assert (row["query"], row.question, row.narrative) == (" padded ", "a\n b", "")


def test_qrels_first_judgment_in_file_order(spark, tmp_path):
    path = put(tmp_path, "qrels.txt", "1 0.5 a 2\n1 1 b 1\n1 1 c 0\n1 2 d -1\n1 3 b 2\n2 0 a 1\n")
    lines = readers.read_qrels(spark, path, ordered=True)
    judged = first_judgments(lines, F.struct(*readers.ORDER_COLUMNS)).collect()
    assert {(r.query_id, r.doc_id): r.relevance for r in judged} == {
        ("1", "a"): 2, ("1", "b"): 1, ("1", "c"): 0, ("1", "d"): -1, ("2", "a"): 1
    }


def test_csv_missing_values(spark, tmp_path):
    path = put(tmp_path, "qa.csv", 'question,answer\n"a, ""b""\nc",NA\nd,\n" e ",None\n')
    rows = readers.read_qa_csv(spark, path).collect()
    assert [tuple(r) for r in rows] == [('a, "b"\nc', "NA"), ("d", None), (" e ", "None")]
    strict = readers.read_qa_csv(spark, path, na_values=["NA", "None"]).collect()
    assert [r.answer for r in strict] == [None, None, None]


def test_chat_jsonl_round_trip(spark, tmp_path):
    path = str(tmp_path / "chat")
    rows = [([("system", "s"), ("user", "ü \"x\"\n"), ("assistant", None)],)]
    writers.write_chat_jsonl(spark.createDataFrame(rows, schemas.CHAT), path)
    lines = spark.read.text(path).collect()
    assert [json.loads(r.value) for r in lines] == [
        {"messages": [{"role": r, "content": c} for r, c in rows[0][0]]}
    ]


def test_results_replace_their_own_run_only(spark, tmp_path):
    path = str(tmp_path / "results")
    schema = "task string, dataset string, model string, use_rag boolean, score double"
    writers.write_results(spark.createDataFrame([("t", "d", "m", True, 0.1), ("t", "d", "m", False, 0.2)], schema), path)
    writers.write_results(spark.createDataFrame([("t", "d", "m", True, 0.9)], schema), path)
    back = spark.read.parquet(path)
    assert sorted((r.use_rag, r.score) for r in back.collect()) == [("false", 0.2), ("true", 0.9)] or sorted(
        (r.use_rag, r.score) for r in back.collect()
    ) == [(False, 0.2), (True, 0.9)]
    assert all(len(r.run_date) == 8 for r in back.collect())


def test_experiment_config(spark):
    rows = readers.experiment_config(spark, [{"task": "t", "dataset": "d", "models": ["a", "b"]}]).collect()
    assert rows[0].models == ["a", "b"] and rows[0].path is None


@pytest.fixture
def raw_tables(spark, tmp_path):
    """Documents of random words in lines, some of them labelled, as the tables that the queries read."""
    rng = random.Random(5)
    texts = ["\n".join(" ".join(f"{rng.randrange(1 << 32):x}" for _ in range(20)) for _ in range(10)) for _ in range(450)]
    documents = [(i, text, f"src{i % 3}", "en") for i, text in enumerate(texts)]
    labels = [(i, i % 2) for i in range(0, 450, 4)]
    spark.createDataFrame(documents, "doc_id bigint, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, texts[0])], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), texts


def bytes_written(spark, query, folder):
    """Rows of a query and the bytes of all that it left in the scratch folder."""
    since = staged_so_far(spark)
    rows = query(spark, folder).collect()
    paths = [Path(p.removeprefix("file:")) for p in session._made[spark.sparkContext.applicationId][since:]]
    return rows, sum(f.stat().st_size for p in paths for f in p.rglob("*") if f.is_file())


def test_keyed_articles_take_little_room_on_the_way(spark, raw_tables):
    folder, texts = raw_tables
    rows, size = bytes_written(spark, files.keyed_json_scan, folder)
    assert [(r.position, r.key, r.text) for r in sorted(rows, key=lambda r: r.position)] == [(i, str(i), t) for i, t in enumerate(texts)]
    # The numbered table, the files (texts and their reverse) and the records: 2.9 times the texts, where it was 4.9 times.
    assert size < 3.5 * sum(map(len, texts))


def test_passage_tables_take_little_room_on_the_way(spark, raw_tables):
    folder, texts = raw_tables
    rows, size = bytes_written(spark, files.prep_passage_tables, folder)
    assert Counter(r.name for r in rows) == {"train": 450, "test": 450, "test_queries": 1, "query_ids": 1}
    # 4.1 times the texts, where it was 10.5 times.
    assert size < 5 * sum(map(len, texts))
