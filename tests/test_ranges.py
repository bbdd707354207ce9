"""Single files in many byte ranges: records over borders, with escapes, braces, quotes and multi-byte text."""

from __future__ import annotations

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from qaloom.sources import ranges, readers

TEXTS = ['plain', '{"a": [1, 2}', '}}}', '"quoted" \\ back', "]},{[", "漢字}ü\n\t", "", "\\", '\\"}', "x" * 90, 'a, "b"']


@pytest.fixture
def tiny(spark):
    """Files are cut into ranges of a few bytes."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")

    def set_(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)

    yield set_
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def question(rng):
    q = {"body": rng.choice(TEXTS), "exact_answer": rng.choice(TEXTS), "snippets": [{"text": rng.choice(TEXTS)} for _ in range(rng.randrange(3))]}
    return q | ({"extra": {"deep": [{"x": rng.choice(TEXTS)}]}} if rng.random() < 0.3 else {})


def bundle(rng, n):
    questions = [None if rng.random() < 0.1 else question(rng) for _ in range(n)]
    root = {"version": rng.choice(TEXTS)} if rng.random() < 0.5 else {}
    root |= {"before": [question(rng) for _ in range(rng.randrange(3))]} if rng.random() < 0.5 else {}
    root["questions"] = questions
    root |= {"more": [question(rng)], "other": {"questions": [question(rng)]}} if rng.random() < 0.7 else {}
    return root


def write(path, value, rng):
    style = rng.choice([{}, {"indent": 2}, {"separators": (",", ":")}])
    path.write_text(json.dumps(value, ensure_ascii=rng.random() < 0.5, **style) + rng.choice(["", "\n", " \n\n"]), encoding="utf-8")


SCHEMA = "body STRING, exact_answer STRING, snippets ARRAY<STRUCT<text: STRING>>"


@pytest.mark.parametrize("size", [90, 1 << 20])
def test_bundles_over_many_ranges(spark, tmp_path, tiny, size):
    tiny(size)
    rng = random.Random(size)
    values = [bundle(rng, n) for n in (0, 1, 5, 17)]
    for i, value in enumerate(values):
        write(tmp_path / f"{i}.json", value, rng)
    got = readers.read_question_bundle(spark, str(tmp_path), SCHEMA).orderBy("position").collect()
    want = [q for value in values for q in value["questions"]]
    assert [r.position for r in got] == list(range(len(want)))
    for row, q in zip(got, want, strict=True):
        if q is None:
            assert row.body is None and row.snippets is None
        else:
            assert (row.body, row.exact_answer, [s.text for s in row.snippets]) == (q["body"], q["exact_answer"], [s["text"] for s in q["snippets"]])


@pytest.mark.parametrize("size", [80, 1 << 20])
def test_keyed_objects_over_many_ranges(spark, tmp_path, tiny, size):
    tiny(size)
    rng = random.Random(size)
    files = []
    for i, n in enumerate((0, 1, 20)):
        files.append([(rng.choice(TEXTS) + str(j % 13), None if rng.random() < 0.1 else {"QUESTION": rng.choice(TEXTS), "n": [{"m": {}}]}) for j in range(n)])
        body = ", ".join(f"{json.dumps(k, ensure_ascii=False)}: {json.dumps(v)}" for k, v in files[-1])
        (tmp_path / f"{i}.json").write_text("{" + body + "}", encoding="utf-8")
    got = readers.read_keyed_json(spark, str(tmp_path), "QUESTION STRING").orderBy("position").collect()
    want = []
    for entries in files:
        want += list(dict(entries).items())
    assert [(r.key, r.QUESTION) for r in got] == [(k, v and v["QUESTION"]) for k, v in want]
    assert [r.position for r in got] == list(range(len(want)))


@pytest.mark.parametrize("size", [70, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_csv_over_many_ranges(spark, tmp_path, tiny, size, end):
    tiny(size)
    rng = random.Random(size)
    cells = ["plain", 'say "hi"', "a,b", "two\nlines", '"', '"\n"', "漢字\nü", "x" * 70, "1"]
    rows = []
    for i, n in enumerate((0, 1, 40)):
        own = [(rng.choice(cells), rng.choice(cells), i * 100 + j) for j in range(n)]
        text = io.StringIO()
        writer = csv.writer(text, lineterminator=end)
        writer.writerow(["question", "answer", "id"])
        writer.writerows(own)
        (tmp_path / f"{i}.csv").write_bytes(text.getvalue().encode())
        rows += own
    got = readers.read_qa_csv(spark, str(tmp_path), "question STRING, answer STRING, id BIGINT", na_values=["plain"])
    assert got.where("question = 'plain' OR answer = 'plain'").count() == 0
    found = sorted((r.id, r.question, r.answer) for r in got.na.fill("plain").collect())
    assert found == sorted((i, q, a) for q, a, i in rows)


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path, tiny):
    tiny(2000)
    rng = random.Random(1)
    write(tmp_path / "one.json", {"questions": [question(rng) for _ in range(300)]}, rng)
    records = ranges.read_records(spark, str(tmp_path), ranges.JsonCutter("questions"))
    assert records.select("_range").distinct().count() > 10
    # What is left before the end of the array is blank.
    assert records.where(F.col("text").rlike(r"\S")).count() == 300
    assert records.where(F.col("_part") == 0).count() > 5


def test_a_header_that_does_not_fit_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("answer,question\n1,2\n")
    with pytest.raises(Exception, match="header"):
        readers.read_qa_csv(spark, str(tmp_path), "question STRING, answer STRING").collect()


def test_a_field_of_the_root_need_not_come_first_nor_exist(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x": {"questions": [{"body": "no"}]}, "questions": [], "y": [{"body": "no"}]}')
    (tmp_path / "b.json").write_text('{"y": [{"body": "no"}], "z": "questions", "w": [{"body": "no"}]}')
    (tmp_path / "c.json").write_text("{}")
    (tmp_path / "d.json").write_text("")
    assert readers.read_question_bundle(spark, str(tmp_path), SCHEMA).count() == 0


def test_csv_columns_that_folders_name(spark, tmp_path):
    for part in (1, 2):
        (tmp_path / f"part={part}").mkdir()
        (tmp_path / f"part={part}" / "a.csv").write_text(f'id,title\n{part},"two\nlines"\n')
    got = readers.read_qa_csv(spark, str(tmp_path), "id BIGINT, title STRING, part INT").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "two\nlines", 1), (2, "two\nlines", 2)]
