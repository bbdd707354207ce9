from __future__ import annotations

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from qaloom import prompts
from qaloom.functions import chat, text


def values(spark, rows, schema, column):
    frame = spark.createDataFrame(rows, schema).withColumn("out", column)
    return [r.out for r in frame.collect()]


SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0       　"


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=SPACES + "ab[]é​", max_size=20), min_size=1, max_size=40))
def test_whitespace_rules_match_python(spark, texts):
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", text.strip_ws("t").alias("stripped"), text.words("t").alias("words"), text.truncate_words("t", 2).alias("cut")
    )
    for row in frame.collect():
        assert row.stripped == row.t.strip()
        assert row.words == row.t.split()
        assert row.cut == " ".join(row.t.split()[:2])


def test_truncate_keeps_exactly_the_limit(spark):
    long = " ".join(f"w{i}" for i in range(3100))
    cut = values(spark, [(long,), ("a  b",)], "t string", text.truncate_words("t"))
    assert cut[0].split() == long.split()[: prompts.MAX_QUERY_WORDS] and cut[1] == "a b"


def test_clean_response(spark):
    replies = [(" [doc12]Yes] ",), ("[doc1] B",), ("[maybe]",), ("[Doc3] no",), (" No.[doc4][doc]\n",)]
    assert values(spark, replies, "t string", text.clean_response("t")) == ["yes", "b", "maybe", "doc3 no", "no.doc"]


def test_options_keep_map_order(spark):
    frame = spark.sql("SELECT 'Q' AS q, map('C', 'three', 'A', 'one', 'B', NULL) AS o")
    plain = frame.select(text.render_options("q", F.map_filter("o", lambda k, v: v.isNotNull()))).first()[0]
    assert plain == "Q\nOptions:\nC) three\nA) one"


def test_context_functions(spark):
    row = spark.sql(
        """SELECT array(named_struct('text', 'a'), named_struct('text', NULL), named_struct('text', 'b')) AS s,
                  CAST(NULL AS ARRAY<STRUCT<text: STRING>>) AS none, array('x', 'y') AS c, CAST(NULL AS ARRAY<STRING>) AS cn,
                  'q' AS q, CAST(NULL AS STRING) AS qn,
                  array(named_struct('ANSWER', 'one'), named_struct('ANSWER', ''), named_struct('ANSWER', NULL),
                        named_struct('ANSWER', 'two')) AS answers"""
    ).select(
        text.join_snippets("s").alias("joined"),
        text.join_snippets("none").alias("nothing"),
        text.context_then_question("c", "q").alias("both"),
        text.context_then_question("cn", "q").alias("question"),
        text.context_then_question("c", "qn").alias("context"),
        text.reference_answers("answers").alias("answers"),
        text.user_content("q", F.lit("ctx")).alias("test"),
        text.user_content("q").alias("prefixed"),
        text.user_content("q", prefix=False).alias("bare"),
    ).first()
    assert row.asDict() == {
        "joined": "a  b",
        "nothing": "",
        "both": "x y q",
        "question": "q",
        "context": "x y",
        "answers": "one\ntwo",
        "test": "Question: q\nContext: ctx",
        "prefixed": "Question: q",
        "bare": "q",
    }


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        (["first", "second"], "first"),
        ([], None),
        ("plain text", "plain text"),
        ("[1] see [2]", "[1] see [2]"),
        (None, None),
        ("", None),
    ],
)
def test_first_answer(spark, raw, want):
    assert values(spark, [(json.dumps(raw),)], "t string", text.first_answer(F.parse_json("t"))) == [want]


def test_paper_url(spark):
    rows = [
        ("a/PMC1.xml.json; b/PMC2.xml.json", "p/x.json", "1"),
        (None, "docs/abc.json", "2"),
        (None, None, "3"),
        (None, None, None),
    ]
    urls = values(spark, rows, "pmc string, pdf string, s2 string", text.paper_url("pmc", "pdf", "s2"))
    assert urls == [
        "https://www.ncbi.nlm.nih.gov/pmc/articles/PMC1/",
        "https://www.ncbi.nlm.nih.gov/pmc/articles/abc/",
        "https://www.semanticscholar.org/paper/3",
        "",
    ]


def test_defaults(spark):
    row = spark.sql("SELECT CAST(NULL AS STRING) AS n, '' AS e, 'v' AS v").select(
        text.filled_or("n", "d").alias("a"),
        text.filled_or("e", "d").alias("b"),
        text.filled_or("v", "d").alias("c"),
        text.first_filled("e", "v").alias("d"),
        text.first_filled("n", "e").alias("e"),
        text.title_and_abstract("n", "v").alias("f"),
    ).first()
    assert tuple(row) == ("d", "d", "v", "v", "", " v")


def test_chat_and_prompts(spark):
    frame = spark.createDataFrame([("q", "c", "mc"), ("q", "c", "yesno"), ("q", "c", "ynm")], "q string, c string, k string")
    for use_rag, asked in ((True, "Question: q\n\nContext: c"), (False, "q")):
        rows = frame.select("k", chat.build_prompt("q", "c", F.lit(use_rag), F.col("k")).alias("m")).collect()
        assert {r.k: [tuple(m) for m in r.m] for r in rows} == {
            k: [("system", v), ("user", asked)] for k, v in prompts.CLOSE_ENDED_INSTRUCTIONS.items()
        }
    trained = frame.select(chat.to_chat("sys", "q", "c").alias("m")).select(
        F.size("m").alias("n"), *[chat.chat_field("m", r).alias(r) for r in ("system", "user", "assistant", "tool")]
    )
    assert tuple(trained.first()) == (3, "sys", "q", "c", "")
