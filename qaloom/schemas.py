"""One explicit schema per raw source, as DDL; nothing is inferred and ids stay strings."""

# exact_answer is a string for yes/no questions and a list for others; as STRING a list arrives as JSON text.
# ideal_answer is a list, sometimes a plain text; as VARIANT either stays what it is.
YES_NO_QUESTION = "body STRING, exact_answer STRING, ideal_answer VARIANT, snippets ARRAY<STRUCT<text: STRING>>"
KEYED_ARTICLE = (
    "QUESTION STRING, CONTEXTS ARRAY<STRING>, LONG_ANSWER STRING, reasoning_required_pred STRING, final_decision STRING"
)
MULTIPLE_CHOICE = "question STRING, options MAP<STRING, STRING>, answer_idx STRING"
CONSUMER_TRAIN = "NLM_SUMMARY STRING, ANSWER STRING"
CONSUMER_TEST = "NLM_SUMMARY STRING, REFERENCE_ANSWERS ARRAY<STRUCT<ANSWER: STRING>>"
MEDICATION = "Question STRING, Answer STRING"
ID_TEXT = "id STRING, text STRING"
CORPUS_METADATA = (
    "cord_uid STRING, title STRING, abstract STRING, pdf_json_files STRING, pmc_json_files STRING, s2_id STRING"
)
TOPIC = "_number STRING, query STRING, question STRING, narrative STRING"
QRELS = "query_id STRING, iteration STRING, doc_id STRING, relevance INT"
QA_PAIR = "question STRING, answer STRING"
QA_PAIR_WITH_ID = "id BIGINT, question STRING, answer STRING"
CHAT = "messages ARRAY<STRUCT<role: STRING, content: STRING>>"
CORPUS = "_id STRING, title STRING, text STRING, metadata STRUCT<url: STRING>"
EXPERIMENT = (
    "task STRING, dataset STRING, path STRING, question_type STRING, models ARRAY<STRING>, "
    "query_id_col STRING, query_text_col STRING, doc_id_col STRING, relevance_col STRING"
)
