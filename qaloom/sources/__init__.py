from qaloom.sources.readers import (
    experiment_config,
    line_order,
    read_id_list,
    read_id_text_tsv,
    read_jsonl,
    read_keyed_json,
    read_qa_csv,
    read_qrels,
    read_question_bundle,
    read_topics_xml,
)
from qaloom.sources.writers import (
    write_chat_jsonl,
    write_chunked,
    write_corpus_jsonl,
    write_qa_csv,
    write_results,
)

__all__ = [
    "experiment_config",
    "line_order",
    "read_id_list",
    "read_id_text_tsv",
    "read_jsonl",
    "read_keyed_json",
    "read_qa_csv",
    "read_qrels",
    "read_question_bundle",
    "read_topics_xml",
    "write_chat_jsonl",
    "write_chunked",
    "write_corpus_jsonl",
    "write_qa_csv",
    "write_results",
]
