"""Sources, sinks and dataset preparation, over raw files that Spark writes from the driver tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qaloom import prompts, schemas
from qaloom.catalog.chats import quoted
from qaloom.catalog.rows import SQL_PAGES, SQL_URL, page_metadata
from qaloom.catalog.tables import SQL_PAIRS, SQL_QRELS, SQL_WHOLE_QUERIES, json_text, qa_pairs, qrels, questions, sql_strip, table
from qaloom.functions.chat import chat_field, to_chat
from qaloom.operators.numbering import global_index
from qaloom.operators.ranking import first_judgments
from qaloom.plans import prep
from qaloom.session import scratch_path
from qaloom.sources import readers, writers

# Entries per root object: a collection of any size arrives as many bounded files.
BUNDLE_ROWS = 200
# Raw files repeat texts and are many, so they are compressed; each is read by one task.
RAW_COMPRESSION = "gzip"


# --- Raw files -------------------------------------------------------------------------------------------------------


def write_bundles(numbered: DataFrame, entry: Column, head: str, tail: str, path: str) -> None:
    """Root objects of at most ``BUNDLE_ROWS`` entries in the order of ``idx``, one file each, files in path order."""
    shard = F.lpad(F.floor(F.col("idx") / BUNDLE_ROWS).cast("string"), 10, "0")
    # The rows are shuffled, not the entries, in which their texts come twice.
    placed = numbered.withColumn("shard", shard).repartition("shard")
    placed = placed.select("shard", F.struct("idx", entry.alias("entry")).alias("e"))
    entries = F.transform(F.sort_array(F.collect_list("e")), lambda e: e["entry"])
    bundles = placed.groupBy("shard").agg(
        F.concat(F.lit(head), F.array_join(entries, ", "), F.lit(tail)).alias("value")
    )
    bundles.write.partitionBy("shard").text(path, compression=RAW_COMPRESSION)


def in_order(df: DataFrame, *keys: str) -> DataFrame:
    """Rows in the order of a key over the files that will be written."""
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def numbered_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels, and their numbers in the order of their ids."""
    documents = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return global_index(documents, ["doc_id"])


def document_questions(documents: DataFrame) -> DataFrame:
    """Documents as questions. Labels give yes/no; unlabelled documents have other kinds of answers or none."""
    kind = F.pmod("doc_id", F.lit(3))
    exact = (
        F.when(F.col("quality") == 1, '"yes"')
        .when(F.col("quality") == 0, '"no"')
        .when(kind == 0, '"Yes"')
        .when(kind == 1, '["yes"]')
    )
    return documents.withColumn("exact", exact)


def question_files(spark: SparkSession, sf_dir: str, numbered: DataFrame | None = None) -> str:
    """Question bundles: body, exact answer (text, list or absent), ideal answers, lines as snippets."""
    numbered = numbered_documents(spark, sf_dir) if numbered is None else numbered
    path = scratch_path(spark, "bundles")
    kind = F.pmod("doc_id", F.lit(4))
    ideal = (
        F.when(kind == 0, F.lit("[]"))
        .when(kind == 1, F.to_json(F.array(F.concat_ws(" ", "lang", "source"), F.col("text"))))
        .when(kind == 2, F.concat(F.lit('"'), F.col("source"), F.lit('"')))
    )
    snippets = F.transform(F.split("text", "\n"), lambda line: F.struct(line.alias("text")))
    fields = [
        F.concat(F.lit('"body": '), json_text("text")),
        F.concat(F.lit('"exact_answer": '), F.col("exact")),
        F.concat(F.lit('"ideal_answer": '), ideal),
        F.when(kind != 3, F.concat(F.lit('"snippets": '), F.to_json(snippets))),
    ]
    entry = F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}"))
    write_bundles(document_questions(numbered), entry, '{"questions": [', "]}", path)
    return path


def article_files(spark: SparkSession, sf_dir: str, numbered: DataFrame | None = None) -> str:
    """Articles keyed by document id: question, lines as contexts, decision and reasoning flag."""
    numbered = numbered_documents(spark, sf_dir) if numbered is None else numbered
    path = scratch_path(spark, "keyed")
    decision = F.when(F.col("quality") == 1, "yes").when(F.col("quality") == 0, "no").when(
        F.pmod("doc_id", F.lit(2)) == 0, "maybe"
    )
    value = F.to_json(
        F.struct(
            F.concat_ws(" ", F.lit("What says"), "source", F.lit("in"), "lang").alias("QUESTION"),
            F.split("text", "\n").alias("CONTEXTS"),
            F.reverse("text").alias("LONG_ANSWER"),
            F.when(F.pmod("doc_id", F.lit(5)) != 0, "yes").otherwise("no").alias("reasoning_required_pred"),
            decision.alias("final_decision"),
        )
    )
    entry = F.concat(F.lit('"'), F.col("doc_id"), F.lit('": '), value)
    write_bundles(numbered, entry, "{", "}", path)
    return path


# --- Scans -----------------------------------------------------------------------------------------------------------


def bundle_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question bundles read back, numbered over all files."""
    questions = readers.read_question_bundle(spark, question_files(spark, sf_dir))
    return questions.select(
        "position", "body", "exact_answer", F.coalesce(F.size("snippets"), F.lit(-1)).alias("snippets")
    )


def keyed_json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed articles read back in file order."""
    articles = readers.read_keyed_json(spark, article_files(spark, sf_dir))
    return articles.select("position", "key", "QUESTION", F.array_join("CONTEXTS", "\n").alias("text"), "final_decision")


def one_line(column: str) -> Column:
    """Text without line breaks and tabs, for line formats."""
    return F.regexp_replace(column, "[\t\n]+", " ")


def passage_file(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "tsv")
    documents = table(spark, sf_dir, "documents").select("doc_id", one_line("text").alias("text"))
    writer = in_order(documents, "doc_id").write.option("sep", "\t").option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path, compression=RAW_COMPRESSION)
    return path


def tsv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents from a headerless tab-separated file."""
    return readers.read_id_text_tsv(spark, passage_file(spark, sf_dir))


def qrels_file(spark: SparkSession, sf_dir: str) -> str:
    """Judgments as blank-separated lines; each pair is judged once more, lower, further down the file."""
    path = scratch_path(spark, "qrels")
    judged = qrels(spark, sf_dir)
    twice = judged.select("*", F.lit(0).alias("again")).unionByName(
        judged.select("query_id", "doc_id", (F.col("relevance") - 2).alias("relevance"), F.lit(1).alias("again"))
    )
    lines = in_order(twice, "again", "query_id", "doc_id")
    lines.select(F.concat_ws(" ", "query_id", F.lit("0"), "doc_id", "relevance")).write.text(path)
    return path


def qrels_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgments from a blank-separated file, the first per pair in file order."""
    lines = readers.read_qrels(spark, qrels_file(spark, sf_dir), ordered=True)
    return first_judgments(lines, F.struct(*readers.ORDER_COLUMNS))


def topics_file(spark: SparkSession, sf_dir: str) -> str:
    """Passages as topics; every third has no narrative, every second an empty question."""
    path = scratch_path(spark, "topics")
    topics = questions(spark, sf_dir).select(
        F.col("query_id").cast("string").alias("_number"),
        "query",
        F.when(F.pmod("query_id", F.lit(2)) == 0, F.lit("")).otherwise(F.reverse("query")).alias("question"),
        F.when(F.pmod("query_id", F.lit(3)) != 0, F.concat(F.lit("<About> "), F.col("query"))).alias("narrative"),
    )
    topics.write.format("xml").option("rowTag", "topic").option("rootTag", "topics").save(path)
    return path


def topics_xml_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics from an XML file."""
    return readers.read_topics_xml(spark, topics_file(spark, sf_dir))


def id_list_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled ids from a line file with blanks around them and every id twice, as a set."""
    path = scratch_path(spark, "ids")
    ids = table(spark, sf_dir, "labels").select(F.concat(F.lit(" \t"), F.col("doc_id"), F.lit("  ")).alias("value"))
    ids.unionByName(ids).write.text(path)
    return readers.read_id_list(spark, path)


# --- Round trips -----------------------------------------------------------------------------------------------------


def chat_jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as JSON lines and read back."""
    path = scratch_path(spark, "chat")
    pairs = qa_pairs(spark, sf_dir)
    writers.write_chat_jsonl(pairs.select(to_chat(prompts.EXPLAIN_SYSTEM, "question", "answer").alias("messages")), path)
    back = readers.read_jsonl(spark, path, schemas.CHAT)
    return back.select(
        *[chat_field("messages", role).alias(role) for role in ("system", "user", "assistant")],
        F.size("messages").alias("turns"),
    )


def qa_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (quotes, commas and line breaks included) written as CSV and read back."""
    path = scratch_path(spark, "qa")
    documents = table(spark, sf_dir, "documents")
    pairs = documents.select(
        F.col("doc_id").alias("id"), "text", F.when(F.pmod("doc_id", F.lit(7)) != 0, F.col("source"))
    ).toDF("id", "question", "answer")
    writers.write_qa_csv(pairs, path)
    return readers.read_qa_csv(spark, path, schemas.QA_PAIR_WITH_ID, na_values=["src3"])


def corpus_jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus records written as JSON lines and read back."""
    path = scratch_path(spark, "corpus")
    pages = page_metadata(spark, sf_dir).withColumn("url", F.concat(F.lit("id:"), F.col("cord_uid")))
    writers.write_corpus_jsonl(writers.corpus_records(pages, "cord_uid", "title", "abstract", "url"), path)
    return readers.read_jsonl(spark, path, schemas.CORPUS).select("_id", "title", "text", F.col("metadata.url").alias("url"))


def results_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows written by run and read back; a run written twice replaces itself."""
    path = scratch_path(spark, "results")
    labels = table(spark, sf_dir, "labels")
    rows = labels.select(
        F.lit("close-ended").alias("task"),
        F.when(F.col("toxic") == 1, "flagged").otherwise("plain").alias("dataset"),
        F.lit("base").alias("model"),
        (F.col("quality") == 1).alias("use_rag"),
        "doc_id",
    )
    writers.write_results(rows.withColumn("correct", F.lit(0)), path)
    writers.write_results(rows.where(F.col("dataset") == "plain").withColumn("correct", F.lit(1)), path)
    back = spark.read.schema(
        "doc_id BIGINT, correct INT, run_date STRING, task STRING, dataset STRING, model STRING, use_rag BOOLEAN"
    ).parquet(path)
    dated = (F.length("run_date") == 8).cast("int").alias("dated")
    return back.select("task", "dataset", "model", "use_rag", "doc_id", "correct", dated)


def chunked_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as consecutive CSV parts of 100 rows, read back."""
    path = scratch_path(spark, "chunks")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    writers.write_chunked(pages, path, ["page_id"], size=100)
    return spark.read.option("header", True).option("escape", '"').schema("page_id BIGINT, url STRING, part INT").csv(path)


# --- Dataset preparation ---------------------------------------------------------------------------------------------


def flat(prepared: DataFrame, *extra: str) -> DataFrame:
    """Prepared rows with their conversation as columns."""
    return prepared.select(
        *extra,
        "question",
        "answer",
        chat_field("messages", "system").alias("system"),
        chat_field("messages", "user").alias("user"),
        chat_field("messages", "assistant").alias("assistant"),
    )


def with_split(split: str, prepared: DataFrame) -> DataFrame:
    return prepared.withColumn("split", F.lit(split))


def prep_yes_no(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yes/no questions as training rows (bare body) and test rows (with context)."""
    questions = readers.read_question_bundle(spark, question_files(spark, sf_dir))
    train = with_split("train", flat(prep.yes_no_qa(questions), "id"))
    return train.unionByName(with_split("test", flat(prep.yes_no_qa(questions, include_context=True), "id")))


def prep_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yes/no/maybe questions over articles."""
    return flat(prep.article_qa(readers.read_keyed_json(spark, article_files(spark, sf_dir))), "id")


def choice_file(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "choices")
    options = F.map_from_arrays(
        F.array(*[F.lit(c) for c in "DABC"]),
        F.array("p_type", "p_brand", F.col("p_size").cast("string"), F.col("p_retailprice").cast("int").cast("string")),
    )
    lines = table(spark, sf_dir, "part").select(
        F.col("p_name").alias("question"),
        options.alias("options"),
        F.when(F.col("p_size") > 25, "A").otherwise("D").alias("answer_idx"),
    )
    lines.write.json(path)
    return path


def prep_multiple_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiple-choice questions from JSON lines."""
    lines = readers.read_jsonl(spark, choice_file(spark, sf_dir), schemas.MULTIPLE_CHOICE)
    return flat(prep.multiple_choice_qa(lines), "question_with_options")


def prep_close_ended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three close-ended sets in one call: entries and characters per set and split."""
    numbered = numbered_documents(spark, sf_dir)
    questions = readers.read_question_bundle(spark, question_files(spark, sf_dir, numbered))
    articles = readers.read_keyed_json(spark, article_files(spark, sf_dir, numbered))
    lines = readers.read_jsonl(spark, choice_file(spark, sf_dir), schemas.MULTIPLE_CHOICE)
    prepared = prep.prepare_close_ended(questions, questions, articles, articles, {"train": lines, "test": lines})
    united = None
    for (dataset, split), rows in prepared.items():
        part = rows.select(
            F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), chat_field("messages", "user").alias("user")
        )
        united = part if united is None else united.unionByName(part)
    return united.groupBy("dataset", "split").agg(
        F.count("*").alias("entries"), F.sum(F.length("user")).alias("characters")
    )


def prep_expert_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-form answers of the question bundles."""
    return flat(prep.expert_answers(readers.read_question_bundle(spark, question_files(spark, sf_dir))), "id")


def prep_article_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-form answers of the keyed articles."""
    return flat(prep.article_answers(readers.read_keyed_json(spark, article_files(spark, sf_dir))), "id")


def consumer_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the answer of the next turn, if it has one; every eleventh question is empty."""
    turns = table(spark, sf_dir, "conversations").where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("asked")
    )
    answers = qa_pairs(spark, sf_dir).select("conv_id", "turn", "answer")
    question = F.when(F.pmod(F.col("conv_id") + F.col("turn"), F.lit(11)) == 0, F.lit("")).otherwise(F.col("asked"))
    return turns.join(answers, ["conv_id", "turn"], "left").withColumn("asked", question)


def prep_consumer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consumer questions: first turns and later turns as two training files, numbered after the filter."""
    asked = consumer_questions(spark, sf_dir)
    sources = []
    for name, condition in (("train1", F.col("turn") == 0), ("train2", F.col("turn") > 0)):
        path = scratch_path(spark, name)
        lines = in_order(asked.where(condition), "conv_id", "turn")
        lines.select(F.col("asked").alias("NLM_SUMMARY"), F.col("answer").alias("ANSWER")).write.json(path)
        sources.append(readers.read_jsonl(spark, path, schemas.CONSUMER_TRAIN, ordered=True))
    return flat(prep.consumer_train(sources), "id")


def prep_consumer_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consumer test questions with several reference answers."""
    path = scratch_path(spark, "test")
    answers = F.array(F.struct(F.lit("").alias("ANSWER")), F.struct(F.col("answer").alias("ANSWER")), F.struct(
        F.col("asked").alias("ANSWER")))
    consumer_questions(spark, sf_dir).select(
        F.col("asked").alias("NLM_SUMMARY"), answers.alias("REFERENCE_ANSWERS")
    ).write.json(path)
    return flat(prep.consumer_test(readers.read_jsonl(spark, path, schemas.CONSUMER_TEST, ordered=True)))


def prep_medication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question/answer table from CSV, shuffled and split 90/10."""
    path = scratch_path(spark, "medication")
    pairs = consumer_questions(spark, sf_dir).select(
        F.nullif("asked", F.lit("")).alias("Question"), F.col("answer").alias("Answer")
    )
    writers.write_qa_csv(pairs, path)
    return flat(prep.medication_qa(readers.read_qa_csv(spark, path, schemas.MEDICATION)), "split", "id")


def prep_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages with themselves as answers, written as training files; pairs and chats read back."""
    folder = scratch_path(spark, "passages")
    prepared = prep.passage_qa(readers.read_id_text_tsv(spark, passage_file(spark, sf_dir)))
    prep.write_prepared(prepared, folder, "train", compression=RAW_COMPRESSION)
    pairs = readers.read_qa_csv(spark, f"{folder}/train.csv", schemas.QA_PAIR_WITH_ID)
    chats = prep.unpack_pairs(readers.read_jsonl(spark, f"{folder}/train.jsonl", schemas.CHAT))
    columns = ["file", "id", "question", "answer"]
    from_chats = chats.withColumn("id", F.lit(None).cast("bigint")).withColumn("file", F.lit("jsonl"))
    return pairs.withColumn("file", F.lit("csv")).select(columns).unionByName(from_chats.select(columns))


def prep_judged_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged pages written as CSV parts of 50,000 rows, read back with their part."""
    path = scratch_path(spark, "judged-parts")
    texts = prep.judged_corpus_texts(metadata_scan(spark, sf_dir), judged_ids(spark, sf_dir))
    writers.write_chunked(texts, path, ["id", "title"])
    back = spark.read.options(header=True, escape='"', multiLine=True).schema("id STRING, title STRING, part INT").csv(path)
    return back.select("id", F.length(F.coalesce("title", F.lit(""))).alias("chars"), "part")


def prep_passage_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training documents with ids, test documents and queries without, and the queries' own ids, as four tables."""
    passages = readers.read_id_text_tsv(spark, passage_file(spark, sf_dir))
    folder = scratch_path(spark, "passage-tables")
    asked = questions(spark, sf_dir).select(F.col("query_id").cast("string").alias("id"), one_line("query").alias("text"))
    prep.write_passage_tables(passages, passages, asked, folder, compression=RAW_COMPRESSION)
    with_id = readers.read_qa_csv(spark, f"{folder}/train.csv", schemas.QA_PAIR_WITH_ID).withColumn("id", F.col("id").cast("string"))
    tables = {"train": with_id}
    for name in ("test", "test_queries"):
        tables[name] = readers.read_qa_csv(spark, f"{folder}/{name}.csv", "question STRING, answer STRING").withColumn("id", F.lit(None).cast("string"))
    ids = spark.read.options(header=True, escape='"').schema("id STRING, question STRING").csv(f"{folder}/query_ids.csv")
    tables["query_ids"] = ids.withColumn("answer", F.col("question"))
    named = [t.select(F.lit(name).alias("name"), "id", F.md5("question").alias("question_md5")) for name, t in tables.items()]
    return reduce(DataFrame.unionByName, named)


def keyed_json_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed objects in which every key comes twice: once per file, at its first place, with its last value."""
    path = scratch_path(spark, "repeated")
    value = F.to_json(F.struct(F.col("source").alias("QUESTION"), F.col("doc_id").cast("string").alias("final_decision")))
    entry = F.concat(F.lit('"'), F.pmod("doc_id", F.lit(100)), F.lit('": '), value)
    write_bundles(global_index(table(spark, sf_dir, "documents"), ["doc_id"]), entry, "{", "}", path)
    return readers.read_keyed_json(spark, path).select("position", "key", "QUESTION", "final_decision")


def judged_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("doc_id"))


def metadata_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "metadata")
    writers.write_qa_csv(page_metadata(spark, sf_dir), path)
    return readers.read_qa_csv(spark, path, schemas.CORPUS_METADATA)


def prep_judged_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged pages as corpus records with their address."""
    records = prep.judged_corpus_records(metadata_scan(spark, sf_dir), judged_ids(spark, sf_dir))
    return records.select("_id", "title", "text", F.col("metadata.url").alias("url"))


def prep_judged_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged pages as id and text for chunked upload."""
    return prep.judged_corpus_texts(metadata_scan(spark, sf_dir), judged_ids(spark, sf_dir))


def prep_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics and judgments joined on the one query id: judgments and best grade per topic."""
    topics = readers.read_topics_xml(spark, topics_file(spark, sf_dir))
    judged = readers.read_qrels(spark, qrels_file(spark, sf_dir))
    counted = judged.groupBy("query_id").agg(F.count("*").alias("judgments"), F.max("relevance").alias("best"))
    return topics.join(counted, "query_id", "left").select("query_id", "query", "judgments", "best")


QUERIES = {
    "bundle_scan": bundle_scan,
    "keyed_json_scan": keyed_json_scan,
    "tsv_scan": tsv_scan,
    "qrels_scan": qrels_scan,
    "topics_xml_scan": topics_xml_scan,
    "id_list_scan": id_list_scan,
    "chat_jsonl_roundtrip": chat_jsonl_roundtrip,
    "qa_csv_roundtrip": qa_csv_roundtrip,
    "corpus_jsonl_roundtrip": corpus_jsonl_roundtrip,
    "results_roundtrip": results_roundtrip,
    "chunked_csv_roundtrip": chunked_csv_roundtrip,
    "prep_yes_no": prep_yes_no,
    "prep_articles": prep_articles,
    "prep_multiple_choice": prep_multiple_choice,
    "prep_close_ended": prep_close_ended,
    "prep_expert_answers": prep_expert_answers,
    "prep_article_answers": prep_article_answers,
    "prep_consumer": prep_consumer,
    "prep_consumer_test": prep_consumer_test,
    "prep_medication": prep_medication,
    "prep_passages": prep_passages,
    "prep_passage_tables": prep_passage_tables,
    "prep_judged_parts": prep_judged_parts,
    "keyed_json_repeated": keyed_json_repeated,
    "prep_judged_corpus": prep_judged_corpus,
    "prep_judged_texts": prep_judged_texts,
    "prep_judgments": prep_judgments,
}


# --- SQL -------------------------------------------------------------------------------------------------------------

SQL_QUESTIONS = """
questions AS (
  SELECT row_number() OVER (ORDER BY d.doc_id) - 1 AS position, d.doc_id, d.text AS body, d.lang, d.source,
         CASE WHEN quality = 1 THEN 'yes' WHEN quality = 0 THEN 'no' WHEN d.doc_id % 3 = 0 THEN 'Yes'
              WHEN d.doc_id % 3 = 1 THEN '["yes"]' END AS exact_answer,
         CASE WHEN d.doc_id % 4 <> 3 THEN string_split(d.text, chr(10)) END AS lines,
         CASE d.doc_id % 4 WHEN 1 THEN d.lang || ' ' || d.source WHEN 2 THEN d.source END AS ideal
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
)"""

SQL_ARTICLES = """
articles AS (
  SELECT row_number() OVER (ORDER BY d.doc_id) - 1 AS position, CAST(d.doc_id AS VARCHAR) AS key,
         'What says ' || source || ' in ' || lang AS QUESTION, text, reverse(text) AS LONG_ANSWER,
         CASE WHEN d.doc_id % 5 <> 0 THEN 'yes' ELSE 'no' END AS reasoning,
         CASE WHEN quality = 1 THEN 'yes' WHEN quality = 0 THEN 'no' WHEN d.doc_id % 2 = 0 THEN 'maybe' END
           AS final_decision
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
)"""

SQL_CONSUMER = f"""{SQL_PAIRS},
consumer AS (
  SELECT c.conv_id, c.turn, p.answer, CASE WHEN (c.conv_id + c.turn) % 11 = 0 THEN '' ELSE c.text END AS asked
  FROM conversations c LEFT JOIN pairs p ON p.conv_id = c.conv_id AND p.turn = c.turn WHERE c.role = 'user'
)"""

ONE_LINE = "regexp_replace(text, '[\\t\\n]+', ' ', 'g')"
SQL_OPTIONS = (
    "p_name || chr(10) || 'Options:' || chr(10) || 'D) ' || p_type || chr(10) || 'A) ' || p_brand || chr(10) || 'B) ' "
    "|| p_size || chr(10) || 'C) ' || CAST(floor(p_retailprice) AS INTEGER)"
)
CONTEXT = "coalesce(array_to_string(lines, ' '), '')"
YES_NO_USER = f"'Question: ' || body || chr(10) || 'Context: ' || {CONTEXT}"
ARTICLE_USER = sql_strip("(replace(text, chr(10), ' ') || ' ' || QUESTION)")
REASONED = "reasoning = 'yes' AND final_decision IN ('yes', 'no', 'maybe')"

SQL = {
    "bundle_scan": f"""
WITH {SQL_QUESTIONS}
SELECT position, body, exact_answer, CAST(coalesce(len(lines), -1) AS INTEGER) AS snippets FROM questions""",
    "keyed_json_scan": f"WITH {SQL_ARTICLES} SELECT position, key, QUESTION, text, final_decision FROM articles",
    "tsv_scan": f"SELECT CAST(doc_id AS VARCHAR) AS id, {ONE_LINE} AS text FROM documents",
    "qrels_scan": f"""
WITH {SQL_QRELS}
SELECT CAST(query_id AS VARCHAR) AS query_id, CAST(doc_id AS VARCHAR) AS doc_id, relevance FROM qrels""",
    "topics_xml_scan": f"""
WITH {SQL_WHOLE_QUERIES}
SELECT CAST(query_id AS VARCHAR) AS query_id, query,
       CASE WHEN query_id % 2 = 0 THEN '' ELSE reverse(query) END AS question,
       CASE WHEN query_id % 3 <> 0 THEN '<About> ' || query ELSE '' END AS narrative FROM queries""",
    "id_list_scan": "SELECT DISTINCT CAST(doc_id AS VARCHAR) AS doc_id FROM labels",
    "chat_jsonl_roundtrip": f"""
WITH {SQL_PAIRS}
SELECT {quoted(prompts.EXPLAIN_SYSTEM)} AS system, question AS user, answer AS assistant, CAST(3 AS INTEGER) AS turns
FROM pairs""",
    "qa_csv_roundtrip": """
SELECT doc_id AS id, text AS question, CASE WHEN doc_id % 7 <> 0 AND source <> 'src3' THEN source END AS answer
FROM documents""",
    "corpus_jsonl_roundtrip": f"""
WITH {SQL_PAGES}
SELECT cord_uid AS _id, coalesce(nullif(title, ''), 'Unknown') AS title,
       coalesce(nullif(abstract, ''), 'No abstract available') AS text, 'id:' || cord_uid AS url FROM page_metadata""",
    "results_roundtrip": """
SELECT 'close-ended' AS task, CASE WHEN toxic = 1 THEN 'flagged' ELSE 'plain' END AS dataset, 'base' AS model,
       quality = 1 AS use_rag, doc_id, CAST(toxic <> 1 AS INTEGER) AS correct, CAST(1 AS INTEGER) AS dated
FROM labels""",
    "chunked_csv_roundtrip": """
SELECT page_id, url, CAST((row_number() OVER (ORDER BY page_id) - 1) // 100 + 1 AS INTEGER) AS part FROM pages""",
    "prep_yes_no": f"""
WITH {SQL_QUESTIONS}, kept AS (SELECT * FROM questions WHERE exact_answer IN ('yes', 'no'))
SELECT position + 1 AS id, body AS question, exact_answer AS answer, {quoted(prompts.YES_NO_SYSTEM)} AS system,
       body AS user, exact_answer AS assistant, 'train' AS split FROM kept
UNION ALL
SELECT position + 1, body, exact_answer, {quoted(prompts.YES_NO_SYSTEM)}, {YES_NO_USER}, exact_answer, 'test' FROM kept
""",
    "prep_articles": f"""
WITH {SQL_ARTICLES}
SELECT position + 1 AS id, QUESTION AS question, final_decision AS answer,
       {quoted(prompts.YES_NO_MAYBE_SYSTEM)} AS system, {ARTICLE_USER} AS user, final_decision AS assistant
FROM articles WHERE {REASONED}""",
    "prep_multiple_choice": f"""
SELECT {SQL_OPTIONS} AS question_with_options, p_name AS question, CASE WHEN p_size > 25 THEN 'A' ELSE 'D' END AS answer,
       {quoted(prompts.MULTIPLE_CHOICE_SYSTEM)} AS system, {SQL_OPTIONS} AS user,
       CASE WHEN p_size > 25 THEN 'A' ELSE 'D' END AS assistant FROM part""",
    "prep_close_ended": f"""
WITH {SQL_QUESTIONS}, {SQL_ARTICLES}, united AS (
  SELECT 'yesno' AS dataset, 'train' AS split, 'Question: ' || body AS user FROM questions
  WHERE exact_answer IN ('yes', 'no')
  UNION ALL SELECT 'yesno', 'test', {YES_NO_USER} FROM questions WHERE exact_answer IN ('yes', 'no')
  UNION ALL SELECT 'ynm', split, {ARTICLE_USER} FROM articles, (SELECT unnest(['train', 'test']) AS split)
  WHERE {REASONED}
  UNION ALL SELECT 'mc', split, {SQL_OPTIONS} FROM part, (SELECT unnest(['train', 'test']) AS split)
)
SELECT dataset, split, count(*) AS entries, CAST(sum(length(user)) AS BIGINT) AS characters
FROM united GROUP BY dataset, split""",
    "prep_expert_answers": f"""
WITH {SQL_QUESTIONS}
SELECT position + 1 AS id, body AS question, ideal AS answer, {quoted(prompts.EXPERT_SYSTEM)} AS system,
       body AS user, ideal AS assistant FROM questions WHERE ideal IS NOT NULL""",
    "prep_article_answers": f"""
WITH {SQL_ARTICLES}
SELECT position + 1 AS id, QUESTION AS question, LONG_ANSWER AS answer,
       {quoted(prompts.YES_NO_MAYBE_SYSTEM)} AS system, QUESTION AS user, LONG_ANSWER AS assistant
FROM articles WHERE final_decision = 'yes'""",
    "prep_consumer": f"""
WITH {SQL_CONSUMER}
SELECT row_number() OVER (ORDER BY turn > 0, conv_id, turn) AS id, asked AS question, answer,
       {quoted(prompts.EXPLAIN_SYSTEM)} AS system, asked AS user, answer AS assistant
FROM consumer WHERE asked <> '' AND answer <> ''""",
    "prep_consumer_test": f"""
WITH {SQL_CONSUMER}, joined AS (
  SELECT asked, concat_ws(chr(10), nullif(answer, ''), nullif(asked, '')) AS answer FROM consumer
)
SELECT asked AS question, answer, {quoted(prompts.EXPLAIN_SYSTEM)} AS system, asked AS user, answer AS assistant
FROM joined WHERE asked <> '' AND answer <> ''""",
    "prep_medication": f"""
WITH {SQL_CONSUMER}, kept AS (SELECT asked, answer FROM consumer WHERE asked <> '' AND answer IS NOT NULL),
mixed AS (
  SELECT *, row_number() OVER (ORDER BY md5('42:' || asked || chr(10) || answer)) - 1 AS i, count(*) OVER () AS n
  FROM kept
)
SELECT CASE WHEN i < floor(n * 0.9) THEN 'train' ELSE 'test' END AS split,
       CAST(i + 1 - CASE WHEN i < floor(n * 0.9) THEN 0 ELSE floor(n * 0.9) END AS BIGINT) AS id,
       asked AS question, answer, {quoted(prompts.EXPERT_SYSTEM)} AS system, asked AS user, answer AS assistant
FROM mixed""",
    "prep_passages": f"""
WITH passages AS (SELECT doc_id AS id, {ONE_LINE} AS question FROM documents)
SELECT 'csv' AS file, id, question, question AS answer FROM passages
UNION ALL SELECT 'jsonl', NULL, question, question FROM passages""",
    "prep_passage_tables": f"""
WITH passages AS (SELECT CAST(doc_id AS VARCHAR) AS id, md5({ONE_LINE}) AS question_md5 FROM documents),
asked AS (SELECT CAST(item_id AS VARCHAR) AS id, md5({ONE_LINE}) AS question_md5 FROM benchmark)
SELECT 'train' AS name, id, question_md5 FROM passages
UNION ALL SELECT 'test', NULL, question_md5 FROM passages
UNION ALL SELECT 'test_queries', NULL, question_md5 FROM asked
UNION ALL SELECT 'query_ids', id, question_md5 FROM asked""",
    "prep_judged_parts": f"""
WITH {SQL_PAGES},
kept AS (
  SELECT cord_uid AS id, coalesce(title, '') || ' ' || coalesce(abstract, '') AS title
  FROM page_metadata WHERE cord_uid IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)
)
SELECT id, CAST(length(title) AS INTEGER) AS chars, CAST((row_number() OVER (ORDER BY id, title) - 1) // 50000 + 1 AS INTEGER) AS part
FROM kept""",
    "keyed_json_repeated": """
WITH numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents),
keyed AS (
  SELECT idx // 200 AS file, doc_id % 100 AS key, min(idx) AS place, max_by(source, idx) AS QUESTION,
         max_by(CAST(doc_id AS VARCHAR), idx) AS final_decision
  FROM numbered GROUP BY ALL
)
SELECT row_number() OVER (ORDER BY place) - 1 AS position, CAST(key AS VARCHAR) AS key, QUESTION, final_decision FROM keyed""",
    "prep_judged_corpus": f"""
WITH {SQL_PAGES}
SELECT cord_uid AS _id, coalesce(nullif(title, ''), 'Unknown') AS title,
       coalesce(nullif(abstract, ''), 'No abstract available') AS text, {SQL_URL} AS url
FROM page_metadata WHERE cord_uid IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)""",
    "prep_judged_texts": f"""
WITH {SQL_PAGES}
SELECT cord_uid AS id, coalesce(title, '') || ' ' || coalesce(abstract, '') AS title
FROM page_metadata WHERE cord_uid IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)""",
    "prep_judgments": f"""
WITH {SQL_WHOLE_QUERIES}, {SQL_QRELS},
counted AS (SELECT query_id, 2 * count(*) AS judgments, max(relevance) AS best FROM qrels GROUP BY query_id)
SELECT CAST(query_id AS VARCHAR) AS query_id, query, judgments, best FROM queries LEFT JOIN counted USING (query_id)""",
}
