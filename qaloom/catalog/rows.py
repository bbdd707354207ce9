"""Filters, numbering, splits, chunks, semi joins and text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaloom.catalog.tables import SQL_PAIRS, SQL_QUERIES, qa_pairs, queries, sql_strip, sql_words, table
from qaloom.functions import text
from qaloom.operators.numbering import chunk_ids, exact_split, global_index, split_counts
from qaloom.plans.prep import filter_labels
from qaloom.sources.writers import corpus_records


def corpus_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a label: the corpus restricted to a set of ids."""
    ids = table(spark, sf_dir, "labels").select("doc_id").distinct()
    return table(spark, sf_dir, "documents").join(ids, "doc_id", "left_semi").select("doc_id", "lang", "n_chars")


def truncate_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under the query word limit (2,999 words), blanks collapsed."""
    documents = table(spark, sf_dir, "documents")
    return documents.select("doc_id", text.truncate_words("text").alias("query"))


def strip_and_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stripped of every kind of whitespace, padded with some first, and their word counts."""
    padded = F.concat(F.lit("\t\u00a0 \u2003\n"), F.col("text"), F.lit("\u3000\r\n "))
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.strip_ws(padded).alias("stripped"), F.size(text.words(padded)).cast("bigint").alias("words")
    )


def global_row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line numbered from 1 in the order of order and line number."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    numbered = global_index(lines, ["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate"])
    return numbered.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("idx") + 1).alias("id"))


def chunk_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines in consecutive chunks of 50,000: size, first and last order of each."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    chunks = chunk_ids(lines, ["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate"])
    return chunks.groupBy("part").agg(
        F.count("*").alias("entries"), F.min("l_orderkey").alias("first_order"), F.max("l_orderkey").alias("last_order")
    )


def exact_split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded 90/10 split of the documents with ids per split."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return exact_split(documents, "doc_id").select("doc_id", "lang", "split", F.col("split_id").alias("id"))


def exact_split_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same split, marked where the rows lie."""
    return exact_split(table(spark, sf_dir, "documents"), "doc_id", numbered=False).select("doc_id", F.md5("text").alias("text_md5"), "split")


def exact_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries per split."""
    return split_counts(exact_split_rows(spark, sf_dir), "split")


def label_filter_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as yes/no/maybe decisions, numbered before the filter, so the ids have gaps."""
    decision = F.when(F.col("quality") == 1, "yes").when(F.col("toxic") == 1, "Maybe").otherwise("no")
    numbered = global_index(table(spark, sf_dir, "labels"), ["doc_id"]).select(
        "doc_id", (F.col("idx") + 1).alias("id"), decision.alias("decision")
    )
    return filter_labels(numbered, "decision", ("yes", "no"))


def conjunctive_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in a language set whose label, where there is one, is good."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    labelled = documents.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return labelled.where((F.col("quality") == 1) & F.col("lang").isin("en", "fr")).select("doc_id", "lang", "toxic")


def filled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a label present in both columns (missing rows dropped)."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "source")
    labelled = documents.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return labelled.dropna(subset=["source", "quality"]).select("doc_id", "source", "quality")


def title_html(html: str = "html"):
    return F.regexp_extract(html, "<title>(.*?)</title>", 1)


def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with file lists built from the url so that every address rule occurs; every fifth title is missing."""
    number = F.pmod(F.col("page_id"), F.lit(4))
    files = F.concat(
        F.lit("document_parses/"), F.replace(F.col("url"), F.lit("?"), F.lit("/")), F.lit(".xml.json; other/x.json")
    )
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("string").alias("cord_uid"),
        F.when(F.pmod("page_id", F.lit(5)) != 0, title_html()).alias("title"),
        F.when(F.pmod("page_id", F.lit(3)) != 0, F.col("html")).alias("abstract"),
        F.when(number == 0, files).alias("pdf_json_files"),
        F.when(number == 1, files).alias("pmc_json_files"),
        F.when(number <= 2, F.col("page_id").cast("string")).alias("s2_id"),
    )


def title_abstract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and abstract as one text, missing parts empty, and the defaults of the corpus records."""
    pages = page_metadata(spark, sf_dir)
    records = corpus_records(pages.withColumn("url", F.lit("")), "cord_uid", "title", "abstract", "url")
    joined = pages.select(
        F.col("cord_uid").alias("_id"), text.title_and_abstract("title", "abstract").alias("joined")
    )
    return joined.join(records.select("_id", "title", "text"), "_id")


def paper_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article address of every page."""
    return page_metadata(spark, sf_dir).select(
        "cord_uid", text.paper_url("pmc_json_files", "pdf_json_files", "s2_id").alias("url")
    )


def hit_id_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First filled of two id columns: the source where the language is not English, else the document id."""
    documents = table(spark, sf_dir, "documents")
    hit_id = F.when(F.col("lang") == "en", F.lit("")).when(F.col("lang") == "fr", F.lit(None)).otherwise(F.col("source"))
    return documents.select("doc_id", text.first_filled(hit_id, F.col("doc_id").cast("string")).alias("hit_id"))


def union_split_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources one after the other, numbered after the union."""
    pairs = qa_pairs(spark, sf_dir).select("pair_id", "turn", "question")
    first = pairs.where(F.col("turn") == 0).withColumn("source", F.lit(0))
    second = pairs.where(F.col("turn") > 0).withColumn("source", F.lit(1))
    numbered = global_index(first.unionByName(second), ["source", "pair_id"])
    return numbered.select((F.col("idx") + 1).alias("id"), "source", "pair_id", "question")


def query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as queries under the word limit."""
    return queries(spark, sf_dir)


QUERIES = {
    "query_texts": query_texts,
    "corpus_semi_join": corpus_semi_join,
    "truncate_words": truncate_words,
    "strip_and_count": strip_and_count,
    "global_row_ids": global_row_ids,
    "chunk_ids": chunk_sizes,
    "exact_split_rows": exact_split_rows,
    "exact_split_counts": exact_split_counts,
    "exact_split_marks": exact_split_marks,
    "label_filter_ids": label_filter_ids,
    "conjunctive_filter": conjunctive_filter,
    "filled_pairs": filled_pairs,
    "title_abstract": title_abstract,
    "paper_url": paper_url,
    "hit_id_fallback": hit_id_fallback,
    "union_split_ids": union_split_ids,
}

SQL_LINES = """
lines AS (
  SELECT l_orderkey, l_linenumber, l_partkey,
         row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate) AS id FROM lineitem
)"""

SQL_SPLIT = """
mixed AS (
  SELECT doc_id, lang, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS i, count(*) OVER () AS n
  FROM documents
),
split AS (
  SELECT doc_id, lang, CASE WHEN i < floor(n * 0.9) THEN 'train' ELSE 'test' END AS split,
         CAST(i + 1 - CASE WHEN i < floor(n * 0.9) THEN 0 ELSE floor(n * 0.9) END AS BIGINT) AS id FROM mixed
)"""

SQL_PAGES = """
page_metadata AS (
  SELECT CAST(page_id AS VARCHAR) AS cord_uid,
         CASE WHEN page_id % 5 <> 0 THEN regexp_extract(html, '<title>(.*?)</title>', 1) END AS title,
         CASE WHEN page_id % 3 <> 0 THEN html END AS abstract,
         CASE WHEN page_id % 4 = 0 THEN files END AS pdf_json_files,
         CASE WHEN page_id % 4 = 1 THEN files END AS pmc_json_files,
         CASE WHEN page_id % 4 <= 2 THEN CAST(page_id AS VARCHAR) END AS s2_id
  FROM (SELECT *, 'document_parses/' || replace(url, '?', '/') || '.xml.json; other/x.json' AS files FROM pages)
)"""


def sql_article(files: str) -> str:
    last = f"list_last(string_split(string_split({files}, ';')[1], '/'))"
    return f"'https://www.ncbi.nlm.nih.gov/pmc/articles/' || replace(replace({last}, '.json', ''), '.xml', '') || '/'"


SQL_URL = (
    f"coalesce({sql_article('pmc_json_files')}, {sql_article('pdf_json_files')}, "
    "'https://www.semanticscholar.org/paper/' || s2_id, '')"
)

PADDED = "chr(9) || chr(160) || ' ' || chr(8195) || chr(10) || text || chr(12288) || chr(13) || chr(10) || ' '"

SQL = {
    "query_texts": f"WITH {SQL_QUERIES} SELECT query_id, query FROM queries",
    "corpus_semi_join": "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "truncate_words": f"""
SELECT doc_id, array_to_string(list_slice({sql_words('text')}, 1, 2999), ' ') AS query FROM documents""",
    "strip_and_count": f"""
SELECT doc_id, {sql_strip(f'({PADDED})')} AS stripped, len({sql_words(f'({PADDED})')}) AS words FROM documents""",
    "global_row_ids": f"WITH {SQL_LINES} SELECT l_orderkey, l_linenumber, l_partkey, id FROM lines",
    "chunk_ids": f"""
WITH {SQL_LINES}
SELECT CAST((id - 1) // 50000 + 1 AS INTEGER) AS part, count(*) AS entries, min(l_orderkey) AS first_order,
       max(l_orderkey) AS last_order FROM lines GROUP BY 1""",
    "exact_split_rows": f"WITH {SQL_SPLIT} SELECT doc_id, lang, split, id FROM split",
    "exact_split_marks": f"WITH {SQL_SPLIT} SELECT doc_id, md5(text) AS text_md5, split FROM split JOIN documents USING (doc_id)",
    "exact_split_counts": f"WITH {SQL_SPLIT} SELECT split, count(*) AS entries FROM split GROUP BY split",
    "label_filter_ids": """
WITH numbered AS (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS id,
         CASE WHEN quality = 1 THEN 'yes' WHEN toxic = 1 THEN 'Maybe' ELSE 'no' END AS decision FROM labels
)
SELECT doc_id, id, decision FROM numbered WHERE decision IN ('yes', 'no')""",
    "conjunctive_filter": """
SELECT d.doc_id, d.lang, l.toxic FROM documents d JOIN labels l ON l.doc_id = d.doc_id
WHERE l.quality = 1 AND d.lang IN ('en', 'fr')""",
    "filled_pairs": """
SELECT d.doc_id, d.source, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
WHERE d.source IS NOT NULL AND l.quality IS NOT NULL""",
    "title_abstract": f"""
WITH {SQL_PAGES}
SELECT cord_uid AS _id, coalesce(title, '') || ' ' || coalesce(abstract, '') AS joined,
       coalesce(nullif(title, ''), 'Unknown') AS title, coalesce(nullif(abstract, ''), 'No abstract available') AS text
FROM page_metadata""",
    "paper_url": f"WITH {SQL_PAGES} SELECT cord_uid, {SQL_URL} AS url FROM page_metadata",
    "hit_id_fallback": """
SELECT doc_id, coalesce(nullif(CASE WHEN lang = 'en' THEN '' WHEN lang = 'fr' THEN NULL ELSE source END, ''),
                        CAST(doc_id AS VARCHAR)) AS hit_id FROM documents""",
    "union_split_ids": f"""
WITH {SQL_PAIRS}, united AS (
  SELECT 0 AS source, pair_id, question FROM pairs WHERE turn = 0
  UNION ALL SELECT 1, pair_id, question FROM pairs WHERE turn > 0
)
SELECT row_number() OVER (ORDER BY source, pair_id) AS id, source, pair_id, question FROM united""",
}
