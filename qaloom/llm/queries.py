"""Registered queries of this subpackage over the driver tables, with their SQL counterparts where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaloom.llm import chat, jaccard, language, mixing, negatives, neighbours, packing, ranked, repetition, secrets, suffix_tree, urls, warc
from qaloom.llm.common import read_table
from qaloom.session import scratch_path


def op1_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document. A row without id is neither held out nor learned from."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(4))
    model = language.train(docs, F.coalesce(fold != 2, F.lit(False)))
    found = language.identify(docs.select("doc_id", "text", F.coalesce(fold == 2, F.lit(False)).alias("held_out")), model)
    return found.drop("text")


def op2_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every embedding whose id is divisible by 20, by inner product."""
    return neighbours.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document a mix takes whose sources weigh 1, 2, 3, repeating."""
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by a Jaccard similarity of at least 0.9 on three-word shingles."""
    return jaccard.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=3, percent=90)


def op5_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 512, 1024 or 2048 words."""
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op6_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document and whether the repetition rules keep it."""
    found = repetition.quality(read_table(spark, sf_dir, "documents"))
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return found.select("doc_id", *base, "covered_words", "longest_repeat")


def op7_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page, by rules and by boosted trees."""
    return urls.filter_urls(read_table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and digest of the fixed patterns, and all spans."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.train(docs))
    kinds = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k, *_ in secrets.KINDS]
    return found.select("doc_id", *kinds, F.sha2(secrets.digest("base"), 256).alias("base_sha256"), secrets.digest("spans").alias("spans"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted and read back."""
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.sql(
        r"""SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, r'\### Assistant: </turn> ok' AS text
        FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)"""
    )
    chats = chat.read_back(chat.format_chats(rows.union(hard)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives, read back and merged into one index."""
    path = scratch_path(spark, "archives")
    warc.write_archives(read_table(spark, sf_dir, "pages"), path)
    index = warc.capture_index(warc.capture_runs(spark, path))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of all documents under a tree of the training documents. A row without id is neither held out nor learned from."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(5))
    tree = suffix_tree.train(docs.where(fold != 1))
    found = suffix_tree.score(docs, tree)
    return found.select(
        "doc_id",
        F.coalesce(fold == 1, F.lit(False)).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(tree.train_tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def op12_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents of highest score for every benchmark item."""
    found = ranked.rank(read_table(spark, sf_dir, "benchmark"), read_table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("query", "item_id")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives for the first five rows of the label of every embedding whose id is divisible by 100."""
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows, F.col("vec_id") % 100 == 0, label=label)


QUERIES = {
    "op1_language_ppm": op1_language_ppm,
    "op2_rp_forest": op2_rp_forest,
    "op3_source_mix": op3_source_mix,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_best_fit": op5_best_fit,
    "op6_suffix_repetition": op6_suffix_repetition,
    "op7_url_trees": op7_url_trees,
    "op8_secret_scan": op8_secret_scan,
    "op9_chat_format": op9_chat_format,
    "op10_warc_index": op10_warc_index,
    "op11_suffix_tree": op11_suffix_tree,
    "op12_norm_buckets": op12_norm_buckets,
    "op13_hard_negatives": op13_hard_negatives,
}

SQL: dict[str, str] = {}

# Exact nearest neighbours: what the forest finds in a table of at most one leaf (512 vectors); tests measure recall beyond.
SQL["op2_rp_forest"] = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_id) AS place FROM pairs
) WHERE place <= 20"""

SQL["op9_chat_format"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, turn, role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS t(turn, role)
),
lengths AS (
  SELECT *, contains(role, ': ') OR suffix(role, '\') OR contains(role, '### ') OR contains(role, '</turn>')
              OR contains(text, '### ') OR contains(text, '</turn>') AS hard,
         length(role) + length(text) AS plain_size,
         length(replace(replace(replace(replace(role, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>'), ': ', ':\ '))
           + length(replace(replace(replace(replace(text, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>'), ': ', ':\ ')) + 1
           AS hard_size
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(14 + CASE WHEN hard THEN hard_size ELSE plain_size END) AS BIGINT) AS formatted_chars
FROM lengths GROUP BY conv_id"""

SQL["op10_warc_index"] = """
WITH payloads AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
),
kept AS (
  SELECT payload_digest, payload_bytes, max(page_id) AS kept FROM payloads WHERE payload_bytes >= 1000
  GROUP BY payload_digest, payload_bytes HAVING count(*) > 1
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> kept THEN kept END AS refers_to
FROM payloads LEFT JOIN kept USING (payload_digest, payload_bytes)"""

SQL["op12_norm_buckets"] = r"""
WITH found AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
),
sized AS (SELECT r, doc_id, len(terms) AS n, terms FROM found WHERE len(terms) > 0),
figures AS (SELECT count(*) AS documents, sum(n) AS occurrences FROM sized),
counts AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(terms) AS term FROM sized) GROUP BY r, term),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE item_id IS NOT NULL
),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * documents + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM counts, figures GROUP BY term, documents
),
scores AS (
  SELECT item_id, r, any_value(doc_id) AS doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + CAST((90 * n * documents) // occurrences AS BIGINT))))) AS BIGINT) AS score
  FROM asked JOIN counts USING (term) JOIN weights USING (term), figures GROUP BY item_id, r
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10"""

SQL["op13_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
pairs AS (
  SELECT a.vec_id AS anchor_id, o.vec_id AS other_id, a.label = o.label AS same,
         CAST(list_sum(list_transform(list_zip(a.e, o.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v o ON a.vec_id <> o.vec_id WHERE a.vec_id % 100 = 0
),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10"""
