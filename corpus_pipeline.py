"""Corpus preparation: five stages over ``documents``, each written as Parquet and read again by the next.

Language identification, near duplicates, secrets, source mixing, packing. Every stage takes the session, the rows
that its predecessor kept and the folder of the tables; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaloom.llm import jaccard, language, mixing, packing, secrets
from qaloom.llm.common import hidden, shown
from qaloom.session import broadcast_if_small, stage

# A text is rejected if no language reaches this posterior.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is known; texts that are null or have no letter go, and ambiguous ones.

    The models learn from all labelled documents. The given label stays as it is.
    """
    model = language.train(docs, F.lit(True))
    found = language.identify(hidden(docs), model, "_in_text")
    found = found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return found.select(*shown(docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates (five-word shingles, similarity 0.8): the smallest id.

    Every row stands for itself, with a key that is the hash of all its columns: rows that share an id are compared by
    their texts like others, and so are rows without id, which stay only if their group has no id. Of rows that are
    equal in all columns one stays. Rows without words are in no group and stay.
    """
    # Nulls leave a hash as it is, so it also takes in where they are.
    plain = hidden(docs)
    keyed = plain.withColumn("_key", F.xxhash64(*plain.columns, *[F.col(f"`{c}`").isNull() for c in plain.columns]))
    keyed = keyed.withColumns({"doc_id": F.col("_in_doc_id"), "text": F.col("_in_text")})
    groups = stage(jaccard.near_duplicates(keyed, "_key", shingle=5, percent=80), "groups")
    linked = groups.where("component_id <> doc_id").select("doc_id", "component_id")
    members = linked.union(linked.select("component_id", "component_id")).distinct().withColumnRenamed("doc_id", "_key")
    members = stage(members, "members")
    members = stage(keyed.select("_key", "doc_id").join(broadcast_if_small(members), "_key"), "members")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key"))["_key"]
    gone = members.select("_key").join(members.groupBy("component_id").agg(first.alias("_key")), "_key", "left_anti").distinct()
    kept = keyed.join(broadcast_if_small(stage(gone, "gone")), "_key", "left_anti")
    repeated = groups.where("n_shingles > 0").groupBy(F.col("doc_id").alias("_key")).agg(F.count("*").alias("n")).where("n > 1").select("_key")
    repeated = stage(repeated, "repeated")
    if repeated.isEmpty():
        return kept.select(*shown(docs.columns))
    repeated = broadcast_if_small(repeated)
    once = kept.join(repeated, "_key", "left_semi").select(*shown(docs.columns)).distinct()
    return kept.join(repeated, "_key", "left_anti").select(*shown(docs.columns)).union(once)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by a placeholder; all documents stay, and ``n_chars`` follows a text that changed."""
    plain = hidden(docs).withColumn("clean", F.col("_in_text"))
    clean = secrets.redact(plain, secrets.train(docs), "clean")
    changed = ~F.col("clean").eqNullSafe(F.col("_in_text"))
    n_chars = F.when(changed, F.length("clean").cast("long")).otherwise(F.col("_in_n_chars"))
    out = {"text": F.col("clean"), "n_chars": n_chars}
    return clean.select(*[out[c].alias(c) if c in out else shown([c])[0] for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source weights 1, 2, 3: documents as often as they are taken, one of a shard in part."""
    mixed = mixing.mixed_documents(docs)
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of the permitted lengths, with the documents that they hold."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", remove_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# SQL can express neither the trained models nor the packing; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
