from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from qaloom.operators import numbering
from qaloom.operators.numbering import chunk_ids, exact_split, global_index, split_counts


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_global_index_is_the_sorted_position(spark, partitions):
    frame = spark.range(1000).select(F.md5(F.col("id").cast("string")).alias("key")).repartition(partitions)
    rows = global_index(frame, ["key"], total="n").collect()
    assert [r.key for r in sorted(rows, key=lambda r: r.idx)] == sorted(r.key for r in rows)
    assert sorted(r.idx for r in rows) == list(range(1000)) and {r.n for r in rows} == {1000}


def test_one_key_for_most_rows_still_spreads(spark):
    frame = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(F.lit(-1)).alias("key"), "id")
    numbered = global_index(frame.repartition(4), ["key"])
    assert numbered.agg(F.count_distinct("idx"), F.max("idx")).first()[:] == (20_000, 19_999)
    assert numbered.where("key = -1").agg(F.max("idx")).first()[0] == 17_999


def test_expression_keys(spark):
    rows = global_index(spark.range(50).repartition(3), [F.col("id") % 2, -F.col("id")]).collect()
    assert [r.id for r in sorted(rows, key=lambda r: r.idx)] == sorted(range(50), key=lambda i: (i % 2, -i))


@pytest.mark.parametrize("n", [0, 1, 9, 11, 100])
def test_exact_split_sizes(spark, n):
    split = exact_split(spark.range(n), "id", 0.9, seed=7)
    counts = {r.split: r.entries for r in split_counts(split, "split").collect()}
    assert counts.get("train", 0) == math.floor(n * 0.9) and sum(counts.values()) == n
    for name in counts:
        assert sorted(r.split_id for r in split.where(F.col("split") == name).collect()) == list(range(1, counts[name] + 1))


def test_exact_split_depends_on_seed_not_on_partitioning(spark):
    def train(frame, seed):
        return {r.id for r in exact_split(frame, "id", 0.5, seed).where("split = 'train'").collect()}

    a = train(spark.range(200).repartition(5), 1)
    assert a == train(spark.range(200).coalesce(1), 1)
    assert a != train(spark.range(200), 2)


def test_chunks_are_full_but_the_last(spark):
    chunks = chunk_ids(spark.range(1050).repartition(4), ["id"], size=100)
    rows = chunks.groupBy("part").agg(F.count("*").alias("n"), F.min("id").alias("first")).orderBy("part").collect()
    assert [(r.part, r.n, r["first"]) for r in rows] == [(i + 1, 100 if i < 10 else 50, i * 100) for i in range(11)]


@pytest.mark.parametrize("n", [0, 1, 9, 11, 3000])
def test_marked_split_is_the_numbered_one(spark, n, monkeypatch):
    monkeypatch.setattr(numbering, "ROUND_BITS", 5)
    frame = spark.range(n).withColumn("text", F.lit("long"))
    marked = {r.id: r.split for r in exact_split(frame, "id", 0.9, seed=7, numbered=False).collect()}
    assert marked == {r.id: r.split for r in exact_split(frame, "id", 0.9, seed=7).collect()}


def test_marked_split_of_repeated_keys_is_exact(spark):
    frame = spark.range(900).select(F.when(F.col("id") % 3 > 0, F.lit("same")).otherwise(F.when(F.col("id") > 30, F.col("id").cast("string"))).alias("key"), "id")
    for fraction in (0.1, 0.5, 0.9):
        marked = exact_split(frame, "key", fraction, numbered=False)
        assert marked.where("split = 'train'").count() == math.floor(900 * fraction) and marked.count() == 900
        assert marked.select("id").distinct().count() == 900


def test_marked_split_shuffles_no_rows(spark, tmp_path):
    spark.range(2000).withColumn("text", F.lit("a long text")).write.parquet(str(tmp_path / "rows"))
    marked = exact_split(spark.read.parquet(str(tmp_path / "rows")), "id", numbered=False)
    assert "Exchange" not in marked._jdf.queryExecution().executedPlan().toString()


def test_cut_is_the_kth_smallest(spark, monkeypatch):
    monkeypatch.setattr(numbering, "ROUND_BITS", 3)
    values = [5, 5, 5, 900, 17, 0, 1023, 17, 64]
    frame = spark.createDataFrame([(v,) for v in values], "v bigint")
    for k in range(1, len(values) + 1):
        cut, before = numbering.cut_of(frame, "v", k, 10)
        assert cut == sorted(values)[k - 1] and before == sum(v < cut for v in values)
