"""Mixing sources to target weights by Sainte-Laguë apportionment.

All words are cut into blocks of equal size. The blocks of the mix go to the sources by highest quotients
``target / 1, target / 3, target / 5, …``, and the blocks of a source go to its shards in the same way. In a shard the
documents stand in a seeded order and form one run of words; it is taken whole as often as its quota allows, and
the blocks of one more pass are drawn in a seeded order until the quota is full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from qaloom.llm.common import SPACE, WORD, hidden, n_words, numbered, shown
from qaloom.session import broadcast_if_small, stage

# Words in a block, documents in a shard, and how often a word may be taken.
BLOCK_WORDS = 64
SHARD_DOCS = 10_000
MOST_PASSES = 3
# Copies of a row that a task writes at once.
COPIES = 10_000


def targets(sizes: DataFrame, source: str = "source", size: str = "source_size") -> DataFrame:
    """``sizes`` with ``target``: shares of all words by weights 1, 2, 3, repeating over the sources in code point
    order, null last. A target stops at ``MOST_PASSES`` times its source's size; the excess goes to the others by
    weight until none is above. ``sizes`` has one row per source.

    A source is at its limit if its limit per weight lies below the level that the others then reach; in the order
    of limit per weight that is a prefix, so running sums decide it without repetition.
    """
    ordered = W.orderBy(F.col(source).asc_nulls_last())
    limit, weight = F.col("_limit"), F.col("_weight")
    weighed = sizes.withColumn("_weight", F.pmod(F.row_number().over(ordered) - 1, F.lit(3)) + 1)
    weighed = weighed.withColumn("_limit", (F.col(size) * MOST_PASSES).cast("double"))
    by_level = W.orderBy(limit / weight, F.col(source).asc_nulls_last())
    before, after = by_level.rowsBetween(W.unboundedPreceding, -1), by_level.rowsBetween(0, W.unboundedFollowing)
    total = F.sum(size).over(W.partitionBy()).cast("double")
    left = total - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))
    levels = weighed.withColumn("_level", left / F.sum("_weight").over(after))
    full = limit < weight * F.col("_level")
    # The levels never rise behind the first source below its limit, so its level is the largest.
    reached = F.max(F.when(~full, F.col("_level"))).over(W.partitionBy())
    share = F.when(full, limit).otherwise(F.least(limit, weight * reached))
    return levels.withColumn("target", share).drop("_weight", "_limit", "_level")


def apportion(parties: DataFrame, group: list[str], key: str, votes: str, seats: str, out: str) -> DataFrame:
    """``parties`` with ``out``: their whole numbers of the ``seats`` of their group, by highest quotients.

    A divisor method gives the same seats in any order of steps, so it starts from the rounded shares of
    ``seats - parties`` seats, which are never more than the result, and awards the remaining seats one by one. With
    ``r`` of them open, a party wins no more than ``votes * (r + parties) / all votes + 1``: so many quotients
    per party are ranked, about three for each party. Equal quotients go to the smaller key, null last.
    """
    own = W.partitionBy(*group)
    rows = parties.withColumn("_all", F.sum(votes).over(own).cast("double")).withColumn("_n", F.count("*").over(own))
    sure = F.round(F.col(votes) * F.greatest(F.lit(0), F.col(seats) - F.col("_n")) / F.col("_all"))
    rows = rows.withColumn("_sure", F.when(F.col("_all") > 0, sure).otherwise(0).cast("long"))
    rows = rows.withColumn("_open", F.greatest(F.lit(0), F.col(seats) - F.sum("_sure").over(own)))
    tries = F.floor(F.col(votes) * (F.col("_open") + F.col("_n")) / F.col("_all")) + 2
    tries = F.when((F.col(votes) > 0) & (F.col("_open") > 0), tries).otherwise(0)
    # Step 0 stands for the party itself and has no quotient.
    offers = rows.withColumn("_step", F.explode(F.sequence(F.lit(0).cast("long"), tries.cast("long"))))
    quotient = F.when(F.col("_step") > 0, F.col(votes) / (2 * (F.col("_sure") + F.col("_step")) - 1))
    best = W.partitionBy(*group).orderBy(F.desc_nulls_last("_quotient"), F.col(key).asc_nulls_last())
    offers = offers.withColumn("_quotient", quotient).withColumn("_rank", F.row_number().over(best))
    won = F.count(F.when((F.col("_step") > 0) & (F.col("_rank") <= F.col("_open")), 1))
    return offers.groupBy(*parties.columns, "_sure").agg(won.alias("_won")).select(
        *parties.columns, (F.col("_sure") + F.col("_won")).alias(out)
    )


def _row_key(doc_id: str, source: str, text: str, seed: int) -> Column:
    """A hash of id, source and text; which of them are null is part of it, since a hash passes over nulls."""
    nulls = [F.col(c).isNull() for c in (doc_id, source)]
    return F.xxhash64(F.col(doc_id).cast("string"), F.col(source).cast("string"), F.col(text), F.lit(seed), *nulls)


def _copies(counted: DataFrame) -> DataFrame:
    """Every row of ``counted`` as often as its ``copies`` say, numbered from 0 by ``copy``.

    A row with very many copies is cut into runs of ``COPIES`` first, which are written by different tasks.
    """
    end = F.col("copies") - 1
    few = counted.where(F.col("copies") <= COPIES).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), end)))
    many = counted.where(F.col("copies") > COPIES)
    if many.isEmpty():
        return few.drop("copies")
    tasks = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = many.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), end, F.lit(COPIES).cast("long"))))
    many = many.repartition(tasks, "row_key", "_from")
    many = many.withColumn("copy", F.explode(F.sequence(F.col("_from"), F.least(end, F.col("_from") + COPIES - 1)))).drop("_from")
    return few.unionByName(many).drop("copies")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, passes, more, taken, row_key`` and ``copy``.

    The mix takes a document ``passes`` times and its first ``more`` words once again: ``taken`` words in all, never
    more than ``MOST_PASSES`` times its ``size``. A source's taken words differ from its target by half a block
    per shard at most. A null or empty text has size 0 and is never taken; a null source is a source of its own. The
    result depends on the rows alone, not on their order; equal rows share their words in some order. ``row_key``
    hashes id, source and text; rows that agree in them are counted before they are shuffled, numbered by ``copy``
    from 0 and dealt to all shards of their source.
    """
    sized = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), n_words(text).alias("size"),
        _row_key(doc_id, source, text, seed).alias("row_key"),
    )
    counted = sized.groupBy("doc_id", "source", "size", "row_key").agg(F.count("*").alias("copies"))
    sized = stage(_copies(stage(counted, "counted")), "sized")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    blocks = F.round(F.sum("source_size").over(W.partitionBy()) / BLOCK_WORDS).cast("long")
    sources = targets(sizes).withColumn("blocks", blocks).withColumn("shards", F.ceil(F.col("docs") / SHARD_DOCS))
    sources = stage(apportion(sources, [], "source", "target", "blocks", "source_blocks"), "sources")

    named = sources.select(F.col("source").alias("_source"), "source_size", "target", "source_blocks", "shards")
    placed = sized.join(broadcast_if_small(named), F.expr("source <=> _source")).drop("_source")
    placed = placed.withColumn("shard", F.pmod(F.when(F.col("copy") > 0, F.xxhash64("row_key", "copy")).otherwise(F.col("row_key")), "shards"))
    shards = placed.groupBy("source", "source_blocks", "shard").agg(F.sum("size").alias("shard_size"))
    shards = apportion(shards, ["source"], "shard", "shard_size", "source_blocks", "shard_blocks")
    words = F.least(F.col("shard_blocks") * BLOCK_WORDS, F.col("shard_size") * MOST_PASSES)
    shards = stage(shards.select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "shard_size", words.alias("_words")), "shards")

    run = W.partitionBy("source", "shard").orderBy("row_key", "copy", "doc_id")
    begin = F.coalesce(F.sum("size").over(run.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = placed.withColumn("_begin", begin)
    placed = placed.join(broadcast_if_small(shards), F.expr("source <=> _source AND shard = _shard"))
    passes = F.when(F.col("shard_size") > 0, F.floor(F.col("_words") / F.col("shard_size"))).otherwise(0)
    rest = F.col("_words") - passes * F.col("shard_size") - F.col("_begin")
    placed = placed.withColumn("passes", passes.cast("long"))
    placed = placed.withColumn("more", F.greatest(F.lit(0), F.least("size", rest)).cast("long"))
    taken = F.col("passes") * F.col("size") + F.col("more")
    return placed.select(
        "doc_id", "source", "size", "source_size", "target", "passes", "more", taken.alias("taken"), "row_key", "copy"
    )


def mixed_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``.

    The copy that is taken in part holds the document's first words, with the white space between them.
    """
    plan = stage(mix(docs, seed=seed).select("row_key", "copy", "size", "passes", "more", "taken"), "mix")
    rows = hidden(docs).withColumn("row_key", _row_key("_in_doc_id", "_in_source", "_in_text", seed))
    repeated = stage(plan.where("copy = 1").select("row_key").distinct(), "repeated")
    if repeated.isEmpty():
        rows = rows.withColumn("copy", F.lit(0).cast("long"))
    else:
        repeated = broadcast_if_small(repeated)
        equal = numbered(rows.join(repeated, "row_key", "left_semi"), "row_key", "copy")
        rows = rows.join(repeated, "row_key", "left_anti").withColumn("copy", F.lit(0).cast("long")).unionByName(equal)
    rows = rows.join(plan.where("taken > 0"), ["row_key", "copy"])
    whole = F.array_repeat("size", (F.col("passes") + F.when(F.col("more") == F.col("size"), 1).otherwise(0)).cast("int"))
    part = F.when(F.col("more").between(1, F.col("size") - 1), F.array("more")).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("words", F.explode(F.concat(whole, part)))
    start = F.regexp_extract_all("_in_text", F.lit(rf"({SPACE}*{WORD})"), 1)
    cut = F.array_join(F.slice(start, 1, F.col("words").cast("int")), "")
    text = F.when(F.col("words") < F.col("size"), cut).otherwise(F.col("_in_text"))
    return rows.select(*[text.alias(c) if c == "text" else shown([c])[0] for c in docs.columns])
