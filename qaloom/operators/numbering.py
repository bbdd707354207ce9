"""Global row numbers, exact splits and fixed-size chunks without funnelling rows through one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qaloom import prompts
from qaloom.operators.skew import hot_keys, salted_join
from qaloom.session import is_small, stage


def _offsets(counts: DataFrame, slice_col: str, size_col: str) -> DataFrame:
    """Start of every slice: a running sum over one small row per slice, plus the grand total."""
    ordered = Window.orderBy(slice_col)
    before = F.sum(size_col).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    everything = F.sum(size_col).over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return counts.select(slice_col, F.coalesce(before, F.lit(0)).alias("_start"), everything.alias("_total"))


def global_index(
    df: DataFrame, order_by: Sequence[Column | str], name: str = "idx", total: str | None = None
) -> DataFrame:
    """Consecutive numbers from 0 in the order of ``order_by``; ``total`` names a row-count column.

    Rows are range-partitioned and sorted once, staged with their position inside the partition, and shifted by
    the sizes of the earlier partitions. The numbers agree between passes because the placement is written, not
    recomputed. A last tie-break column lets many rows with one key spread over several partitions.
    """
    spark = df.sparkSession
    # Computed keys become columns, so that sorting compares values instead of computing them again.
    computed = {f"_key{i}": key for i, key in enumerate(order_by) if not isinstance(key, str)}
    keys = [key if isinstance(key, str) else f"_key{i}" for i, key in enumerate(order_by)]
    placed = df.withColumns(computed) if computed else df
    placed = placed.withColumn("_tie", F.monotonically_increasing_id())
    placed = placed.repartitionByRange(*keys, "_tie").sortWithinPartitions(*keys, "_tie").select(
        *df.columns,
        F.spark_partition_id().alias("_slice"),
        (F.monotonically_increasing_id() % F.lit(1 << 33)).alias("_pos"),
    )
    staged = stage(placed, "indexed")
    sizes = staged.groupBy("_slice").agg((F.max("_pos") + 1).alias("_size"))
    # One row per range partition, so never more than spark.sql.shuffle.partitions rows.
    starts = F.broadcast(_offsets(sizes, "_slice", "_size"))
    numbered = staged.join(starts, "_slice")
    extra = [F.col("_total").alias(total)] if total else []
    return numbered.select(*df.columns, (F.col("_start") + F.col("_pos")).alias(name), *extra)


def running_starts(sizes: DataFrame, key: str, size_col: str) -> DataFrame:
    """``key`` and ``_start``: the sum of the sizes of all smaller keys, for a table of any number of rows.

    The rows are range-partitioned by key and staged. A running sum inside every partition and the sums of the earlier
    partitions give the start, so no task sees more than its range.
    """
    placed = sizes.select(key, size_col).repartitionByRange(key).select(key, size_col, F.spark_partition_id().alias("_slice"))
    placed = stage(placed, "sizes")
    slices = placed.groupBy("_slice").agg(F.sum(size_col).alias("_slice_size"))
    # One row per range partition, so never more than spark.sql.shuffle.partitions rows.
    before = F.broadcast(_offsets(slices, "_slice", "_slice_size").select("_slice", F.col("_start").alias("_before")))
    inside = Window.partitionBy("_slice").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("_local", F.coalesce(F.sum(size_col).over(inside), F.lit(0)))
    return local.join(before, "_slice").select(key, (F.col("_before") + F.col("_local")).alias("_start"))


def stacked_index(
    df: DataFrame, file_col: str, pos_col: str, name: str = "idx", counted: DataFrame | None = None
) -> DataFrame:
    """Consecutive numbers over files in path order, given each row's position inside its file.

    ``df`` has to be a table, or be derived from tables alone (its rows are counted once before they are numbered).
    ``counted`` may hold these two columns of all rows where they are cheaper to read. Where the files are too many to
    broadcast their starts, a file with very many rows is cut into slices for the join.
    """
    sizes = (df if counted is None else counted).groupBy(file_col).agg((F.max(pos_col) + 1).alias("_size"))
    sizes = stage(sizes, "file-sizes")
    starts = stage(running_starts(sizes, file_col, "_size"), "file-starts")
    if is_small(starts):
        joined = df.join(F.broadcast(starts), file_col)
    else:
        joined = salted_join(df, starts, file_col, pos_col, hot_keys(sizes, file_col, "_size"))
    return joined.withColumn(name, F.col("_start") + F.col(pos_col)).drop("_start")


def seeded_order(key: Column | str, seed: int) -> Column:
    """A reproducible shuffle key: the first 60 bits of a seeded digest, which sort faster than its text."""
    key = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


# Bits of the hash that one round of the selection tells apart.
ROUND_BITS = 16
HASH_BITS = 60


def exact_split(
    df: DataFrame, key: Column | str, fraction: float = prompts.TRAIN_FRACTION, seed: int = 42, numbered: bool = True
) -> DataFrame:
    """Shuffle, then mark exactly ``floor(n * fraction)`` rows ``train`` and the rest ``test``.

    Adds ``split`` and ``split_id``, the 1-based position inside the split. Positions cost a range partitioning of the whole
    rows. Without ``numbered`` there is ``split`` alone: the cut is found by counting (:func:`cut_of`) and rows are marked
    where they lie. Both ways mark the same rows as long as no two rows share a key.
    """
    key = F.col(key) if isinstance(key, str) else key
    if not numbered:
        return _marked(df, key, fraction, seed)
    mixed = global_index(df, [seeded_order(key, seed), key], name="_idx", total="_n")
    cut = F.floor(F.col("_n") * F.lit(fraction))
    in_train = F.col("_idx") < cut
    return mixed.select(
        *df.columns,
        F.when(in_train, F.lit("train")).otherwise(F.lit("test")).alias("split"),
        (F.col("_idx") + 1 - F.when(in_train, F.lit(0)).otherwise(cut)).cast("bigint").alias("split_id"),
    )


def cut_of(values: DataFrame, name: str, k: int, bits: int = HASH_BITS) -> tuple[int, int]:
    """The k-th smallest (from 1) of a column of whole numbers of so many bits, and how many rows are smaller.

    Every round counts the rows of each bin of the values that are still possible, no more than ``2**ROUND_BITS`` counts, and
    goes on in the bin that holds the k-th. Nothing is sorted or shuffled but these counts.
    """
    before, low, width = 0, 0, bits
    while width:
        step = max(0, width - ROUND_BITS)
        inside = values.where((F.col(name) >= low) & (F.col(name) < low + (1 << width)))
        bins = inside.groupBy(F.shiftright(F.col(name) - F.lit(low), step).alias("bin")).agg(F.count("*").alias("rows")).collect()
        for row in sorted(bins, key=lambda r: r["bin"]):
            if before + row["rows"] >= k:
                low, width = low + (row["bin"] << step), step
                break
            before += row["rows"]
    return low, before


def _marked(df: DataFrame, key: Column, fraction: float, seed: int) -> DataFrame:
    hashed = df.withColumns({"_hash": F.coalesce(seeded_order(key, seed), F.lit(-1)) + 1, "_key": key})
    n = df.count()
    k = int(n * fraction)
    mark = lambda train: F.when(train, F.lit("train")).otherwise(F.lit("test")).alias("split")
    if k in (0, n):
        return df.select(*df.columns, mark(F.lit(k > 0)))
    cut, before = cut_of(hashed, "_hash", k, HASH_BITS + 1)
    # Rows of the hash at the cut: those of one key, or of the few keys that share a hash.
    ties = hashed.where(F.col("_hash") == cut)
    if ties.count() + before == k:
        return hashed.select(*df.columns, mark(F.col("_hash") <= cut))
    chosen = global_index(ties, ["_key"], "_nth").select(*df.columns, mark(F.col("_nth") < k - before))
    return hashed.where(F.col("_hash") != cut).select(*df.columns, mark(F.col("_hash") < cut)).unionByName(chosen)


def chunk_ids(
    df: DataFrame, order_by: Sequence[Column | str], size: int = prompts.CHUNK_ROWS, name: str = "part"
) -> DataFrame:
    """Number consecutive chunks of ``size`` rows from 1; also keeps the row number ``idx``."""
    return global_index(df, order_by).withColumn(name, (F.floor(F.col("idx") / F.lit(size)) + 1).cast("int"))


def split_counts(df: DataFrame, *keys: str) -> DataFrame:
    """Entries per split."""
    return df.groupBy(*keys).agg(F.count("*").alias("entries"))
