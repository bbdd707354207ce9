"""Joins in which one key may hold a large share of the big side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaloom.session import is_small, stage

# At most this many keys can exceed 1/MAX_HOT_KEYS of all rows, so the hot-key table is bounded by construction.
MAX_HOT_KEYS = 10_000
SLICE_ROWS = 1_000_000


def hot_keys(
    sizes: DataFrame, key: str, size_col: str, slice_rows: int | None = None, max_keys: int = MAX_HOT_KEYS
) -> DataFrame | None:
    """Keys with more rows than one slice should hold, with the number of slices to cut them into.

    ``sizes`` has one row per key. The threshold rises with the table so that no more than ``max_keys`` keys can
    pass it. None if no key is that large.
    """
    seen = sizes.agg(F.sum(size_col).alias("rows"), F.max(size_col).alias("largest")).first()
    threshold = max(slice_rows or SLICE_ROWS, (seen["rows"] or 0) // max_keys + 1)
    if (seen["largest"] or 0) <= threshold:
        return None
    slices = F.ceil(F.col(size_col) / F.lit(threshold)).cast("int")
    return sizes.where(F.col(size_col) > threshold).select(key, slices.alias("_slices"))


def salted_join(big: DataFrame, small: DataFrame, key: str, spread: str, hot: DataFrame | None) -> DataFrame:
    """Inner join on ``key`` with the rows of hot keys spread by the hash of ``spread``.

    A hot key is cut into its number of slices on the big side, and the matching rows of the small side are
    repeated once per slice; other keys join as usual.
    """
    if hot is None:
        return big.join(small, key)
    hot = F.broadcast(hot)
    slices = F.coalesce(F.col("_slices"), F.lit(1))
    left = big.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), slices).cast("int")).drop("_slices")
    right = (
        small.join(hot, key, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), slices - 1)))
        .drop("_slices")
    )
    return left.join(right, [key, "_salt"]).drop("_salt")


def fetch(wanted: DataFrame, table: DataFrame, key: str, spread: str) -> DataFrame:
    """Rows of a big keyed ``table`` for the keys in ``wanted`` (inner join, one result per row of ``wanted``).

    A small ``wanted`` is broadcast, so the table is filtered where it is read and never shuffled. Otherwise both
    sides are shuffled, and a key that very many rows want is spread by the hash of ``spread``.
    """
    wanted = stage(wanted, "wanted")
    if is_small(wanted):
        return table.join(F.broadcast(wanted), key)
    hot = hot_keys(wanted.groupBy(key).agg(F.count("*").alias("rows")), key, "rows")
    return salted_join(wanted, table, key, spread, hot)
