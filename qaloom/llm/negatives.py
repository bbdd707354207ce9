"""Hard negatives by a secondary sort of pair scores.

Anchors meet all rows in tiles of bounded size. Every pair score is packed into one binary key (anchor, falling score,
id), rows are dealt by anchor and sorted by that key inside their partitions, and an iterator runs over them once: the
first rows of the anchor's label open windows of scores, rows of other labels that fall into an open window are emitted,
and nothing of an anchor is kept but its open windows. Positives come before negatives of equal score, and a window lies
below its positive's score, so a window is open before its first negative passes.

The same order is used twice. Tiles first send their best rows of the anchor's label, which settles the positives; then
they run the iterator over their own pairs, with the settled positives among them, and send what it emits. So an anchor
has at most as many rows from a tile as windows hold, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaloom.session import stage

POSITIVES = 5
NEGATIVES = 10
# Hundredths of the positive's score between which a negative's score lies.
LEAST_SHARE = 30
MOST_SHARE = 90
# A component counts in units of 1/SCALE.
SCALE = 256
# Anchors and rows of a tile, scores that a task computes at once, and values of a tile's side.
TILE_ANCHORS = 4_096
TILE_ROWS = 65_536
CELLS = 1 << 22
TILE_VALUES = 1 << 22

KEY = np.dtype([("group", ">u8"), ("fall", ">u8"), ("kind", "u1"), ("id", ">u8")])
_SIGN = np.uint64(1 << 63)


def usable(vector: str) -> Column:
    """Whether a vector takes part: not null or empty, without null or non-finite components."""
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & (F.size(vector) > 0), F.lit(False))


# --- keys ---------------------------------------------------------------------------------------------------------------


def pack(group: np.ndarray, score: np.ndarray, negative: np.ndarray, ids: np.ndarray) -> pa.Array:
    """Keys whose byte order is: group, falling score, positives first, rising id."""
    keys = np.empty(len(ids), KEY)
    keys["group"] = group.view(np.uint64) ^ _SIGN
    keys["fall"] = ~(score.view(np.uint64) ^ _SIGN)
    keys["kind"] = negative
    keys["id"] = ids.view(np.uint64) ^ _SIGN
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(KEY.itemsize), len(keys), [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary())


def unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``group, score, negative, id`` of packed keys."""
    keys = np.frombuffer(b"".join(column.to_pylist()), KEY)
    group = (keys["group"].astype(np.uint64) ^ _SIGN).view(np.int64)
    score = (~keys["fall"].astype(np.uint64) ^ _SIGN).view(np.int64)
    return group, score, keys["kind"] != 0, (keys["id"].astype(np.uint64) ^ _SIGN).view(np.int64)


# --- the iterator -------------------------------------------------------------------------------------------------------


class Windows:
    """Runs over sorted rows ``(group, score, negative, id)``; ``emit`` yields ``(group, positive, score, rank, id, score)``.

    A positive is ``(score, id)``. Holds the open windows of one group and the number of positives seen, no rows.
    """

    def __init__(self, positives: int, negatives: int):
        self.most, self.each = positives, negatives
        self.group: int | None = None
        self.open: list[list[int]] = []
        self.seen = 0

    def emit(self, rows: Iterator[tuple[int, int, bool, int]]) -> Iterator[tuple[int, int, int, int, int, int]]:
        for group, score, negative, row_id in rows:
            if group != self.group:
                self.group, self.open, self.seen = group, [], 0
            if not negative:
                if self.seen < self.most:
                    self.seen += 1
                    self.open.append([score, row_id, 0])
                continue
            # A window that this row is below, or that is full, takes no later row either.
            self.open = [w for w in self.open if w[2] < self.each and LEAST_SHARE * w[0] <= 100 * score]
            for window in self.open:
                if 100 * score <= MOST_SHARE * window[0]:
                    window[2] += 1
                    yield group, window[1], window[0], window[2], row_id, score


# --- tiles --------------------------------------------------------------------------------------------------------------


def _integers(column: pa.Array) -> np.ndarray:
    """Rows of a list column as whole numbers of 1/SCALE, in doubles (exact) as long as they fit."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        whole = np.nan_to_num(np.floor(flat * SCALE))
    return whole.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers as 64-bit integers; what does not fit becomes the nearest that does."""
    most = float(np.abs(left).max(initial=0)), float(np.abs(right).max(initial=0))
    if most[0] * most[1] * left.shape[1] < 2**53:
        return (left @ right.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in left.tolist()], object) @ np.array([[int(x) for x in row] for row in right.tolist()], object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def _parts(n: int, width: int, rows: int) -> int:
    return max(1, -(-n // max(1, min(rows, TILE_VALUES // max(1, width)))))


def mine(
    vectors: DataFrame,
    anchors: Column,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: Column | str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows that ``anchors`` selects.

    A row's score is its integer inner product with the anchor, higher first, ties by smaller id. Positives are an anchor's
    first rows of its label, negatives of a positive the first rows of other labels with a score between 30 and 90 hundredths
    of the positive's. Rows without id, label or vector, with an empty vector or a null or non-finite component, or with a
    length other than the commonest take no part. Rows that are equal in id, label and vector are one; other rows
    that share an id are rows of their own, but none is a positive or negative of another. Other columns are not read.
    """
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("id"),
        (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"),
        F.col(vector).alias("vector"),
        F.coalesce(anchors, F.lit(False)).alias("asks"),
    ).where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable("vector"))
    lengths = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    width = lengths["d"] if lengths else 0
    rows = rows.where(F.size("vector") == width).dropDuplicates(["id", "label", "vector"])
    rows = stage(rows.withColumn("group", F.xxhash64("id", "label", "vector")), "rows")
    asking = rows.where("asks").select("group", "id", "label", "vector")
    n_rows, n_asking = rows.count(), asking.count()
    parts = _parts(n_asking, width, TILE_ANCHORS), _parts(n_rows, width, TILE_ROWS)
    deal = lambda n: F.pmod(F.xxhash64("group", F.lit(1)), F.lit(n)).cast("int")
    across = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    right = rows.select(across(parts[0]).alias("a"), deal(parts[1]).alias("b"), "id", "label", "vector")
    left = asking.withColumn("a", deal(parts[0]))

    def best(own: pa.Table, others: pa.Table) -> pa.Table:
        out = []
        for rows, scores, same, _, ids in _tile(own, others):
            for i, row in enumerate(rows):
                at = np.flatnonzero(same[i])
                at = at[np.lexsort((ids[at], -scores[i, at]))[:positives]]
                out.append(_keys(own, row, scores[i, at], np.zeros(len(at), bool), ids[at]))
        return _key_table(out)

    tiles = left.select("a", across(parts[1]).alias("b"), "group", "id", "label", "vector").groupBy("a", "b")
    firsts = tiles.cogroup(right.groupBy("a", "b")).applyInArrow(best, "group long, key binary")
    # The first rows of a label come first in every group, so this run keeps so many of each.
    firsts = stage(_sorted(firsts).mapInArrow(_first(positives), "group long, key binary"), "positives")
    settled = firsts.groupBy("group").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    known = stage(left.join(settled, "group"), "anchors")

    def within(own: pa.Table, others: pa.Table) -> pa.Table:
        out, opened = [], [unpack(keys.values) for keys in own["keys"]]
        for rows, scores, _, unlike, ids in _tile(own, others):
            for i, row in enumerate(rows):
                _, marks, _, named = opened[row]
                # The outer edges of all windows, in whole scores.
                low, high = -(-LEAST_SHARE * int(marks.min()) // 100), MOST_SHARE * int(marks.max()) // 100
                some = np.flatnonzero(unlike[i] & (scores[i] >= low) & (scores[i] <= high))
                some = some[np.lexsort((ids[some], -scores[i, some]))]
                # A window emits the first rows below its upper edge, so no others matter here.
                edges = np.searchsorted(-scores[i, some], [-(MOST_SHARE * m // 100) for m in marks.tolist()])
                some = some[np.unique(np.concatenate([np.arange(e, min(e + negatives, len(some))) for e in edges]))]
                own_rows = [(0, int(s), False, int(x)) for s, x in zip(marks, named, strict=True)]
                own_rows += [(0, s, True, x) for s, x in zip(scores[i, some].tolist(), ids[some].tolist(), strict=True)]
                own_rows.sort(key=lambda r: (-r[1], r[2], r[3]))
                kept = sorted({(s, x) for *_, x, s in Windows(len(marks), negatives).emit(iter(own_rows))})
                s, x = (np.array(v, np.int64) for v in (zip(*kept, strict=True) if kept else ((), ())))
                out.append(_keys(own, row, s, np.ones(len(x), bool), x))
        return _key_table(out)

    tiles = known.select("a", across(parts[1]).alias("b"), "group", "id", "label", "vector", "keys").groupBy("a", "b")
    found = tiles.cogroup(right.groupBy("a", "b")).applyInArrow(within, "group long, key binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(positives, negatives)
        names = ["group", "positive_id", "positive_score", "rank", "negative_id", "negative_score"]
        for batch in batches:
            rows = zip(*(x.tolist() for x in unpack(batch.column(1))), strict=True)
            emitted = list(windows.emit(rows))
            columns = [pa.array(x, pa.int64()) for x in zip(*emitted, strict=True)] if emitted else [pa.array([], pa.int64())] * 6
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "group long, positive_id long, positive_score long, rank long, negative_id long, negative_score long"
    mined = _sorted(firsts.union(found)).mapInArrow(run, schema)
    named = mined.join(asking.select("group", F.col("id").alias("anchor_id")), "group")
    return named.select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )


def _sorted(keys: DataFrame) -> DataFrame:
    """The secondary sort: all keys of a group in one partition, in their order."""
    return keys.repartition("group").sortWithinPartitions("key")


def _first(most: int):
    """The first ``most`` keys of every group of sorted keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            keep = []
            for group in batch.column(0).to_pylist():
                last, seen = group, seen + 1 if group == last else 1
                keep.append(seen <= most)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def _tile(own: pa.Table, others: pa.Table) -> Iterator[tuple[range, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of a tile: the anchors' places, their scores with all rows, whether labels are equal or not, and the rows' ids.

    Rows that share the anchor's id are neither.
    """
    if not own.num_rows or not others.num_rows:
        return
    asks, rows = _integers(own["vector"].combine_chunks()), _integers(others["vector"].combine_chunks())
    ids, labels = others["id"].to_numpy(), others["label"].to_numpy()
    own_ids, own_labels = own["id"].to_numpy(), own["label"].to_numpy()
    step = max(1, CELLS // len(ids))
    for begin in range(0, len(asks), step):
        end = min(len(asks), begin + step)
        scores = products(asks[begin:end], rows)
        same, other = own_labels[begin:end, None] == labels, own_ids[begin:end, None] != ids
        yield range(begin, end), scores, same & other, ~same & other, ids


def _keys(own: pa.Table, row: int, scores: np.ndarray, negative: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    return np.full(len(ids), own["group"][row].as_py(), np.int64), scores, negative, ids


def _key_table(parts: list[tuple[np.ndarray, ...]]) -> pa.Table:
    if not parts:
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.binary())], names=["group", "key"])
    group, scores, negative, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
    return pa.table([pa.array(group), pack(group, scores, negative, ids)], names=["group", "key"])
