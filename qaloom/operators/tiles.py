"""Exact similarity between two vector tables in blocks of bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Scores that are computed at once (8 MB) for so many left rows, of these scores that fit a cache, rows whose scores are computed
# again at once, rows of a tile's two sides, and elements (rows x dimensions) of a side.
SCORE_CELLS = 1 << 21
PART_ROWS = 1 << 10
CACHED_CELLS = 1 << 18
EXACT_ROWS = 1 << 15
LEFT_ROWS = 1 << 15
RIGHT_ROWS = 1 << 16
BLOCK_ELEMENTS = 1 << 22


def blocks_for(rows: int, dimensions: int, block_rows: int) -> int:
    """Blocks of at most ``block_rows`` rows and ``BLOCK_ELEMENTS`` elements that hold ``rows`` vectors."""
    per_block = max(1, min(block_rows, BLOCK_ELEMENTS // max(1, dimensions)))
    return max(1, -(-rows // per_block))


def usable(vector: str, dimensions: int) -> Column:
    """Whether a vector has the wanted length and only finite components."""
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == dimensions) & ~bad, F.lit(False))


def unit_rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column as float64 unit vectors; a zero vector stays zero."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    norms[norms == 0] = 1.0
    return matrix / norms[:, None]


def best_in_tile(scores: np.ndarray, tie: np.ndarray, k: int, decimals: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the ``k`` best columns per row by rounded score, ties by ``tie``; no score that is not finite."""
    scores = np.where(np.isfinite(scores), scores, -np.inf)
    if scores.shape[1] > k:
        # Whatever may round up to the k-th best score stays in.
        threshold = np.partition(scores, -k, axis=1)[:, -k] - 10.0**-decimals
        rows, cols = np.nonzero(scores >= threshold[:, None])
    else:
        rows, cols = np.nonzero(np.isfinite(scores))
    values = np.round(scores[rows, cols], decimals)
    kept = np.isfinite(values)
    rows, cols, values = rows[kept], cols[kept], values[kept]
    keep = best_per_row(rows, values, tie[cols], k)
    return rows[keep], cols[keep]


def best_per_row(rows: np.ndarray, values: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best values of every row, best first, ties by ``tie``."""
    order = np.lexsort((np.unique(tie, return_inverse=True)[1] if tie.dtype == object else tie, -values, rows))
    own = rows[order]
    return order[np.arange(len(own)) - np.searchsorted(own, own, side="left") < k]


def single_error(dimensions: int) -> float:
    """More than a product of unit vectors can be off in single precision."""
    return (dimensions + 8) * 2.0**-23


def at_least(scores: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Places in the flattened scores of those that are no less than their row's least; few are expected."""
    kept = (scores >= np.nextafter(least.astype(np.float32), np.float32(-np.inf))[:, None]).reshape(-1)
    if len(kept) % 8:
        return np.flatnonzero(kept)
    # Eight at a time.
    some = np.flatnonzero(kept.view(np.uint64))
    places = (some[:, None] * 8 + np.arange(8)).reshape(-1)
    return places[kept[places]]


def nth_best(scores: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th best score of every row, which may be minus infinity."""
    if scores.shape[1] < k:
        return np.full(len(scores), -np.inf)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k].astype(np.float64)


def smallest(ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the smallest ids, ``k`` of them at least besides the copies of any one id."""
    order = np.argsort(ids, kind="stable")
    own = ids[order]
    edges = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
    return order[: k + (int(np.diff(edges).max()) if len(ids) else 0)]


class BestHits:
    """The ``k`` best right rows of every left row, over slices of the right side as they come.

    Scores are computed in single precision. Those that can be among the best by more than the error, few after the first
    slices, are computed again in doubles. A left row of length 0 scores 0 with all, so the smallest ids are its best.
    """

    def __init__(self, left: np.ndarray, left_ids: np.ndarray, k: int, decimals: int, exclude_same_id: bool):
        self.ids, self.k = left_ids, k
        self.peak = 0
        # Where an id comes again, its first row alone leaves out the same id.
        first = np.zeros(len(left), bool)
        if exclude_same_id:
            order = np.argsort(left_ids, kind="stable")
            own = left_ids[order]
            first[order] = np.concatenate([np.ones(min(1, len(own)), bool), own[1:] != own[:-1]])
        some = left.any(axis=1)
        rows = np.flatnonzero(some)
        self.parts = [
            _Part(left, left_ids, first, part, k, decimals) for part in np.array_split(rows, -(-len(rows) // PART_ROWS) or 1) if len(part)
        ]
        self.nulls = _Part(left, left_ids, first, np.flatnonzero(~some), k, decimals)

    def add(self, right: np.ndarray, right_ids: np.ndarray) -> None:
        if not len(right_ids):
            return
        single = np.ascontiguousarray(right.T, np.float32)
        longest = float(np.sqrt(np.einsum("ij,ij->i", right, right).max(initial=0.0)))
        for part in self.parts:
            step = max(1, SCORE_CELLS // len(part.rows))
            for begin in range(0, len(right_ids), step):
                self.peak = max(self.peak, part.add(right[begin : begin + step], single[:, begin : begin + step], right_ids[begin : begin + step], longest))
        if len(self.nulls.rows):
            some = smallest(right_ids, self.k)
            row, place = np.divmod(np.arange(len(self.nulls.rows) * len(some)), len(some))
            self.nulls.hold(row, right_ids[some[place]], np.zeros(len(row)))

    @property
    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Left rows, right ids and scores, by left row and best first."""
        found = [part.best() for part in (*self.parts, self.nulls)]
        rows, ids, scores = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(rows, kind="stable")
        return rows[order], ids[order], scores[order]

    rows, found, scores = (property(lambda self, i=i: self.hits[i]) for i in range(3))


class _Part:
    """Some left rows with their best hits so far, and others that wait to be compared with them."""

    def __init__(self, left: np.ndarray, left_ids: np.ndarray, first: np.ndarray, rows: np.ndarray, k: int, decimals: int):
        self.rows, self.left, self.single = rows, left[rows], left[rows].astype(np.float32)
        self.ids, self.first, self.k, self.decimals = left_ids[rows], first[rows], k, decimals
        self.margin = 10.0**-decimals
        self.error = single_error(left.shape[1]) * np.sqrt(np.einsum("ij,ij->i", self.left, self.left))
        self.bar = np.full(len(rows), -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0
        self.buffer = np.empty(0, np.float32)
        # Rows that leave out their own id, in the order of the ids.
        own = np.flatnonzero(self.first)
        self.own = own[np.argsort(self.ids[own], kind="stable")]

    def add(self, right: np.ndarray, single: np.ndarray, ids: np.ndarray, longest: float) -> int:
        m, n = len(self.rows), len(ids)
        error = self.error * longest
        least = self.bar - error
        if not (unbarred := np.flatnonzero(np.isneginf(self.bar))).size:
            # In pieces that stay in the cache.
            step = max(1, CACHED_CELLS // m)
            found = [self._reached(single[:, begin : begin + step], least, begin) for begin in range(0, n, step)]
            row, place = (np.concatenate(x) for x in zip(*found, strict=True))
        else:
            scores = self.single @ single
            if len(self.own):
                sorted_ids = self.ids[self.own]
                at = np.minimum(np.searchsorted(sorted_ids, ids), len(sorted_ids) - 1)
                same = np.flatnonzero(sorted_ids[at] == ids)
                scores[self.own[at[same]], same] = -np.inf
            # Whatever may round up to the k-th best score stays in.
            least[unbarred] = nth_best(scores[unbarred], self.k) - 2 * error[unbarred] - self.margin
            row, place = np.divmod(at_least(scores, least), n)
        exact = np.empty(len(row))
        for begin in range(0, len(row), EXACT_ROWS):
            some = slice(begin, begin + EXACT_ROWS)
            exact[some] = np.einsum("ij,ij->i", self.left[row[some]], right[place[some]])
        kept = np.isfinite(exact) & (exact >= self.bar[row])
        self.hold(row[kept], ids[place[kept]], exact[kept])
        return m * n

    def _reached(self, single: np.ndarray, least: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
        m, n = len(self.rows), single.shape[1]
        if len(self.buffer) < m * n:
            self.buffer = np.empty(m * n, np.float32)
        row, place = np.divmod(at_least(np.matmul(self.single, single, out=self.buffer[: m * n].reshape(m, n)), least), n)
        return row, place + begin

    def hold(self, row: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        kept = ~(self.first[row] & (self.ids[row] == ids))
        self.held.append((row[kept], ids[kept], scores[kept]))
        self.waiting += int(kept.sum())
        if np.isneginf(self.bar).any() or 2 * self.waiting > self.k * len(self.rows):
            self.settle()

    def settle(self) -> None:
        if not self.held:
            return
        row, ids, scores = (np.concatenate(x) for x in zip(*self.held, strict=True))
        values = np.round(scores, self.decimals)
        keep = best_per_row(row, values, ids, self.k)
        row, values = row[keep], values[keep]
        self.held, self.waiting = [(row, ids[keep], scores[keep])], 0
        hits = np.bincount(row, minlength=len(self.rows))
        full = hits == self.k
        self.bar[full] = values[(np.cumsum(hits) - 1)[full]] - self.margin

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.settle()
        if not self.held:
            return np.empty(0, np.int64), self.ids[:0], np.empty(0)
        row, ids, scores = self.held[0]
        return self.rows[row], ids, scores


def tiled(left: DataFrame, right: DataFrame, left_id: str, right_id: str, n_left: int, n_right: int, partitions: int):
    """Cogroup two tables by tile: each row is repeated once per block of the other side."""
    left_tiles = left.withColumn("_lb", F.pmod(F.xxhash64(left_id), F.lit(n_left)).cast("int")).withColumn(
        "_rb", F.explode(F.sequence(F.lit(0), F.lit(n_right - 1)))
    )
    right_tiles = right.withColumn("_rb", F.pmod(F.xxhash64(right_id), F.lit(n_right)).cast("int")).withColumn(
        "_lb", F.explode(F.sequence(F.lit(0), F.lit(n_left - 1)))
    )
    # A named number of partitions is kept; few tiles share one.
    left_tiles, right_tiles = (side.repartition(partitions, "_lb", "_rb") for side in (left_tiles, right_tiles))
    return left_tiles.groupBy("_lb", "_rb").cogroup(right_tiles.groupBy("_lb", "_rb"))
