"""Set-similarity self-join of documents on word shingles, by grouped prefixes.

1. Documents with equal shingle sets are one class, represented by its smallest id.
2. All sets are put in one order, shingles that are to be expected often last. Two sets of at least the wanted similarity share a shingle
   among their first ``n - ceil(t n) + 1``: the prefix. Classes of equal size and prefix collapse into one group.
3. Groups that share a prefix shingle are candidates if their sizes and the places of the shingle allow the
   similarity. In a list of more than ``LIST`` groups, each is paired with the list's first one only.
4. Candidates, and the members of a group with its first one, are expanded and verified on the texts.
5. What the first round left open is all that remains: members of different components that share a shingle, in long
   lists or in groups of several members, and were not yet compared. These pairs are verified too, so that no link
   between two components is lost; pairs inside a component need no second proof.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaloom.llm.common import sent, shingle_sets, slices, weighed_shingle_sets, word_hashes
from qaloom.llm.graph import components
from qaloom.session import broadcast_if_small, is_small, settle, stage, staged_so_far

# Lists of more groups are compared by their first group, then by component.
LIST = 32
# The order of shingles knows so many of the commonest words, and of the commonest shingles.
COMMON = 200_000
WORDS, SHINGLES, TOTAL = 0, 1, 2
SKETCH_BITS = 2048


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in smaller pieces, so that a task holds few sets at a time."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def _sets(texts: pa.Array, shingle: int) -> list[np.ndarray]:
    return shingle_sets(texts.cast(pa.binary()).to_pylist(), shingle)


def _counted(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of all arrays and how often each occurs, sorted in place."""
    values = np.concatenate(sets)
    values.sort()
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(values)), bool), values[1:] != values[:-1]]))
    return values[first], np.diff(np.append(first, len(values)))


class Rarity:
    """How often a shingle is to be expected: from the shares of its words, or more often if it was seen more often.

    Only the commonest words and shingles have an entry, so the size is bounded. All that matters for results is that
    a shingle has the same value everywhere.
    """

    def __init__(self, words: tuple[np.ndarray, np.ndarray], shingles: tuple[np.ndarray, np.ndarray], total: int):
        self.words, counts = words
        self.shingles, self.seen = shingles
        self.log_total = float(np.log(max(total, 1)))
        self.logs = np.log(counts) - self.log_total
        self.rare = float(self.logs.min(initial=0.0)) - 1.0

    def weigh(self, words: np.ndarray) -> np.ndarray:
        """Logarithms of the shares of words."""
        if not len(self.words):
            return np.full(len(words), self.rare)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.logs[at], self.rare)

    def rank(self, tokens: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Logarithms of the expected numbers of occurrences."""
        expected = weights + self.log_total
        if len(self.shingles):
            at = np.minimum(np.searchsorted(self.shingles, tokens), len(self.shingles) - 1)
            expected = np.where(self.shingles[at] == tokens, np.maximum(expected, np.log(self.seen[at])), expected)
        return expected


def rarity(docs: DataFrame, shingle: int) -> Rarity:
    """Counted over all documents; a piece of a batch reports the words and shingles that it holds several times.

    At most ``COMMON`` words and shingles reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, 4000):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            least = max(3, len(texts) // 2000)
            tokens, held = _counted(shingle_sets(texts, shingle))
            total, words, n = 0, [], []
            for part in slices(texts):
                own, _ = word_hashes([text.lower() for text in part])
                keys, counts = np.unique(own, return_counts=True)
                total, words, n = total + len(own), [*words, keys], [*n, counts]
            keys, where = np.unique(np.concatenate(words), return_inverse=True)
            counts = np.bincount(where, np.concatenate(n), len(keys)).astype(np.int64)
            some, often = counts >= least, held >= least
            found = np.concatenate([keys[some], tokens[often], np.zeros(1, np.uint64)])
            kinds = np.repeat([WORDS, SHINGLES, TOTAL], [some.sum(), often.sum(), 1])
            sums = np.concatenate([counts[some], held[often], [total]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds, pa.int64()), pa.array(found.view(np.int64)), pa.array(sums, pa.int64())], names=["kind", "token", "n"]
            )

    found = docs.mapInArrow(run, "kind long, token long, n long").groupBy("kind", "token").agg(F.sum("n").alias("n"))
    found = stage(found, "common")

    def commonest(kind: int) -> tuple[np.ndarray, np.ndarray]:
        table = found.where(F.col("kind") == kind).orderBy(F.desc("n"), "token").limit(COMMON).toPandas()
        tokens = table["token"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(tokens)
        return tokens[order], table["n"].to_numpy(np.int64)[order]

    _, total = commonest(TOTAL)
    return Rarity(commonest(WORDS), commonest(SHINGLES), int(total.sum()))


def features(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``doc_id, n, same, head, prefix, sketch``: set size, digests of the set and of its prefix, and the prefix in order.

    The sketch has a bit for each of ``SKETCH_BITS`` parts of the shingles: whether the set holds an odd number of it.
    """
    held = sent(docs.sparkSession, rarity(docs, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        known = held()
        for batch in _parts(batches):
            n, same, head, prefix, offsets, sketch = [], [], [], [], [0], []
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for tokens, weights in weighed_shingle_sets(texts, shingle, known.weigh):
                size = len(tokens)
                odd = np.bincount((tokens >> np.uint64(40)).astype(np.int64) % SKETCH_BITS, minlength=SKETCH_BITS) & 1
                sketch.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                n.append(size)
                same.append(blake2b(tokens.tobytes(), digest_size=16).digest() if size else None)
                length = size - (percent * size + 99) // 100 + 1 if size else 0
                first = tokens[np.argsort(known.rank(tokens, weights), kind="stable")[:length]]
                head.append(blake2b(first.tobytes(), digest_size=16).digest() if size else None)
                prefix.append(first)
                offsets.append(offsets[-1] + len(first))
            values = np.concatenate(prefix).view(np.int64) if prefix else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))
            bits = pa.array(np.concatenate(sketch) if sketch else np.empty(0, np.int64))
            sketches = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * (SKETCH_BITS // 64), pa.int32()), bits)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array(head, pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [*columns, lists, sketches], names=["doc_id", "n", "same", "head", "prefix", "sketch"]
            )

    return docs.mapInArrow(run, "doc_id long, n long, same binary, head binary, prefix array<long>, sketch array<long>")


def _not_apart(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Pairs without those whose sketches already differ in more shingles than the similarity allows.

    Every shingle that only one of two sets holds changes one bit, so no two sets differ in fewer shingles than bits.
    """
    sketches = known.select("doc_id", "n", "sketch")
    one = sketches.withColumnsRenamed({"doc_id": "a", "n": "n_a", "sketch": "sketch_a"})
    two = sketches.withColumnsRenamed({"doc_id": "b", "n": "n_b", "sketch": "sketch_b"})
    bits = "aggregate(zip_with(sketch_a, sketch_b, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    return pairs.join(one, "a").join(two, "b").where(f"{100 + percent} * {bits} <= {100 - percent} * (n_a + n_b)").select("a", "b")


def verify(pairs: DataFrame, known: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose texts have the wanted similarity. ``known`` has the features of ``docs``.

    Only texts that some pair needs are shuffled; where few are needed, the list of their ids is broadcast.
    """
    pairs = stage(_not_apart(pairs, known, percent).distinct(), "pairs")
    wanted = stage(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "wanted")
    texts = docs.join(F.broadcast(wanted) if is_small(wanted) else wanted, "doc_id", "left_semi")
    left = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    right = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    both = pairs.join(left, "b").join(right, "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            links = []
            ones, twos = _sets(batch.column(2), shingle), _sets(batch.column(3), shingle)
            for row, (one, two) in enumerate(zip(ones, twos, strict=True)):
                shared = len(np.intersect1d(one, two, assume_unique=True))
                if 100 * shared >= percent * (len(one) + len(two) - shared):
                    links.append(row)
            yield batch.select([0, 1]).take(pa.array(links, pa.int64()))

    return both.mapInArrow(run, "a long, b long")


def _possible(percent: int) -> str:
    """Whether sizes and places of a shared shingle allow the similarity, for rows ``x`` and ``y`` of a list.

    If this is the first shingle that both share, no more than the shingles from here on can be shared.
    """
    return (
        f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) AND "
        f"{100 + percent} * least(x.n - x.pos, y.n - y.pos) >= {percent} * (x.n + y.n)"
    )


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row: set size, and the smallest id reachable by links.

    Two documents link when ``100 * intersection >= percent * union`` of their sets of ``shingle``-word shingles. A
    text that is null or has no word has an empty set, links with nothing and is its own component. A row without id
    links with nothing and has no component. Rows that share an id are one node. Other columns are not read.
    """
    since = staged_so_far(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    known = stage(features(docs, shingle, percent), "features")
    usable = known.where("n > 0 AND doc_id IS NOT NULL")
    classes = stage(usable.groupBy("n", "same").agg(F.min("doc_id").alias("rep"), F.first("head").alias("head")), "classes")
    groups = stage(classes.groupBy("n", "head").agg(F.min("rep").alias("gid"), F.count("*").alias("members")), "groups")
    members = stage(
        classes.join(groups.where("members > 1"), ["n", "head"]).select("gid", "rep", "n"), "members"
    )

    prefixes = usable.join(groups.select(F.col("gid").alias("doc_id")), "doc_id", "left_semi")
    postings = prefixes.select(F.col("doc_id").alias("gid"), "n", F.posexplode("prefix").alias("pos", "token"))
    counts = postings.groupBy("token").agg(F.count("*").alias("size"), F.min("gid").alias("first")).where("size > 1")
    lists = stage(postings.join(counts, "token"), "lists")

    short = lists.where(f"size <= {LIST}")
    near = short.alias("x").join(short.alias("y"), F.expr(f"x.token = y.token AND x.gid < y.gid AND {_possible(percent)}"))
    near = near.select(F.col("x.gid").alias("a"), F.col("y.gid").alias("b"))
    stars = lists.where(f"size > {LIST} AND first < gid").select(F.col("first").alias("a"), F.col("gid").alias("b"))
    own = members.where("gid < rep").select(F.col("gid").alias("a"), F.col("rep").alias("b"))
    tried = stage(near.union(stars).union(own).distinct(), "tried")
    links = stage(verify(tried, known, docs, shingle, percent), "verified")

    found = stage(components(links), "components")
    rest = _open_pairs(lists, members, found, percent).join(tried, ["a", "b"], "left_anti")
    rest = stage(rest, "open")
    if not rest.isEmpty():
        more = verify(rest, known, docs, shingle, percent)
        found = stage(components(links.union(more)), "components")

    named = classes.select("same", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("same", F.coalesce("component", "rep").alias("_component"))
    rows = known.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("same")).alias("same"))
    found = rows.join(named, "same", "left").select(
        "doc_id", "n_shingles", F.coalesce("_component", "doc_id").alias("component_id")
    )
    return settle(found, "near-duplicates", since)


def _open_pairs(lists: DataFrame, members: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes that share a list but no component, where the first round compared only some of the pairs."""
    others = stage(members.where("gid <> rep").select("gid", "rep"), "others")
    grouped = lists.join(broadcast_if_small(others.select("gid").distinct()), "gid", "left_semi").select("token")
    wanted = stage(grouped.union(lists.where(F.col("size") > LIST).select("token")).distinct(), "open-lists")
    # A class stands in the lists of its group; members of one group have a list of their own.
    placed = lists.join(broadcast_if_small(wanted), "token", "left_semi").select("token", "gid", "n", "pos")
    entries = placed.select("token", F.col("gid").alias("rep"), "n", "pos").union(
        placed.join(others, "gid").select("token", "rep", "n", "pos")
    )
    entries = entries.select(F.struct(F.lit(1).alias("kind"), F.col("token").alias("key")).alias("list"), "rep", "n", "pos")
    inside = members.select(F.struct(F.lit(0), "gid").alias("list"), "rep", "n", F.lit(0).alias("pos"))
    entries = entries.union(inside)
    entries = entries.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    entries = stage(entries.withColumn("component", F.coalesce("component", "rep")), "entries")
    # Only lists that hold several components are open; all but the largest component meet all others.
    shares = entries.groupBy("list", "component").agg(F.count("*").alias("rows"))
    heads = shares.groupBy("list").agg(
        F.max_by("component", F.struct("rows", "component")).alias("main"),
        F.count("*").alias("kinds"),
    )
    unsettled = stage(heads.where("kinds > 1").select("list", "main"), "unsettled")
    rows = entries.join(unsettled, "list")
    minor = rows.where("component <> main")
    either = minor.alias("x").join(
        rows.alias("y"), F.expr(f"x.list = y.list AND x.component <> y.component AND {_possible(percent)}")
    )
    pairs = either.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))
    return pairs.distinct()
