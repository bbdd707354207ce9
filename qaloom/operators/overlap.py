"""Scores of generated text against a reference: n-gram overlap, longest common subsequence, token matching."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from qaloom.functions.text import ascii_terms, words
from qaloom.operators.tiles import unit_rows
from qaloom.session import broadcast_if_small, stage

# Fixed value: the numerator BLEU smoothing puts in place of zero matches.
SMOOTHING = 0.1


# A way to look at texts: its name, the tokenizer, and the n-gram sizes to count.
View = tuple[str, Callable[[str], Column], Sequence[int]]
BLEU_VIEW: View = ("bleu", words, (1, 2, 3, 4))


def rouge_view(sizes: Sequence[int] = (1, 2)) -> View:
    return "rouge", ascii_terms, sizes


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of ``n`` tokens as texts joined by a blank; none if there are fewer tokens."""
    if n == 1:
        return tokens
    starts = F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - (n - 1), F.lit(0)))
    return F.transform(starts, lambda first, i: F.concat_ws(" ", first, *[F.get(tokens, i + j) for j in range(1, n)]))


def clipped_matches(pairs: DataFrame, key: str, candidate: str, reference: str, views: Sequence[View]) -> DataFrame:
    """Per key, view and n: n-grams of either side and the matches, each counted at most as often as in the other side.

    Every row is counted where it lies, and only its counts leave the task. Rows that share a key, which count together, are
    found by these counts and alone are shuffled with their texts.
    """
    texts = pairs.select(key, F.col(candidate).alias("_c"), F.col(reference).alias("_r"))
    runs = [(name, n) for name, _, sizes in views for n in sizes]
    kind = pairs.schema[key].dataType.simpleString()
    tokens = [F.coalesce(tokenize(side), F.array()).alias(f"{side}_{name}") for name, tokenize, _ in views for side in ("_c", "_r")]
    sizes = [tuple(sizes) for _, _, sizes in views]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _of_tokens(batch):
                run = 0
                for view, ns in enumerate(sizes):
                    for counts in clipped_in_rows(some.column(1 + 2 * view), some.column(2 + 2 * view), ns):
                        columns = [some.column(0), pa.array(np.full(some.num_rows, run, np.int32)), *map(pa.array, counts)]
                        yield pa.RecordBatch.from_arrays(columns, names=["_key", "run", "matches", "candidate_grams", "reference_grams"])
                        run += 1

    schema = f"_key {kind}, run int, matches long, candidate_grams long, reference_grams long"
    counted = stage(texts.select(F.col(key).alias("_key"), *tokens).mapInArrow(count, schema), "overlap-counts")
    again = counted.where("run = 0").groupBy("_key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("_key").alias("_again"))
    again = stage(again, "repeated-keys")
    if not again.isEmpty():
        again = broadcast_if_small(again)
        together = texts.withColumnRenamed(key, "_key").join(again, F.col("_key").eqNullSafe(F.col("_again")), "left_semi")
        counted = counted.join(again, F.col("_key").eqNullSafe(F.col("_again")), "left_anti").unionByName(_clipped_together(together, views, runs))
    names, lengths = F.array(*[F.lit(name) for name, _ in runs]), F.array(*[F.lit(n) for _, n in runs])
    return counted.select(
        F.col("_key").alias(key),
        F.get(names, F.col("run")).alias("view"),
        F.get(lengths, F.col("run")).alias("n"),
        "matches",
        "candidate_grams",
        "reference_grams",
    )


# Tokens of rows that are counted at once in a task; a longer row stands alone.
COUNTED_TOKENS = 1 << 18


def _of_tokens(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows of about ``COUNTED_TOKENS`` tokens together."""
    sizes = sum(pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64) for column in batch.columns[1:])
    number = (np.cumsum(sizes) - sizes) // COUNTED_TOKENS
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1, [len(number)]]).tolist()
    for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(begin, end - begin)


def clipped_in_rows(candidates: pa.ListArray, references: pa.ListArray, sizes: Sequence[int]) -> list[tuple[np.ndarray, ...]]:
    """For each size, matches, candidate n-grams and reference n-grams of every row of two lists of tokens."""
    rows = len(candidates)
    both = pa.concat_arrays([candidates.flatten(), references.flatten()]).dictionary_encode()
    codes = both.indices.to_numpy().astype(np.int64)
    lengths = np.concatenate([pc.list_value_length(side).to_numpy(zero_copy_only=False) for side in (candidates, references)]).astype(np.int64)
    # Tokens of the text from each token on, itself included.
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))
    owner = np.repeat(np.arange(2 * rows), lengths)
    # A run of n tokens gets a number by the number of the run of its first n - 1 and its last token.
    number, at, n = codes, np.arange(len(codes)), 1
    found: dict[int, tuple[np.ndarray, ...]] = {}
    for size in sorted(sizes):
        while n < size:
            keep = left[at] > n
            at = at[keep]
            number = np.unique(number[keep] * (len(both.dictionary) + 1) + codes[at + n], return_inverse=True)[1].astype(np.int64)
            n += 1
        side, row = np.divmod(owner[at], rows) if rows else (owner[at], owner[at])
        keyed = row * (number.max() + 1 if len(number) else 1) + number
        kinds, first, times = np.unique(keyed, return_index=True, return_inverse=True)
        in_c = np.bincount(times[side == 0], minlength=len(kinds))
        in_r = np.bincount(times[side == 1], minlength=len(kinds))
        found[size] = tuple(np.bincount(row[first], weights, rows).astype(np.int64) for weights in (np.minimum(in_c, in_r), in_c, in_r))
    return [found[size] for size in sizes]


def _clipped_together(placed: DataFrame, views: Sequence[View], runs: list[tuple[str, int]]) -> DataFrame:
    """``_key, run`` and the counts of rows that share keys; their n-grams are exploded, counted and summed by key."""
    placed, key = placed.repartition("_key"), "_key"
    tokens = [F.coalesce(tokenize(side), F.array()).alias(f"{side}_{name}") for name, tokenize, _ in views for side in ("_c", "_r")]

    def counted_once(run: int, side: str) -> Column:
        name, n = runs[run]
        in_c, in_r = F.lit(int(side == "_c")).alias("c"), F.lit(int(side == "_r")).alias("r")
        return F.transform(
            ngrams(F.col(f"{side}_{name}"), n), lambda g: F.struct(F.lit(run).alias("run"), g.alias("gram"), in_c, in_r)
        )

    # One empty entry per run keeps pairs without any n-gram; it never counts.
    zero = F.lit(0)
    markers = F.array(
        *[F.struct(F.lit(i).alias("run"), F.lit("").alias("gram"), zero.alias("c"), zero.alias("r")) for i in range(len(runs))]
    )
    entries = F.concat(markers, *[counted_once(i, side) for i in range(len(runs)) for side in ("_c", "_r")])
    grams = placed.select(key, *tokens).select(key, F.inline_outer(entries))
    counted = grams.groupBy(key, "run", "gram").agg(F.sum("c").alias("c"), F.sum("r").alias("r"))
    return counted.groupBy(key, "run").agg(
        F.sum(F.least("c", "r")).alias("matches"),
        F.sum("c").alias("candidate_grams"),
        F.sum("r").alias("reference_grams"),
    )


def f_measure(precision: Column, recall: Column) -> Column:
    return F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))


def overlap_precision() -> Column:
    return F.coalesce(F.try_divide("matches", "candidate_grams"), F.lit(0.0))


def overlap_recall() -> Column:
    return F.coalesce(F.try_divide("matches", "reference_grams"), F.lit(0.0))


def rouge_n(
    pairs: DataFrame,
    key: str = "pair_id",
    candidate: str = "prediction",
    reference: str = "answer",
    sizes: Sequence[int] = (1, 2),
) -> DataFrame:
    """ROUGE-n precision, recall and F per key and n, over lower-case ASCII words without stemming."""
    counts = clipped_matches(pairs, key, candidate, reference, [rouge_view(sizes)])
    precision, recall = overlap_precision(), overlap_recall()
    return counts.select(
        key, "n", precision.alias("precision"), recall.alias("recall"), f_measure(precision, recall).alias("f")
    )


def bleu_from_counts(counts: DataFrame, key: str, *others: Column) -> DataFrame:
    """One row per key with ``bleu`` from the counts of the BLEU view, and any further aggregates."""
    in_view = F.col("view") == "bleu"
    matched = F.when(F.col("matches") > 0, F.col("matches")).otherwise(F.lit(SMOOTHING))
    precision = matched / F.greatest("candidate_grams", F.lit(1))
    unigram = in_view & (F.col("n") == 1)
    per_key = counts.groupBy(key).agg(
        F.avg(F.when(in_view, F.log(precision))).alias("_log"),
        F.max(F.when(unigram, F.col("matches"))).alias("_unigrams"),
        F.max(F.when(unigram, F.col("candidate_grams"))).alias("_c"),
        F.max(F.when(unigram, F.col("reference_grams"))).alias("_r"),
        *others,
    )
    brevity = F.when(F.col("_c") > F.col("_r"), F.lit(1.0)).otherwise(
        F.exp(F.lit(1.0) - F.try_divide(F.col("_r"), F.col("_c")))
    )
    score = F.when(F.col("_unigrams") > 0, brevity * F.exp("_log")).otherwise(F.lit(0.0))
    return per_key.withColumn("bleu", score).drop("_log", "_unigrams", "_c", "_r")


def bleu4(
    pairs: DataFrame, key: str = "pair_id", candidate: str = "prediction", reference: str = "answer"
) -> DataFrame:
    """Sentence BLEU with n = 1…4, equal weights, brevity penalty and additive smoothing of zero matches."""
    return bleu_from_counts(clipped_matches(pairs, key, candidate, reference, [BLEU_VIEW]), key)


def overlap_scores(
    pairs: DataFrame, key: str = "pair_id", candidate: str = "prediction", reference: str = "answer"
) -> DataFrame:
    """ROUGE-1, ROUGE-2 and BLEU per key from one read of the texts."""
    counts = clipped_matches(pairs, key, candidate, reference, [rouge_view(), BLEU_VIEW])
    f = f_measure(overlap_precision(), overlap_recall())

    def rouge(n: int) -> Column:
        return F.max(F.when((F.col("view") == "rouge") & (F.col("n") == n), f)).alias(f"rouge{n}")

    return bleu_from_counts(counts, key, rouge(1), rouge(2))


# Tokens of a block of the one text, whose places are bits of a number, and of the other text per step between tasks.
LCS_BITS = 8_192
LCS_STEP = 65_536
# Pairs with more cells (tokens times tokens) than this are compared step by step.
LCS_CELLS = 1 << 32


def lcs_block(a: Sequence[str], b: Sequence[str], open_bits: int | None = None, border: int = 0) -> tuple[int, int]:
    """One block of the longest common subsequence: the state of ``a``'s places and the border after all of ``b``.

    A set bit of the state is a place of ``a`` that is not matched so far; the border has a bit for each token of ``b`` that
    carries over into the next block of ``a``. Without a state, all places are open.
    """
    places: dict[str, int] = {}
    for i, token in enumerate(a):
        places[token] = places.get(token, 0) | (1 << i)
    full = (1 << len(a)) - 1
    state = full if open_bits is None else open_bits
    carried = bytearray((len(b) + 7) // 8)
    coming = border.to_bytes(len(carried), "little")
    for j, token in enumerate(b):
        met = state & places.get(token, 0)
        carry = coming[j >> 3] >> (j & 7) & 1
        if met or carry:
            total = state + met + carry
            carried[j >> 3] |= (total >> len(a)) << (j & 7)
            state = (total | (state - met)) & full
    return state, int.from_bytes(carried, "little")


def lcs_length(a: Sequence[str], b: Sequence[str], bits: int | None = None) -> int:
    """Length of the longest common subsequence, block by block of ``a``: memory grows with the texts, not their product."""
    bits, matched, border = bits or LCS_BITS, 0, 0
    for begin in range(0, len(a), bits):
        part = a[begin : begin + bits]
        state, border = lcs_block(part, b, None, border)
        matched += len(part) - state.bit_count()
    return matched


@pandas_udf(T.IntegerType())
def _lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(x, y) for x, y in zip(a, b)], dtype="int32")


def rouge_l(candidate: Column | str, reference: Column | str) -> Column:
    """F-measure of the longest common subsequence of lower-case ASCII words, over the whole texts."""
    c, r = ascii_terms(candidate), ascii_terms(reference)
    common = _lcs(F.coalesce(c, F.array()), F.coalesce(r, F.array()))
    # With P = l/|c| and R = l/|r| the F-measure is 2l/(|c|+|r|).
    return F.coalesce(F.try_divide(2 * common, F.size(c) + F.size(r)), F.lit(0.0))


def rouge_l_rows(
    rows: DataFrame, key: str, candidate: str, reference: str, output: str = "rougel", cells: int | None = None, step: int | None = None
) -> DataFrame:
    """``rows`` with :func:`rouge_l`, where pairs of very long texts are spread over the cluster.

    Such a pair is a grid of steps of ``step`` times ``step`` tokens. A step needs the state of the step before it along one text
    and the border of the one along the other, so all steps of a diagonal run at once, those of all pairs together, and only
    states and borders (a bit a token) go from one diagonal to the next. ``key`` has to be unique.
    """
    cells, step = LCS_CELLS if cells is None else cells, step or LCS_STEP
    c, r = F.coalesce(ascii_terms(candidate), F.array()), F.coalesce(ascii_terms(reference), F.array())
    long = F.size(c).cast("long") * F.size(r) > cells
    asked = stage(rows.where(long).select(F.col(key).alias("_key"), c.alias("_c"), r.alias("_r")), "long-pairs")
    if asked.isEmpty():
        return rows.withColumn(output, rouge_l(candidate, reference))

    # Every pair takes part in the first diagonal, with the beginnings of its own texts: nothing is joined for it.
    beginnings = [F.slice(side, 1, F.lit(step)).alias(f"{name}_tokens") for side, name in (("_c", "_i"), ("_r", "_j"))]
    nothing = [F.lit(None).cast("binary").alias(name) for name in ("state", "border")]
    first = asked.select("_key", F.lit(0).alias("_i"), F.lit(0).alias("_j"), *beginnings, *nothing)
    # The other diagonals have the pairs that reach them alone, and of these the blocks that meet there.
    wide = asked.where((F.size("_c") > step) | (F.size("_r") > step))

    def cut(side: str, name: str, other: str) -> DataFrame:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(side) - 1) / step).cast("int")), lambda i: F.slice(side, i * step + 1, F.lit(step))
        )
        across = F.ceil(F.size(other) / step).cast("int").alias(f"{name}_across")
        return wide.select("_key", across, F.posexplode(blocks).alias(name, f"{name}_tokens"))

    def reaching(blocks: DataFrame, name: str, diagonal: int) -> DataFrame:
        return blocks.where((F.col(name) <= diagonal) & (F.lit(diagonal) - F.col(name) < F.col(f"{name}_across"))).drop(f"{name}_across")

    ups, overs = stage(cut("_c", "_i", "_r"), "lcs-rows"), stage(cut("_r", "_j", "_c"), "lcs-columns")
    last = asked.agg(F.max(F.floor((F.size("_c") - 1) / step) + F.floor((F.size("_r") - 1) / step)).alias("n")).first()["n"]
    kind = rows.schema[key].dataType.simpleString()
    schema = f"_key {kind}, _i int, _j int, state binary, border binary, matched long"
    done = stage(first.mapInArrow(_lcs_step, schema), "lcs-step")
    found = [done.select("_key", "_i", "_j", "matched")]
    for diagonal in range(1, last + 1):
        states = done.select("_key", "_i", (F.col("_j") + 1).alias("_j"), "state")
        borders = done.select("_key", (F.col("_i") + 1).alias("_i"), "_j", "border")
        met = reaching(ups, "_i", diagonal).withColumn("_j", F.lit(diagonal) - F.col("_i")).join(reaching(overs, "_j", diagonal), ["_key", "_j"])
        met = met.join(states, ["_key", "_i", "_j"], "left").join(borders, ["_key", "_i", "_j"], "left")
        met = met.select("_key", "_i", "_j", "_i_tokens", "_j_tokens", "state", "border")
        done = stage(met.mapInArrow(_lcs_step, schema), "lcs-step")
        found.append(done.select("_key", "_i", "_j", "matched"))
    steps = found[0]
    for more in found[1:]:
        steps = steps.union(more)
    # The matches of a row of steps are complete after its last one.
    ends = steps.groupBy("_key", "_i").agg(F.max_by("matched", "_j").alias("matched")).groupBy("_key").agg(F.sum("matched").alias("_lcs"))
    sizes = asked.select("_key", (F.size("_c") + F.size("_r")).alias("_sizes")).join(ends, "_key")
    scores = sizes.select(F.col("_key").alias(key), F.try_divide(2 * F.col("_lcs"), F.col("_sizes")).alias(output))
    short = rows.where(~long).withColumn(output, rouge_l(candidate, reference))
    return short.unionByName(rows.where(long).join(broadcast_if_small(stage(scores, "lcs-scores")), key).select(*rows.columns, output))


def _lcs_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        out = []
        for row in rows:
            a, b = row["_i_tokens"], row["_j_tokens"]
            border = int.from_bytes(row["border"] or b"", "little")
            before = (1 << len(a)) - 1 if row["state"] is None else int.from_bytes(row["state"], "little")
            after, matched = 0, 0
            # Blocks of the step, each with its part of the state.
            for begin in range(0, len(a), LCS_BITS):
                part = a[begin : begin + LCS_BITS]
                own = before >> begin & ((1 << len(part)) - 1)
                own, border = lcs_block(part, b, own, border)
                after |= own << begin
                matched += len(part) - own.bit_count()
            state = after.to_bytes((len(a) + 7) // 8, "little")
            out.append({**{k: row[k] for k in ("_key", "_i", "_j")}, "state": state, "border": border.to_bytes((len(b) + 7) // 8, "little"), "matched": matched})
        kinds = [batch.schema.field("_key").type, pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64()]
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema(list(zip(["_key", "_i", "_j", "state", "border", "matched"], kinds, strict=True))))


# Token vectors of one side of a pair that a task holds at a time; a pair of no more tokens is compared in one piece.
TOKEN_BLOCK = 2048


def greedy_match_f1(
    tokens: DataFrame,
    key: str = "pair_id",
    side: str = "side",
    position: str = "position",
    vector: str = "vector",
    baseline: float = 0.0,
    block: int = TOKEN_BLOCK,
) -> DataFrame:
    """Embedding match of ``candidate`` and ``reference`` tokens: precision, recall and rescaled F per pair.

    Every token takes its best cosine on the other side. Pairs are dealt by key and compared in batches of many; a
    pair of more than ``block`` tokens is cut into blocks of positions and compared block by block, so a text of any
    length fits, and only one maximum per token leaves a block.
    """
    own = tokens.select(
        F.col(key).alias("_key"), F.col(side).alias("_side"), F.col(position).cast("bigint").alias("_at"), F.col(vector).alias("_vector")
    ).where("_key IS NOT NULL AND _side IN ('candidate', 'reference')")
    long = own.groupBy("_key").agg(F.count("*").alias("_n")).where(F.col("_n") > block).select("_key")
    long = stage(long, "long-pairs")
    if long.isEmpty():
        per_pair = _short_pairs(own)
    else:
        long = broadcast_if_small(long)
        per_pair = _short_pairs(own.join(long, "_key", "left_anti")).unionByName(
            _long_pairs(own.join(long, "_key", "left_semi"), block)
        )
    rescaled = (f_measure(F.col("precision"), F.col("recall")) - F.lit(baseline)) / F.lit(1.0 - baseline)
    return per_pair.select(F.col("_key").alias(key), "precision", "recall", rescaled.alias("f1"))


def _short_pairs(tokens: DataFrame) -> DataFrame:
    """``_key, precision, recall`` of pairs whose tokens lie together, many pairs per call."""
    kind = tokens.schema["_key"].dataType.simpleString()

    def best(table: pa.Table) -> tuple[float, float]:
        left = np.array(table["_side"].to_pylist()) == "candidate"
        rows = unit_rows(table["_vector"])
        if not left.any() or left.all():
            return 0.0, 0.0
        cosines = rows[left] @ rows[~left].T
        return float(cosines.max(axis=1).mean()), float(cosines.max(axis=0).mean())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def scored(table: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
            parts = [table.slice(int(a), int(b - a)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            keys = table["_key"].combine_chunks().take(pa.array(cuts[:-1]))
            values = np.array([best(part) for part in parts]).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([keys, pa.array(values[:, 0]), pa.array(values[:, 1])], names=["_key", "precision", "recall"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            keys = held["_key"].to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
            if len(starts) > 1:
                yield scored(held, starts)
                held = held.slice(int(starts[-1]))
        if held is not None and held.num_rows:
            yield scored(held, np.array([0, held.num_rows]))

    placed = tokens.repartition("_key").sortWithinPartitions("_key", "_side", "_at").select("_key", "_side", "_vector")
    return placed.mapInArrow(run, f"_key {kind}, precision double, recall double")


def _long_pairs(tokens: DataFrame, block: int) -> DataFrame:
    """``_key, precision, recall``, block against block."""
    cut = tokens.withColumn("_block", F.floor(F.col("_at") / F.lit(block)).cast("int"))
    extents = cut.groupBy("_key").pivot("_side", ["candidate", "reference"]).agg(F.max("_block") + 1)
    key_type = tokens.schema["_key"].dataType.simpleString()

    def blocks(own: str, other: str, own_name: str, other_name: str) -> DataFrame:
        matching = extents.select("_key", F.col(other).alias("_n"))
        rows = cut.where(F.col("_side") == own).join(matching, "_key")
        return rows.select(
            F.col("_key").alias("_pair"),
            F.col("_block").alias(own_name),
            F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1)).alias(other_name),
            F.col("_at").alias("_place"),
            F.col("_vector").alias("_v"),
        )

    candidates = blocks("candidate", "reference", "_cb", "_rb")
    references = blocks("reference", "candidate", "_rb", "_cb")

    def match(c: pa.Table, r: pa.Table) -> pa.Table:
        n_c, n_r = len(c), len(r)
        if n_c and n_r:
            cosines = unit_rows(c["_v"]) @ unit_rows(r["_v"]).T
            best = np.concatenate([cosines.max(axis=1), cosines.max(axis=0)])
        else:
            best = np.zeros(n_c + n_r)
        return pa.table(
            {
                "_key": pa.concat_arrays([*c["_pair"].chunks, *r["_pair"].chunks]),
                "_side": pa.array(["candidate"] * n_c + ["reference"] * n_r, pa.string()),
                "_at": pa.concat_arrays([*c["_place"].chunks, *r["_place"].chunks]),
                "_best": pa.array(best, pa.float64()),
            }
        )

    tile = ["_pair", "_cb", "_rb"]
    maxima = candidates.groupBy(*tile).cogroup(references.groupBy(*tile)).applyInArrow(
        match, f"_key {key_type}, _side string, _at bigint, _best double"
    )
    per_token = maxima.groupBy("_key", "_side", "_at").agg(F.max("_best").alias("_best"))

    def mean(name: str) -> Column:
        return F.coalesce(F.avg(F.when(F.col("_side") == name, F.col("_best"))), F.lit(0.0))

    return per_token.groupBy("_key").agg(mean("candidate").alias("precision"), mean("reference").alias("recall"))
