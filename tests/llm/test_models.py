"""Suffix-tree scores, ranked search and mined negatives against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from qaloom.llm import language, negatives, ranked, suffix_tree

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RATIO = 2.5


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


# --- suffix tree -----------------------------------------------------------------------------------------------------


def words_of(text):
    return [*WORD.findall(lower(text or "")), None]


class TreeByHand:
    """The same tree with dictionaries: ``None`` is the end."""

    def __init__(self, texts, depth, least, ratio, discount=0.5):
        self.d, self.depth = discount, depth
        grams = Counter()
        for words in map(words_of, texts):
            for k in range(1, depth + 2):
                for i in range(len(words) - k + 1):
                    grams[tuple(words[i : i + k])] += 1
        self.c = Counter({g[0]: n for g, n in grams.items() if len(g) == 1})
        self.n, self.v = sum(self.c.values()), len(self.c)
        frequent = {g: n for g, n in grams.items() if n >= least}
        self.held = {}
        for g, n in frequent.items():
            if len(g) > 1:
                self.held.setdefault(g[:-1], {})[g[-1]] = n
        self.grams = grams

        def share(context, word):
            return grams[(*context, word)] / (grams[context] if context else self.n)

        states = set()
        for context, after in self.held.items():
            for word in after:
                quotient = share(context, word) / share(context[1:], word)
                if quotient >= ratio or quotient <= 1 / ratio:
                    states.add(context)
        self.states = {s[i:] for s in states for i in range(len(s))}

    def root(self, word):
        return (self.c[word] + 0.5) / (self.n + 0.5 * (self.v + 1))

    def p(self, state, word):
        if not state:
            return self.root(word)
        held, n = self.held[state], self.grams[state]
        if word in held:
            return (held[word] - self.d) / n
        rest = 1 - sum((x - self.d) / n for x in held.values())
        return rest / (1 - sum(self.p(state[1:], w) for w in held)) * self.p(state[1:], word)

    def score(self, text):
        words, total = words_of(text), 0.0
        for i, word in enumerate(words):
            context = next(s for k in range(min(i, self.depth), -1, -1) if (s := tuple(words[i - k : i])) in self.states or not s)
            total += math.log10(self.p(context, word))
        return total

    def base(self, text):
        return sum(math.log10(self.root(w)) for w in words_of(text))


def prose(n, seed):
    rng = random.Random(seed)
    names = ["alpha", "be", "Ça", "delta-and-more-than-eight", "e", "f,", "gg", "ÜBER", "x1", "漢字"]
    # What ends a passage follows from its first word only.
    passages = [[f"p{v}", "q", "r", f"t{v}"] for v in range(4)]
    texts = []
    for _ in range(n):
        words = rng.choices(names, weights=range(1, 11), k=rng.randrange(0, 30))
        if rng.random() < 0.4:
            words[3:3] = rng.choice(passages)
        texts.append(rng.choice([" ", "\n", " \t "]).join(w.upper() if rng.random() < 0.1 else w for w in words))
    return [*texts, None, "", "  ", "Ça Ça", "Ça Ça", "word " * 3000, "never seen words"]


@pytest.mark.parametrize("depth,least", [(1, 3), (2, 4), (3, 5)])
def test_tree_scores_like_the_one_by_hand(spark, monkeypatch, depth, least):
    monkeypatch.setattr(suffix_tree, "HEAD", 7)
    monkeypatch.setattr(suffix_tree, "BUFFER", 500)
    texts = prose(150, 3)
    docs = spark.createDataFrame([(i if i % 7 else None, t, 1.0, "k") for i, t in enumerate(texts)], "doc_id long, text string, score double, key string")
    tree = suffix_tree.train(docs.where("doc_id IS NULL OR doc_id % 3 <> 1"), depth=depth, least=least, ratio=RATIO)
    hand = TreeByHand([t for i, t in enumerate(texts) if i % 7 == 0 or i % 3 != 1], depth, least, RATIO)
    assert any(len(s) == depth for s in hand.states) and len(hand.states) < len(hand.held)
    assert tree.train_tokens == hand.n
    got = sorted((r.n_tokens, r.n_known, round(r.base_score, 7), round(r.score, 7)) for r in suffix_tree.score(docs, tree).collect())
    want = sorted((len(w := words_of(t)), sum(hand.c[x] > 0 for x in w), round(hand.base(t), 7), round(hand.score(t), 7)) for t in texts)
    assert got == want


@pytest.mark.parametrize("common,codes,pack", [(1 << 10, 5, 300), (12, 1 << 15, 1 << 22), (1, 40, 1 << 12)])
def test_packed_windows_count_every_run(spark, monkeypatch, common, codes, pack):
    for name, value in {"COMMON": common, "CODES": codes, "PACK": pack, "BUCKETS": 4, "BUCKET": 1 << 9}.items():
        monkeypatch.setattr(suffix_tree, name, value)
    texts = [*prose(150, 8), *["the very same line of words"] * 200]
    docs = spark.createDataFrame([(t or "",) for t in texts], "text string").repartition(5)
    words = suffix_tree._word_counts(docs)
    total = words.agg(F.sum("n")).first()[0]
    rows = suffix_tree._frequent_runs(docs, words.where("n >= 4"), total, 4, 4).collect()
    grams = Counter(tuple(w[i : i + k]) for w in map(words_of, texts) for k in (2, 3, 4) for i in range(len(w) - k + 1))
    assert Counter((r.length, r.n) for r in rows) == Counter((len(g), n) for g, n in grams.items() if n >= 4)
    keys = {r.key for r in rows} | {r.key for r in words.collect()}
    assert len({r.key for r in rows}) == len(rows) and {r.ctx for r in rows} | {r.low for r in rows} <= keys


def test_runs_and_asks_are_few_rows(spark, monkeypatch):
    # Every pair and every ask was a row of its own, more of them the more runs were frequent.
    monkeypatch.setattr(suffix_tree, "HEAD", 7)
    made = []
    plain = type(spark.range(1)).mapInArrow
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda df, f, schema, *more: made.append(plain(df, f, schema, *more)) or made[-1])
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(40)}" for _ in range(300))) for i in range(200)], "doc_id long, text string").coalesce(2)
    found = suffix_tree.score(docs, suffix_tree.train(docs))
    assert found.count() == 200
    packed = [df for df in made if "data" in df.columns]
    assert len(packed) == 2 and all(df.count() <= 2 * 4 * suffix_tree.BUCKETS for df in packed)
    assert not [df for df in made if {"ctx", "low"} & set(df.columns)]


@pytest.mark.parametrize("limits", [{"ASKS": 1 << 21}, {"ASKS": 60, "TEXTS": 30, "PACK": 50, "FILTER_BITS": 6}])
def test_texts_ask_together_and_once_for_a_run(spark, monkeypatch, limits):
    # Every text asked for itself, so a run was sent as often as texts hold it.
    for name, value in {"HEAD": 7, **limits}.items():
        monkeypatch.setattr(suffix_tree, name, value)
    made = []
    plain = type(spark.range(1)).mapInArrow
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda df, f, schema, *more: made.append(plain(df, f, schema, *more)) or made[-1])
    texts = prose(150, 6)
    docs = spark.createDataFrame([(f"id {i}", t) for i, t in enumerate(texts)], "doc_id string, text string").coalesce(2)
    tree = suffix_tree.train(docs, least=5, ratio=RATIO)
    hand = TreeByHand(texts, 3, 5, RATIO)
    got = {r.doc_id: (r.n_tokens, r.n_known, round(r.base_score, 7), round(r.score, 7)) for r in suffix_tree.score(docs, tree).collect()}
    assert got == {f"id {i}": (len(w := words_of(t)), len(w), round(hand.base(t), 7), round(hand.score(t), 7)) for i, t in enumerate(texts)}
    asks = next(df for df in made if {"part", "rows"} <= set(df.columns))
    parts, asked = asks.agg(F.count_distinct("part"), F.sum("rows")).first()
    assert "FILTER_BITS" in limits or asked <= parts * tree.values.count()


def test_states_are_distributions(spark):
    hand = TreeByHand(prose(100, 5), 2, 4, 1.5)
    for state in hand.states:
        seen = sum(hand.p(state, w) for w in hand.c)
        unseen = 1 - sum(hand.root(w) for w in hand.c)
        rest = hand.p(state, "no such word") / hand.root("no such word")
        assert seen + unseen * rest == pytest.approx(1)


def test_suffix_tree_on_awkward_rows(spark, awkward, nothing):
    tree = suffix_tree.train(awkward)
    rows = suffix_tree.score(awkward, tree).collect()
    assert len(rows) == awkward.count()
    assert all(math.isfinite(r.score) and r.n_known == r.n_tokens for r in rows)
    empty = suffix_tree.train(nothing)
    assert (empty.train_tokens, empty.values.count()) == (0, 0)
    assert suffix_tree.score(nothing, tree).count() == 0
    blank = suffix_tree.score(awkward, empty).where(F.col("n_tokens") == 1).collect()
    assert len(blank) == 3 and all(r.n_known == 0 and r.score == r.base_score == 0 for r in blank)


def test_evidence_grows_with_the_root_of_the_corpus(spark):
    docs = spark.createDataFrame([(t,) for t in prose(150, 3)], "text string")
    strict, loose = (suffix_tree.train(docs, depth=1, least=2, ratio=RATIO, root_share=s) for s in (0.2, 0.02))
    assert strict.values.where("known = 0").count() < loose.values.where("known = 0").count()


def test_a_run_counts_in_a_corpus_of_any_size(spark):
    # A million training tokens; a share of the root of them would ask for more than 18 occurrences.
    docs = spark.createDataFrame([("of the " * 5_000,)] * 100 + [("rare words",)] * 18, "text string")
    tree = suffix_tree.train(docs)
    assert tree.train_tokens > 1_000_000
    assert tree.values.where("known = 0 AND n = 18").count() >= 2


# --- hard negatives --------------------------------------------------------------------------------------------------


def mined_by_hand(rows, asks, positives=5, each=10):
    width = Counter(len(v) for i, v, k in rows if usable(i, v, k)).most_common(1)[0][0]
    good = sorted({(i, k, tuple(math.floor(256 * x) for x in v)) for i, v, k in rows if usable(i, v, k) and len(v) == width})
    out = []
    for i, k, v in good:
        if not asks(i):
            continue
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, label) for j, label, w in good if j != i)
        for p, j, _ in [s for s in scores if s[2] == k][:positives]:
            fits = [s for s in scores if s[2] != k and -30 * p <= -100 * s[0] <= -90 * p][:each]
            out += [(i, j, r, x, -p, -n) for r, (n, x, _) in enumerate(fits, 1)]
    return sorted(out)


def usable(i, v, k):
    return i is not None and k is not None and bool(v) and all(x is not None and math.isfinite(x) for x in v)


def labelled(n, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.normal(size=4) + (i % 3)).round(2).tolist(), i % 3) for i in range(n)]
    # A common vector, equal scores, shared ids, equal rows, zero vectors, and rows that take no part.
    rows += [(n + i, rows[6][1], i % 2) for i in range(90)]
    rows += [(20, [3.0, 1.0, 0.0, 2.0], 1), rows[30], rows[40], (1000, [0.0] * 4, 1), (1100, [0.0] * 4, 1)]
    rows += [(1, None, 1), (2, [1.0, None, 0.0, 0.0], 1), (3, [float("inf")] * 4, 0), (None, rows[1][1], 1), (4, rows[1][1], None), (5, [], 1), (6, [1.0], 1)]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_negatives_are_those_by_hand(spark, monkeypatch, small):
    if small:
        for name, value in (("TILE_ANCHORS", 5), ("TILE_ROWS", 33), ("CELLS", 64)):
            monkeypatch.setattr(negatives, name, value)
    rows = labelled(240, 3)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS `group`", "'k' AS key")
    found = negatives.mine(frame, F.col("vec_id") % 10 == 0)
    assert sorted(tuple(r) for r in found.collect()) == mined_by_hand(rows, lambda i: i % 10 == 0)


def test_negatives_of_nothing_and_of_huge_vectors(spark):
    schema = "vec_id long, embedding array<double>, label int"
    assert negatives.mine(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    assert negatives.mine(spark.createDataFrame([(1, None, 1), (2, [1.0], None)], schema), F.lit(True)).count() == 0
    assert negatives.mine(spark.createDataFrame([(1, [1.0], 1), (2, [0.5], 2)], schema), F.lit(None).cast("boolean")).count() == 0
    big = [(1, [1e7, 1e6], 1), (2, [1e7, 1e6], 1), (3, [5e6, 1.0], 2), (4, [1e308, -1e308], 2)]
    found = negatives.mine(spark.createDataFrame(big, schema), F.col("vec_id") == 1)
    assert [tuple(r) for r in found.collect()] == [(1, 2, 1, 3, 65536 * (10**14 + 10**12), 65536 * (5 * 10**13 + 10**6))]


def test_keys_sort_as_their_parts():
    rng = random.Random(4)
    ends = [-(2**63), -5, 0, 7, 2**63 - 1]
    rows = [(rng.choice(ends), rng.choice(ends), rng.random() < 0.5, rng.choice(ends)) for _ in range(200)]
    columns = [np.array(x) for x in zip(*rows, strict=True)]
    packed = negatives.pack(*columns).to_pylist()
    order = sorted(range(200), key=lambda i: packed[i])
    assert [rows[i] for i in order] == sorted(rows, key=lambda r: (r[0], -r[1], r[2], r[3]))
    assert list(zip(*(x.tolist() for x in negatives.unpack(negatives.pack(*columns))), strict=True)) == rows


# --- ranked search ---------------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall(lower(text or ""))


def ranked_by_hand(items, docs, k):
    counts = [(i, Counter(terms_of(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n, total = len(counts), sum(x for *_, x in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms_of(t))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, c, size in counts:
            m = 100 - 90 + (90 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out)


def library(n, seed):
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(60)] + ["Ünï", "漢字", "A-B", "x_y"]
    docs = [(i, rng.choice([" ", "-", "\n"]).join(rng.choices(names, weights=[1 / (j + 1) for j in range(64)], k=rng.randrange(0, 40)))) for i in range(n)]
    docs += [(n + i, docs[5][1]) for i in range(80)]
    docs += [(3, "W1 w2 w50"), (3, "w1 w2 w50"), (None, "w1 w2 w50 w51"), (None, "w1 w2 w50 w51"), (900, None), (901, ""), (902, "-- !"), (903, "w1 " * 2000)]
    items = [(i, " ".join(rng.choices(names, k=rng.randrange(1, 12)))) for i in range(25)]
    return docs, [*items, (1, "w50, w51"), (2, None), (100, ""), (101, "nowhere"), (None, "w1"), (102, docs[5][1]), (102, docs[5][1])]


@pytest.mark.parametrize("small", [False, True])
def test_ranking_is_that_by_hand(spark, monkeypatch, small):
    if small:
        for name, value in (("SEED_VECTORS", 9), ("BUCKET", 7), ("BUCKET_ENTRIES", 40), ("QUERY_TERMS", 60)):
            monkeypatch.setattr(ranked, name, value)
    docs, items = library(250, 8)
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n", "'t' AS norm", "2.0 AS score")
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS term", "3 AS query")
    found = ranked.rank(asked, frame, k=6)
    order = sorted((tuple(r) for r in found.collect()), key=lambda r: (r[0], r[1]))
    assert order == ranked_by_hand(items, docs, 6)


def test_ranking_of_nothing(spark):
    docs, items = (spark.createDataFrame([], s) for s in ("doc_id long, text string", "item_id long, text string"))
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert ranked.rank(items, some).count() == 0
    assert ranked.rank(some, docs, query_id="doc_id").count() == 0
    assert [tuple(r) for r in ranked.rank(some, some, query_id="doc_id").collect()] == [(1, 1, 1, 2 * 287 * (10**9 // (1000 + 800)))]


def test_bounds_drop_most_vectors_and_no_result():
    rng = np.random.default_rng(6)
    sizes = rng.integers(1, 30, 4000)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    at = np.concatenate([rng.choice(300, s, replace=False) for s in sizes])
    weights = np.round(1e4 / (1 + np.arange(300)[::-1])).astype(np.int64) + 1
    impacts = weights[at] * rng.integers(1, 1000, len(at))
    norms = np.sqrt(np.add.reduceat(impacts.astype(float) ** 2, offsets[:-1]))
    order = np.argsort(-norms)
    queries = {q: np.sort(rng.choice(300, 8, replace=False)) for q in range(40)}
    search = ranked.Search(queries, {}, 10, 300)
    for begin in range(0, 4000, 250):
        some = order[begin : begin + 250]
        entries = np.concatenate([np.arange(offsets[i], offsets[i + 1]) for i in some])
        own = np.concatenate([[0], np.cumsum(sizes[some])])
        search.add(ranked.Bucket(some, norms[some], own, at[entries], impacts[entries]))
    for q, terms in queries.items():
        scores = np.add.reduceat(np.where(np.isin(at, terms), impacts, 0), offsets[:-1])
        want = [(s, i) for s, i in sorted(zip((-scores).tolist(), range(4000), strict=True)) if s < 0][:10]
        assert [(-s, i) for s, i in zip(*(x.tolist() for x in search.best[q]), strict=True)] == want
    # Of 640 meetings of a query and a bucket, and 160,000 of a query and a vector:
    assert search.met < 500 and search.scored < 30_000


def test_language_gets_each_text_once_and_hands_back_small_batches(spark, monkeypatch):
    monkeypatch.setattr(language, "HELD", 100)
    rows = [(i, text) for i, text in enumerate(["der hund und die katze " * 3, "the dog and the cat " * 3, None, "", "123", "x" * 500] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    known = spark.createDataFrame([("der hund und die katze", "de"), ("the dog and the cat", "en")], "text string, lang string")
    found = language.identify(docs, language.train(known, F.lit(True)))
    given = found._jdf.queryExecution().analyzed().children().head().schema()
    assert [f.dataType().typeName() for f in given.fields()] == ["long", "string", "boolean"]
    got = {r.doc_id: r.lang_pred for r in found.collect()}
    assert len(got) == 120 and [got[i] for i in range(5)] == ["de", "en", "und", "und", "und"] and got[5] != "und"
    assert all(got[i] == got[i % 6] for i in got)
