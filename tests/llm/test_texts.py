"""Language identification, repetition, secrets and shingle joins against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import time

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from qaloom.llm import common, jaccard, language, repetition, secrets
from qaloom.llm.common import n_words, shingle_sets, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- language --------------------------------------------------------------------------------------------------------


def model(texts):
    frames = []
    for name, own in texts.items():
        keys, n = np.unique(np.concatenate([language._grams(language.START + t.encode()) for t in own]), return_counts=True)
        frames.append(pd.DataFrame({"lang": name, "gram": keys.astype(np.int64), "n": n}))
    return language.PpmModel(pd.concat(frames))


def bits_by_hand(train, context, symbol):
    """PPM with escape method C and exclusions, from the training bytes themselves."""
    seen = [language.START + t.encode() for t in train]
    excluded, bits = set(), 0.0
    for order in range(language.ORDER, -1, -1):
        tail = context[language.ORDER - order :]
        follows = {}
        for text in seen:
            for i in range(language.ORDER, len(text)):
                if text[i - order : i] == tail:
                    follows[text[i]] = follows.get(text[i], 0) + 1
        if not follows:
            continue
        left = {s: n for s, n in follows.items() if s not in excluded}
        total = sum(left.values()) + len(left)
        if symbol in left:
            return bits + np.log2(total / left[symbol])
        if left:
            bits += np.log2(total / len(left))
        excluded |= set(follows)
    return bits + np.log2(256 - len(excluded))


def test_code_lengths_are_those_of_ppm():
    train = ["the cat sat on the mat", "a cat and a hat"]
    tree = model({"en": train}).trees[0]
    for context, symbol in [(b"the", ord(" ")), (b"cat", ord("z")), (b" ca", ord("t")), (b"zzz", ord("a")), (b"\n\n\n", 200), (b"at ", ord("s"))]:
        gram = np.array([int.from_bytes(context + bytes([symbol]), "big")], np.uint32)
        assert tree.bits(gram)[0] == pytest.approx(bits_by_hand(train, context, symbol))


def test_probabilities_of_the_next_byte_add_up_to_one():
    tree = model({"en": ["banana bandana", "ananas"]}).trees[0]
    for context in (b"ban", b"xan", b"xyz", b"\n\n\n"):
        grams = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], np.uint32)
        assert np.exp2(-tree.bits(grams)).sum() == pytest.approx(1.0)


def test_lengths_do_not_depend_on_slices(monkeypatch):
    known = model({"a": ["abcabcabd " * 5], "b": ["xyzzy xyz " * 5]})
    texts = [b"abcabc", b"x" * 1000, b"xyz abc \xff\xfe", b"q"]
    whole = known.lengths(texts)
    monkeypatch.setattr(language, "SLICE", 7)
    assert (known.lengths(texts) == whole).all()


def test_languages_are_told_apart_on_held_out_texts(spark):
    rng = random.Random(1)
    parts = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ein", "ver", "ung"], "cc": ["eau", "ou", "tion", "é"]}
    rows = []
    for name, syllables in parts.items():
        for _ in range(60):
            rows.append((len(rows), " ".join("".join(rng.choices(syllables, k=3)) for _ in range(12)), name))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    trained = language.train(docs, F.col("doc_id") % 3 != 0)
    found = language.identify(docs.where("doc_id % 3 = 0"), trained)
    assert found.where("lang_pred <> lang OR score < 0.99 OR score > 1").count() == 0


def test_every_language_is_drawn_whatever_its_copies_and_lengths(spark):
    many = spark.range(20_000).selectExpr("'copies' AS lang", "repeat('the same again ', 4) AS text")
    own = [("copies", f"a text of its own with number {i}") for i in range(40)]
    own += [("few", f"{c} " * 400) for c in "abcdefgh"] + [("long", f"{c} " * 900) for c in "uvwxyz"]
    own += [("small", "short"), ("small", "short"), ("small", "q " * 900)]
    docs = many.union(spark.createDataFrame(own, "lang string, text string")).repartition(4)
    sample = [tuple(r) for r in language.training_sample(docs, F.lit(True), sample_bytes=1000).select("lang", "text").collect()]
    assert len(sample) == len(set(sample)) and set(sample) <= {*own, ("copies", "the same again " * 4)}
    texts = {name: [t for other, t in sample if other == name] for name in ("copies", "few", "long", "small")}
    assert 1000 <= sum(map(len, texts["copies"])) <= 1300 and len(texts["copies"]) > 20
    assert texts["small"] == ["short"] and 2 <= len(texts["few"]) <= 4 and 1 <= len(texts["long"]) <= 2
    everything = language.training_sample(docs, F.lit(True), sample_bytes=1_000_000)
    assert {tuple(r) for r in everything.select("lang", "text").collect()} == {*own, ("copies", "the same again " * 4)}


def test_grams_of_a_text_do_not_depend_on_slices(spark, monkeypatch):
    docs = spark.createDataFrame([("a", "banana bandana"), ("a", "x")], "lang string, text string").coalesce(1)
    whole = {tuple(r) for r in language.count_grams(docs, "text", "lang").collect()}
    assert sum(n for _, _, n in whole) == 15
    monkeypatch.setattr(language, "SLICE", 4)
    assert {tuple(r) for r in language.count_grams(docs, "text", "lang").collect()} == whole


def test_language_of_awkward_rows(spark, awkward, nothing):
    trained = language.train(awkward, F.lit(True))
    found = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in language.identify(awkward, trained).collect()}
    assert found[0, None] == found[1, ""] == found[2, "  \n\t "] == ("und", 0.0)
    assert found[3, "word"][0] == "en" and language.identify(awkward, trained).count() == awkward.count()
    untaught = language.train(nothing, F.lit(True))
    assert {r.lang_pred for r in language.identify(awkward, untaught).collect()} == {"und"}
    assert language.identify(nothing, trained).count() == 0


# --- words and shingles ----------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abAB \n\x1c é", max_size=40), max_size=6), st.integers(1, 4))
def test_shingle_sets_are_exact(texts, size):
    sets = shingle_sets([t.encode() for t in texts], size)
    ids = {}
    for text, got in zip(texts, sets, strict=True):
        words = [w.decode() for w in text.encode().lower().split()]
        want = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set())
        assert len(want) == len(got)
        for other, seen in ids.items():
            assert len(want & set(other)) == len(np.intersect1d(got, seen))
        ids[tuple(want)] = got


def test_words_that_polynomials_confuse_are_told_apart():
    one, two = b"a", b"b"
    for _ in range(12):
        one, two = one + two, two + one
    (hashes,) = word_hashes([one + b" " + two])[:1]
    assert len(one) == 4096 and hashes[0] != hashes[1]
    words = [bytes([i, j]) for i in range(97, 123) for j in range(97, 123)] + [b"a" * n for n in range(1, 40)] + [b"a" * n + b"\x00" for n in range(1, 40)]
    assert len(np.unique(word_hashes([b" ".join(words)])[0])) == len(set(words))


def test_number_of_words(spark):
    texts = [None, "", " ", "a", " a  b\n\nc\t", "x y z\x1cq", "\x0b\x0ca"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").select("text", n_words("text").alias("n"))
    for row in frame.collect():
        assert row.n == len(WORD.findall(row.text or ""))


# --- near duplicates -------------------------------------------------------------------------------------------------


def components_by_hand(docs, size, percent):
    sets = {}
    for i, text in docs:
        words = [w.lower() if w.isascii() else w for w in WORD.findall(text or "")]
        grams = {tuple(words[j : j + size]) for j in range(len(words) - size + 1)}
        sets[i] = grams or ({tuple(words)} if words else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            shared = len(sets[a] & sets[b])
            if a < b and shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                one, two = root(a), root(b)
                parent[max(one, two)] = min(one, two)
    return {i: (len(sets[i]), root(i)) for i in sets}


def copies(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    docs = []
    for _ in range(14):
        base = [rng.choice(words) for _ in range(rng.choice([2, 5, 20, 40, 80]))]
        for _ in range(rng.choice([1, 2, 5, 20])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                text[rng.randrange(len(text))] = rng.choice(words)
            docs.append((len(docs), "  ".join(text)))
    return [*docs, (len(docs), None), (len(docs) + 1, ""), (len(docs) + 2, " \n")]


@pytest.mark.parametrize(("size", "percent", "most"), [(3, 90, 32), (5, 80, 3)])
def test_components_match_brute_force(spark, monkeypatch, size, percent, most):
    monkeypatch.setattr(jaccard, "LIST", most)
    docs = copies(size)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    found = jaccard.near_duplicates(frame, shingle=size, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == components_by_hand(docs, size, percent)


def test_near_duplicates_of_awkward_rows(awkward, nothing):
    found = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(awkward, shingle=3, percent=90).collect()]
    assert len(found) == awkward.count()
    assert found.count((4, 1, 4)) == 2 and (0, 0, 0) in found and (None, 1, None) in found
    assert jaccard.near_duplicates(nothing).count() == 0


# --- repetition ------------------------------------------------------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=25), max_size=4))
def test_longest_repeats_match_brute_force(texts):
    words, begins = word_hashes([" ".join(t).encode() for t in texts])
    got = repetition.longest_repeats(words, begins)
    for text, begin, end in zip(texts, begins[:-1], begins[1:], strict=True):
        want = []
        for i in range(len(text)):
            best = 0
            for j in range(len(text)):
                k = 0
                while i != j and max(i, j) + k < len(text) and text[i + k] == text[j + k]:
                    k += 1
                best = max(best, k)
            want.append(best)
        assert got[begin:end].tolist() == want


def quality_by_hand(text):
    words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)} if len(words) < 2000 else None
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), covered


def test_quality_counts(spark, awkward, nothing):
    rng = random.Random(2)
    texts = ["\n".join(" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 9))) for _ in range(12)) + " #|é*" for _ in range(20)]
    texts += [" ".join(f"w{i}" for i in range(60)), " ".join([f"w{i}" for i in range(60)] * 2)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").union(awkward.select("doc_id", "text").where("doc_id < 4"))
    for row in repetition.quality(frame).join(frame, "doc_id").dropDuplicates(["doc_id"]).collect():
        if row.doc_id >= 4:
            n, chars, symbols, dup, covered = quality_by_hand(row.text)
            assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (n, chars, symbols, dup, len(covered))
            assert row.base_failed == (n < 20 or 100 * len(covered) > 30 * n)
    kept = {r.doc_id: r.kept for r in repetition.quality(frame).where("doc_id >= 20").collect()}
    assert kept == {20: True, 21: False}
    assert repetition.quality(awkward).count() == awkward.count() and repetition.quality(nothing).count() == 0


# --- secrets ---------------------------------------------------------------------------------------------------------

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)


def spans_by_hand(text):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def test_secret_spans_match_brute_force(spark, awkward, nothing):
    rng = random.Random(3)
    bits = [" token=", "secret: ", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "pass", "password = '", "hunter2hunter2", "é", "\n", " word ", "API_KEY=x", "漢"]
    texts = ["".join(rng.choices(bits, k=14)) for _ in range(150)] + ["token=secret:abcdefgh", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for row in secrets.scan(frame, None).select("text", secrets.digest("base").alias("base"), secrets.digest("spans").alias("spans")).collect():
        want = ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in spans_by_hand(row.text or ""))
        assert row.base == row.spans == want
    ratios = secrets.train(awkward)
    assert secrets.scan(awkward, ratios).count() == awkward.count() and secrets.scan(nothing, ratios).count() == 0


def test_random_strings_are_found_and_identifiers_are_not(spark):
    rng = random.Random(4)
    parts = ["get", "set", "name", "value", "index", "count", "list", "user", "file", "path"]
    rows = []
    for i in range(300):
        names = " ".join("_".join(rng.choices(parts, k=3)) + f" {rng.choice(parts)}_{rng.choice(parts)}" for _ in range(6))
        rows.append((i, f"{names} key {hashlib.sha1(str(i).encode()).hexdigest()} end"))
    ratios = secrets.train(spark.createDataFrame(rows, "doc_id bigint, text string"))
    fresh = "f3a9c41e7b2d85f06a1c9e3b"
    tests = [(0, f"see {fresh} there"), (1, "see get_user_name_list_2_path_value there"), (2, f"{fresh} {fresh}")]
    frame = spark.createDataFrame(tests, "doc_id bigint, text string")
    tests += [(3, "see qwJxZkPvTbRmNcLdWsYhGf there, 12345678901234567890"), (4, f"token=abcdefgh/{fresh}+x"), (5, f"key {'0123456789abcdef' * 2}kQeZtXrWnVlPuJsGf")]
    frame = spark.createDataFrame(tests, "doc_id bigint, text string")
    found = {r.doc_id: r.s for r in secrets.scan(frame, ratios).select("doc_id", secrets.digest("spans").alias("s")).collect()}
    # Letters alone are judged like others, digits alone are no key, and what a fixed pattern leaves of a string is judged by itself.
    assert found == {
        0: "random:4:28", 1: "", 2: "random:0:24,random:25:49", 3: "random:4:26", 4: "assign:0:41", 5: "hex:4:36,random:36:53"
    }
    clean = {r.doc_id: r.text for r in secrets.redact(frame, ratios).collect()}
    assert clean == {
        0: "see [SECRET] there", 1: tests[1][1], 2: "[SECRET] [SECRET]", 3: "see [SECRET] there, 12345678901234567890", 4: "[SECRET]", 5: "key [SECRET][SECRET]"
    }


def test_rare_random_strings_are_learned_in_a_large_table(spark):
    keys = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(3)]
    # The last one is in one text with 50,000 digits.
    rare = [f"key {k} end" for k in keys] + ["f3a9c41e7b2d85f0" * 3_000]
    plain = spark.range(400_000).selectExpr("concat('ordinary words number ', id % 10) AS text")
    ratios = secrets.train(plain.union(spark.createDataFrame([(t,) for t in rare], "text string")).union(spark.createDataFrame([(None,)], "text string")))
    counts = {True: {}, False: {}}
    for value, label, n in [*[(k, True, 1) for k in [*keys, rare[-1]]], *[(w, False, 400_000) for w in ("ordinary", "number")]]:
        for a, b in zip(value, value[1:], strict=False):
            counts[label][a + b] = counts[label].get(a + b, 0) + n
    want = []
    for a in secrets.SYMBOLS:
        sums = {k: sum(c.get(a + b, 0) for b in secrets.SYMBOLS) + len(secrets.SYMBOLS) for k, c in counts.items()}
        want += [np.log((counts[True].get(a + b, 0) + 1) / sums[True] * sums[False] / (counts[False].get(a + b, 0) + 1)) for b in secrets.SYMBOLS]
    assert ratios == pytest.approx(want)


def test_overlapping_spans_are_redacted_once(spark):
    value = "0123456789abcdef" * 3
    frame = spark.createDataFrame([(0, f"a token = {value} b"), (1, None)], "doc_id bigint, text string")
    assert [r.text for r in secrets.redact(frame, None).orderBy("doc_id").collect()] == ["a [SECRET] b", None]


@pytest.mark.parametrize("chunk", [5, 64, 4096])
def test_redaction_matches_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(secrets, "CHUNK", chunk)
    rng = random.Random(chunk)
    bits = [" token=", "AKIAABCDEFGH12345", "0123456789abcdef" * 3, "hunter2hunter2", "é", "\n", " word ", "漢", "a" * 50, "api_key=", "🎈"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(0, 25))) for _ in range(80)] + ["", None, "0123456789abcdef" * 9 + "api_key=abcdefgh/"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = [r.text for r in secrets.redact(frame, None).orderBy("doc_id").collect()]
    want = []
    for text in texts:
        out, at = "", 0
        for start, _, end, _ in spans_by_hand(text or ""):
            out += text[at:start] + "[SECRET]" if start >= at else ""
            at = max(at, end)
        want.append(text if text is None else out + text[at:])
    assert got == want


def test_a_text_of_very_many_spans(spark):
    run = "0123456789abcdef" * 2
    text = " ".join([run] * 60_000)
    frame = spark.createDataFrame([(0, text)], "doc_id bigint, text string")
    start = time.perf_counter()
    row = secrets.scan(frame, None).select(F.size("base").alias("n"), F.col("base")[59_999]["start"].alias("last")).first()
    assert (row.n, row["last"]) == (60_000, 33 * 59_999)
    clean = secrets.redact(frame, None).first().text
    assert clean == " ".join(["[SECRET]"] * 60_000)
    assert time.perf_counter() - start < 60


def test_redaction_keeps_columns_of_any_name(spark):
    names = ["base", "spans", "_text", "_more", "value", "left", "more", "clean", "_in_text", "start"]
    frame = spark.createDataFrame([(1, "password = hunter2hunter2")], "doc_id bigint, text string").selectExpr("*", *[f"'{n}!' AS {n}" for n in names])
    row = secrets.redact(frame, secrets.train(frame)).first()
    assert row.asDict() == {"doc_id": 1, "text": "[SECRET]", **{n: f"{n}!" for n in names}}


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 300, 1000])
def test_running_sums(spark, n):
    frame = spark.createDataFrame([([i * 7 % 11 for i in range(n)],)], "x array<bigint>")
    row = frame.select(common.running_sums(F.col("x")).alias("s"), common.running(F.col("x"), F.greatest).alias("m")).first()
    x = [i * 7 % 11 for i in range(n)]
    assert row.s == [sum(x[: i + 1]) for i in range(n)] and row.m == [max(x[: i + 1]) for i in range(n)]
