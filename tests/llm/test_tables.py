"""Neighbours, mixing, packing, urls, chats, archives and the pipeline against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from qaloom.llm import chat, common, mixing, neighbours, packing, urls, warc
from qaloom.llm import queries as llm_queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DATA = Path("/root/testdata/sf0.001")


# --- nearest neighbours ----------------------------------------------------------------------------------------------


def nearest_by_hand(rows, k, asks):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 6 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, np.float64)
    out = []
    for q in sorted(i for i in good if asks(i)):
        scores = sorted(((-round(float(good[q] @ good[i]), 9), i) for i in good if i != q))[:k]
        out += [(q, r, i, pytest.approx(-s, abs=1e-8)) for r, (s, i) in enumerate(scores, 1)]
    return out


def vectors(n=400, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(n)]
    # A very common vector, and rows that take no part.
    rows += [(n + i, rows[7][1]) for i in range(60)]
    rows += [(1000, None), (1001, [0.0] * 6), (1002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1003, [float("nan")] * 6), (1004, [1.0]), (None, rows[1][1])]
    return rows


def test_a_search_of_all_leaves_is_exact(spark):
    rows = vectors()
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit(1))
    found = neighbours.nearest(frame, F.col("vec_id") % 20 == 0, k=7, sample=64)
    got = [tuple(r) for r in found.orderBy("query_id", "rank").collect()]
    assert got == nearest_by_hand(rows, 7, lambda i: i % 20 == 0)


def test_tiles_in_parts_give_the_same(spark, monkeypatch):
    rows = vectors(200)
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    for name, value in (("TILE_ENTRIES", 40), ("TILE_QUERIES", 3), ("TILE_LEAVES", 2), ("LEAF", 10)):
        monkeypatch.setattr(neighbours, name, value)
    found = neighbours.nearest(frame, F.col("vec_id") % 20 == 0, k=25, trees=3, share=3)
    short = [(i, None if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert [tuple(r) for r in found.orderBy("query_id", "rank").collect()] == nearest_by_hand(short, 25, lambda i: i % 20 == 0)


def test_recall_of_a_partial_search(spark):
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(20, 16)) * 3
    points = [(i, (middles[i % 20] + rng.normal(size=16)).tolist()) for i in range(4000)]
    frame = spark.createDataFrame(points, "vec_id bigint, embedding array<double>")
    found = neighbours.nearest(frame, F.col("vec_id") % 40 == 0, k=10, share=0.8)
    matrix = np.array([v for _, v in points])
    hits = defaultdict(set)
    for row in found.collect():
        hits[row.query_id].add(row.vec_id)
    recall = []
    for q in range(0, 4000, 40):
        scores = matrix @ matrix[q]
        scores[q] = -np.inf
        recall.append(len(hits[q] & set(np.argsort(-scores)[:10].tolist())) / 10)
    assert len(hits) == 100 and np.mean(recall) >= 0.9


def test_recall_of_the_registered_query(spark):
    # Queries leave some leaves out, so the search is not exact here.
    folder = "/root/testdata/sf0.1"
    found = defaultdict(list)
    for row in llm_queries.QUERIES["op2_rp_forest"](spark, folder).orderBy("query_id", "rank").collect():
        found[row.query_id].append((row.vec_id, row.score))
    table = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").where(neighbours.usable("embedding")).collect()]
    ids, matrix = np.array([i for i, _ in table]), np.array([v for _, v in table], np.float64)
    recall = []
    for q in sorted(i for i in ids.tolist() if i % 20 == 0):
        scores = matrix @ matrix[ids == q][0]
        others = np.lexsort((ids, -scores.round(9)))
        best = [i for i in ids[others].tolist() if i != q][:20]
        recall.append(len(set(best) & {i for i, _ in found[q]}) / 20)
        for i, score in found[q]:
            assert score == pytest.approx(float(scores[ids == i][0]), abs=1e-9)
    assert len(found) == len(recall) and all(len(hits) == 20 for hits in found.values())
    assert 0.9 <= np.mean(recall) < 1


def test_leaves_come_in_the_order_of_their_margins():
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(300, 4))
    forest = neighbours.Forest(rows, 300, 3, 0)
    forest.trees = [neighbours.Tree(rows, 20, rng) for _ in range(3)]
    forest.counts = [np.bincount(t.place(rows), minlength=t.leaves) for t in forest.trees]
    query = rng.normal(size=4)
    margins = [t.normals_ @ query - np.array(t.cuts) for t in forest.trees]
    every = forest.search(query, margins, float("inf"))
    assert sorted(every) == [(t, leaf) for t, tree in enumerate(forest.trees) for leaf in range(tree.leaves)]
    own = {(t, int(tree.place(query[None])[0])) for t, tree in enumerate(forest.trees)}
    assert set(every[:3]) == own
    few = forest.search(query, margins, 100)
    assert few == every[: len(few)] and sum(forest.counts[t][leaf] for t, leaf in few) >= 100


def test_neighbours_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert neighbours.nearest(empty, F.col("vec_id") % 20 == 0).count() == 0


# --- mixing ----------------------------------------------------------------------------------------------------------


def targets_by_hand(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in sizes if x not in full) for s in sizes if s not in full}
        over = {s for s in share if share[s] > 3 * sizes[s]}
        if not over:
            return share | {s: 3.0 * sizes[s] for s in full}
        full |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 0}, {"x": 1000, "y": 1, "z": 7, None: 30}, {"q": 5}, {"a": 0, "b": 0}])
def test_targets_match_the_rule(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.targets(frame).collect()}
    assert got == {s: pytest.approx(t) for s, t in targets_by_hand(sizes).items()}


def seats_by_hand(votes, seats):
    won = Counter()
    for _ in range(seats):
        won[min((k for k in votes if votes[k] > 0), key=lambda k: (-votes[k] / (2 * won[k] + 1), k))] += 1
    return {k: won[k] for k in votes}


def test_seats_are_those_of_highest_quotients(spark):
    rng = random.Random(1)
    for seats in (0, 1, 17, 400):
        groups = {g: {f"p{i}": rng.choice([0, 1, 5, 70, 900]) for i in range(9)} for g in "abc"}
        rows = [(g, k, v, seats) for g, votes in groups.items() for k, v in votes.items()]
        frame = spark.createDataFrame(rows, "g string, k string, v bigint, seats int")
        got = defaultdict(dict)
        for r in mixing.apportion(frame, ["g"], "k", "v", "seats", "won").collect():
            got[r.g][r.k] = r.won
        assert got == {g: seats_by_hand(votes, seats) for g, votes in groups.items()}


def test_a_mix_keeps_its_bounds_and_its_documents(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_DOCS", 40)
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 8)
    rng = random.Random(2)
    docs = [(i, " ".join(f"w{i}.{j}" for j in range(rng.randint(0, 30))), "en", rng.choice(["a", "a", "a", "b", None]), 0) for i in range(300)]
    docs += [docs[5]] * 3
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    rows = mixing.mix(frame).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(frame.repartition(7)).collect()), key=str)
    sizes, taken, targets = Counter(), Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size and r.size == len(docs[r.doc_id][1].split())
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        targets[r.source] = r.target
    for source, target in targets_by_hand(sizes).items():
        assert targets[source] == pytest.approx(target) and abs(taken[source] - target) <= 8 * 10
    counted = Counter()
    for r in mixing.mixed_documents(frame).collect():
        assert docs[r.doc_id][1].startswith(r.text)
        counted[r.doc_id] += len(r.text.split())
    want = Counter()
    for r in rows:
        want[r.doc_id] += r.taken
    assert counted == +want


def test_a_mix_of_awkward_rows(awkward, nothing):
    assert mixing.mix(awkward).count() == awkward.count()
    assert mixing.mixed_documents(awkward.select("doc_id", "text", "lang", "source", "n_chars")).count() > 0
    assert mixing.mix(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0


def test_copies_of_a_row_go_to_all_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_DOCS", 100)
    monkeypatch.setattr(mixing, "COPIES", 64)
    monkeypatch.setattr(common, "SLICE_ROWS", 50)
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 8)
    same = (7, "five words that come often", "en", "a")
    rows = [same] * 1_000 + [(100 + i, f"text {i} of other words", "de", "ab"[i % 2]) for i in range(2_000)]
    rows += [(None, "no id", "en", "5")] * 3 + [(5, "no id", "en", None)] * 2
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    mixed = mixing.mix(frame)
    taken = mixed.collect()
    assert len(taken) == len(rows) and len({(r.row_key, r.copy) for r in taken}) == len(rows)
    assert Counter((r.doc_id, r.source) for r in taken) == Counter((r[0], r[3]) for r in rows)
    assert sorted(map(str, taken)) == sorted(map(str, mixing.mix(frame.repartition(5)).collect()))
    # 2,000 rows of source a lie in 20 shards of about 100 rows each.
    hot = spark.createDataFrame([(r.row_key, r.copy) for r in taken if r.doc_id == 7], "k bigint, copy bigint")
    shard = F.pmod(F.when(F.col("copy") > 0, F.xxhash64("k", "copy")).otherwise(F.col("k")), F.lit(20))
    sizes = [r["count"] for r in hot.groupBy(shard).count().collect()]
    assert len(sizes) == 20 and max(sizes) < 100
    want, got = Counter(), Counter()
    for r in taken:
        want[r.doc_id] += r.taken
    for r in mixing.mixed_documents(frame).collect():
        got[r.doc_id] += len(r.text.split())
    assert got == +want


def test_rows_are_numbered_within_their_key(spark, monkeypatch):
    monkeypatch.setattr(common, "SLICE_ROWS", 16)
    frame = spark.range(1_000).selectExpr("id", "IF(id % 10 = 0, 1, 2) AS k").repartition(3)
    rows = common.numbered(frame, "k", "nth").collect()
    assert len(rows) == frame.count() and rows[0].__fields__ == ["id", "k", "nth"]
    for key in (1, 2):
        own = [r.nth for r in rows if r.k == key]
        assert sorted(own) == list(range(len(own)))


# --- packing ---------------------------------------------------------------------------------------------------------


def test_best_fit_by_hand():
    # 7 and 6 open bins of 8; 2 fits neither, and the one word that is left after it makes 4 the cheapest for 2 and 1.
    assert packing.best_fit([1, 7, 2, 6], [4, 8], 1) == [(8, [1, 0]), (8, [3, 2])]
    assert packing.best_fit([3], [4, 8, 16], 1) == [(4, [0])]
    assert packing.best_fit([], [4], 1) == []
    rng = random.Random(3)
    sizes = [rng.randint(1, 64) for _ in range(500)]
    bins = packing.best_fit(sizes, [16, 32, 64])
    assert sorted(i for _, own in bins for i in own) == list(range(500))
    for capacity, own in bins:
        used = sum(sizes[i] for i in own)
        assert used <= capacity and all(c < used for c in (16, 32) if c < capacity)


def test_a_bin_is_opened_as_long_as_remaining_sizes_fill_it():
    # 1020 and one 560 leave 468 of 2048 empty, while three 560 fill it better.
    assert packing.best_fit([1020, 560, 560, 560], packing.CAPACITIES) == [(1024, [0]), (2048, [1, 2, 3])]
    assert packing.best_fit([1020, 560, 460], packing.CAPACITIES) == [(2048, [0, 1, 2])]


def test_packing_holds_every_word_once(spark, awkward, nothing):
    rng = random.Random(4)
    docs = [(i, "\n".join(f"w{i}.{j}" for j in range(rng.choice([0, 1, 9, 40, 200])))) for i in range(120)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    bins = packing.pack(frame, capacities=(16, 32, 64), shard_bytes=4_000).collect()
    assert len({b.bin_id for b in bins}) == len(bins)
    seen = Counter()
    for b in bins:
        words = b.text.split()
        assert b.n_words == len(words) == sum(b.piece_words) <= b.capacity and b.capacity in (16, 32, 64)
        want = [f"w{d}.{f + j}" for d, f, n in zip(b.doc_ids, b.first_words, b.piece_words, strict=True) for j in range(n)]
        assert words == want
        seen.update(words)
    assert seen == Counter(w for _, t in docs for w in t.split())
    again = packing.pack(frame.repartition(5), capacities=(16, 32, 64), shard_bytes=4_000).collect()
    assert sorted(map(str, bins)) == sorted(map(str, again))
    hard = packing.pack(awkward).collect()
    words = sum(len(WORD.findall(r.text or "")) for r in awkward.select("text").collect())
    assert sum(b.n_words for b in hard) == words and any(None in b.doc_ids for b in hard)
    assert packing.pack(nothing).count() == 0


def test_copies_are_packed_in_all_shards(spark, monkeypatch):
    monkeypatch.setattr(common, "SLICE_ROWS", 50)
    rows = [(None, "same four words here")] * 3_000 + [(i, f"other text {i}") for i in range(3_000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    bins = packing.pack(frame, capacities=(16, 32), shard_bytes=6_000).collect()
    packed = Counter()
    for b in bins:
        assert len(b.text.split()) == b.n_words <= b.capacity
        packed.update(b.text.split(packing.SEPARATOR))
    assert packed == Counter(t for _, t in rows)
    copies = Counter()
    for b in bins:
        copies[b.bin_id >> 32] += b.doc_ids.count(None)
    shards = len(copies)
    assert shards >= 15 and max(copies.values()) < 2 * 3_000 / shards
    again = packing.pack(frame.repartition(7), capacities=(16, 32), shard_bytes=6_000).collect()
    assert sorted(map(str, bins)) == sorted(map(str, again))


# --- urls ------------------------------------------------------------------------------------------------------------


def rule_by_hand(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_rules_and_parts_match_brute_force(spark):
    some = [None, "", "no scheme", "http://A.Example.ORG/es/x?q", "https://example.org/en/12#f", "http://org", "http://org/", "://x.com/fr/", "http://xorg/",
            "http://a.com/de/1?u=http://b.org/", "http://É.com/fr/\n", "http://com/de", "ftp://u@h.com:80/fr/", "http://a.b/" + "x" * 50_000]
    rows = [(i, u, "clash", i) for i, u in enumerate(some * 2)] + [(None, "http://q.net/", "", 0)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, host string, label int")
    found = urls.filter_urls(frame).collect()
    assert len(found) == len(rows)
    for r in found:
        host, path, rule, verdict = rule_by_hand(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
    assert urls.filter_urls(frame.limit(0)).count() == 0


def test_trees_learn_from_the_rules(spark):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        bad = rng.random() < 0.5
        name = "".join(rng.choices("abcdefgh", k=5)) + ("-win-777-" + str(rng.randint(100, 999)) if bad else "")
        rows.append((i, f"http://{name}.com/{'de' if bad else 'fr'}/{rng.randint(1, 99)}"))
    rows += [(1000, "http://abcde.net/fr/4"), (1001, "http://hgfab-win-777-123.net/fr/4")]
    found = {r.page_id: (r.rule, r.verdict) for r in urls.filter_urls(spark.createDataFrame(rows, "page_id bigint, url string")).collect()}
    assert found[1000] == (None, "allow") and found[1001] == (None, "block")


# --- chats -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("hot_verdict", ["blocked", "allowed"])
def test_a_hot_url_neither_floods_nor_empties_the_sample(spark, hot_verdict):
    hot, few = ("http://a.com/de/hot", "http://b.org/") if hot_verdict == "blocked" else ("http://b.org/hot", "http://a.com/de/")
    pages = spark.range(200_000).select(F.when(F.col("id") % 1000 == 0, F.concat(F.lit(few), "id")).otherwise(F.lit(hot)).alias("url"))
    pages = pages.union(spark.createDataFrame([("http://z.net/x",), (None,)], "url string"))
    known = urls.judge_by_rules(urls.parts(pages))
    drawn = Counter(r.verdict for r in urls.drawn_urls(known, 100).collect())
    assert sorted(drawn.values()) == [1, 100]
    assert urls.train(known, 100) is not None


def test_one_blocked_url_among_very_many_is_learned(spark):
    pages = spark.range(300_000).select(F.when(F.col("id") == 77, "http://a.com/de/x").otherwise(F.concat(F.lit("http://b.org/"), "id")).alias("url"))
    known = urls.judge_by_rules(urls.parts(pages))
    drawn = urls.drawn_urls(known, 500)
    assert Counter(r.verdict for r in drawn.collect()) == {"allow": 500, "block": 1}
    again = urls.drawn_urls(known.repartition(7), 500)
    assert sorted(map(tuple, drawn.collect())) == sorted(map(tuple, again.collect()))


def test_a_conversation_of_very_many_turns(spark):
    rows = spark.range(100_000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('turn ', id) AS text")
    start = time.perf_counter()
    row = chat.read_back(chat.format_chats(rows)).select(F.size("turns").alias("n"), F.length("loss_text").alias("loss")).first()
    assert (row.n, row.loss) == (100_000, sum(len(f"turn {i}") for i in range(1, 100_000, 2)))
    assert time.perf_counter() - start < 60


def test_loss_spans_may_be_any_turns(spark):
    rows = spark.createDataFrame([(1, i, r, f"t{i}") for i, r in enumerate(["user", "assistant", "assistant", "user"])], "conv_id long, turn long, role string, text string")
    chats = chat.format_chats(rows)
    assert chat.read_back(chats).first().loss_text == "t1t2"
    assert chat.read_back(chats.withColumn("loss_spans", F.slice("loss_spans", 2, 1))).first().loss_text == "t2"


def test_chats_come_back_whatever_they_say(spark):
    rng = random.Random(6)
    bits = ["### ", "</turn>", "\n", "\\", "Assistant: ", "###", "#", ":", " ", "/", "<", "text", "é漢", "</turn>\n", "\\\\", "\\#", ";"]
    rows, source = [], {}
    for conv in range(120):
        turns = []
        for turn in range(rng.randint(1, 5)):
            role = rng.choice(["user", "assistant", "assistant", "system", "".join(rng.choices(bits, k=2)), None])
            turns.append((role, rng.choice([None, "", "plain words", "".join(rng.choices(bits, k=rng.randint(0, 6)))])))
            rows.append((conv, turn, *turns[-1], "clash"))
        source[conv] = [(r or "", t or "") for r, t in turns]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, turns string")
    for r in chat.read_back(chat.format_chats(frame.repartition(5))).collect():
        assert [(t.role, t.text) for t in r.turns] == source[r.conv_id]
        assert r.loss_text == "".join(t for role, t in source[r.conv_id] if role == "assistant")
        plain = "".join(f"### {role}: {text}</turn>\n" for role, text in source[r.conv_id])
        easy = all(t.isalpha() or t in ("", "plain words") for pair in source[r.conv_id] for t in pair)
        assert not easy or r.formatted == plain
        for span, (role, text) in zip(r.loss_spans, [x for x in source[r.conv_id] if x[0] == "assistant"], strict=True):
            body = r.formatted[span.start : span.end]
            assert body == text or re.sub(r"(?s)\\(.)", r"\1", body) == text
    empty = chat.read_back(chat.format_chats(frame.limit(0)))
    assert empty.count() == 0
    nulls = spark.createDataFrame([(None, None, None, None)] * 2, "conv_id bigint, turn bigint, role string, text string")
    assert [len(r.turns) for r in chat.read_back(chat.format_chats(nulls)).collect()] == [2]


# --- archives --------------------------------------------------------------------------------------------------------


def test_loser_tree_merges():
    rng = random.Random(7)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((rng.randint(0, 30),) for _ in range(rng.randint(0, 20))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_archives_come_back_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ROWS", 15)
    rng = random.Random(8)
    pool = ["", "\r\n\r\n", "a\r\n", "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n", "é" * 700, "x" * 1000, "y" * 999, "<p>\r\n\r\n" * 300, "z" * 300_000]
    rows = [(i, rng.choice([None, "http://A.b/c?d", "http://u@x.y", "https://q.com/\r\nX: 1", "plain"]), rng.choice([*pool, None, f"own {i}"]), 1) for i in range(80)]
    rows += [(None, "http://n.o/", "x" * 1000, 1)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string, payload_bytes int").repartition(6)
    path = str(tmp_path / "archives")
    warc.write_archives(frame, path)
    index = warc.capture_index(warc.capture_runs(spark, path))
    places = index.withColumn("part", F.spark_partition_id()).collect()
    assert len(places) == len(rows) and len({r.run for r in places}) > 1
    ordered = sorted(places, key=lambda r: (r.part, r.place))
    keys = [(r.url_key.encode(), r.captured, r.page_id is not None, r.page_id or 0) for r in ordered]
    assert keys == sorted(keys)
    kept = {}
    for i, _, html, _ in rows:
        data = (html or "").encode()
        if len(data) >= 1000 and i is not None:
            kept[data] = max(kept.get(data, -1), i)
    html = {i: (h or "").encode() for i, _, h, _ in rows}
    for r in places:
        data = html[r.page_id]
        want = kept.get(data) if len(data) >= 1000 and r.page_id is not None and kept[data] != r.page_id else None
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert (r.record_type, r.refers_to) == ("response" if want is None else "revisit", want)
    warc.write_archives(frame.limit(0), str(tmp_path / "none"))
    assert warc.capture_index(warc.capture_runs(spark, str(tmp_path / "none"))).count() == 0


def test_pages_that_share_an_id_are_records_of_their_own(spark, tmp_path):
    a, b = "A" * 1500, "B" * 1500
    rows = [(5, a), (5, b), (5, "short"), (9, a), (8, b), (9, a), (None, a), (None, None), (5, "short"), (7, "C" * 1500), (7, "C" * 1500)]
    frame = spark.createDataFrame([(i, "http://x.y/", h) for i, h in rows], "page_id bigint, url string, html string").repartition(3)
    warc.write_archives(frame, str(tmp_path / "archives"))
    index = warc.capture_index(warc.capture_runs(spark, str(tmp_path / "archives")))
    got = sorted(((r.page_id or -1, r.payload_digest, r.record_type, r.refers_to or 0) for r in index.collect()))
    kept = {a: 9, b: 8, "C" * 1500: 7}
    want = []
    for i, h in rows:
        again = i is not None and h in kept and kept[h] != i
        want.append((i or -1, hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if again else "response", kept[h] if again else 0))
    assert got == sorted(want)


@pytest.mark.parametrize("html", ["ab\r\n", "\r\n", "ab\r\n\r\n", "ab\r\n\r\n\r\n", "ab\r", ""])
def test_last_page_of_an_archive_may_end_in_line_ends(spark, tmp_path, html):
    pages = spark.createDataFrame([(1, "http://a.b/", "x"), (2, "http://a.b/", html)], "page_id bigint, url string, html string")
    warc.write_archives(pages.coalesce(1).sortWithinPartitions("page_id"), str(tmp_path / "archives"))
    index = warc.capture_index(warc.capture_runs(spark, str(tmp_path / "archives")))
    found = [(r.page_id, r.payload_bytes, r.payload_digest) for r in index.collect()]
    assert found == [(i, len(h), hashlib.sha1(h.encode()).hexdigest()) for i, h in ((1, "x"), (2, html))]


def test_url_keys():
    assert warc.url_key("https://User@WWW.Example.com/a/b?c#d") == "com,example,www)/a/b?c"
    assert warc.url_key("http://x.y") == "y,x)/" and warc.url_key("") == ")/"


# --- pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline_over_awkward_rows(spark, awkward, nothing):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = awkward.select(columns)
    clean = [(100 + i, f"a clean document number {i} says something of its own about {'abcdefgh'[i % 8]} things", "en", "s0", 70) for i in range(30)]
    docs = docs.union(spark.createDataFrame(clean, docs.schema))
    docs = docs.union(spark.createDataFrame([(200, "my password = hunter2hunter2 is here", "en", "s1", 36)], docs.schema))
    known = corpus_pipeline.identify_language(spark, docs, "")
    assert known.columns == columns and {r.doc_id for r in known.collect()} >= {3, 4, 200, *range(100, 130)}
    assert not {0, 1, 2} & {r.doc_id for r in known.collect()}
    single = corpus_pipeline.drop_near_duplicates(spark, known, "")
    assert Counter(r.doc_id for r in single.collect())[4] == 1 and single.columns == columns
    safe = corpus_pipeline.remove_secrets(spark, single, "")
    texts = {r.doc_id: (r.text, r.n_chars) for r in safe.collect()}
    assert texts[200] == ("my [SECRET] is here", 19) and safe.count() == single.count() and safe.columns == columns
    mixed = corpus_pipeline.mix_sources(spark, safe, "")
    assert mixed.columns == columns and all(r.n_chars == len(r.text) for r in mixed.collect())
    packed = corpus_pipeline.pack_sequences(spark, mixed, "").collect()
    assert sum(b.n_words for b in packed) == sum(len(WORD.findall(r.text)) for r in mixed.collect())
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, nothing, "").count() == 0


def test_stages_keep_columns_of_any_name(spark):
    names = ["base", "spans", "_text", "_more", "size", "row_key", "_key", "_before", "_in_text", "score", "words", "clean", "value", "n", "component_id"]
    texts = [f"a clean document number {i} says something of its own about {'abcdefgh'[i % 8]} things" for i in range(30)]
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate([*texts, "my password = hunter2hunter2 is here", texts[0]])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").selectExpr("*", *[f"concat('{n} ', doc_id) AS {n}" for n in names])
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *names]
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        for r in docs.collect():
            assert all(r[n] == f"{n} {r.doc_id}" for n in names)
    found = docs.collect()
    assert not any("hunter2" in str(r) for r in found) and {r.doc_id for r in found} <= set(range(31))
    assert sum(b.n_words for b in corpus_pipeline.pack_sequences(spark, docs, "").collect()) > 0


@pytest.mark.skipif(not DATA.exists(), reason="driver tables are not here")
def test_rows_that_share_an_id_or_have_none_are_compared_by_text(spark, nothing):
    same, other, third = ("one text that several rows of the table hold", "quite another text about some other things", "a third text which stands alone")
    rows = [(9, same, "en", "a", 1), (7, same, "en", "b", 1), (7, other, "en", "b", 1), (7, third, None, "c", 1)]
    rows += [(None, same, "en", "a", 1), (None, third, "c", None, 1), (None, "x y z", None, "en", 1), (None, "x y z", "en", None, 1)]
    rows += [(5, "u v w", "en", "a", 1)] * 3 + [(6, "", "en", "a", 1), (None, None, "en", "a", 1)]
    docs = spark.createDataFrame(rows, nothing.schema)
    found = sorted(map(str, map(tuple, corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())))
    unnamed = [r for r in rows if r[1] == "x y z"]
    kept = [r for r in unnamed if str(r) in found]
    assert len(kept) == 1
    assert found == sorted(map(str, [rows[1], rows[2], rows[3], *kept, *rows[-3:]]))
    assert corpus_pipeline.drop_near_duplicates(spark, nothing, "").columns == nothing.columns


def test_pipeline_runs_over_the_tables(spark):
    assert corpus_pipeline.run(spark, str(DATA)).count() > 0
