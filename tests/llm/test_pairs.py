"""Near duplicates, passages, vectors, components, language model: against brute force."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from fixtures import LOWER, documents, edited, prose, table, words

from facetline.llm import jaccard, lm, passages, vectors
from facetline.llm.common import connected_components, hash_words
from facetline.session import Scratch


class Find(dict):
    def __missing__(self, k):
        return k

    def root(self, x):
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        self[self.root(a)] = self.root(b)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(0, i) for i in range(100, 160)] + [(i, i + 1) for i in range(200, 230)] + [(5, 5), (None, 3)]
    f = Find()
    for a, b in edges:
        if a is not None:
            f.join(a, b)
    nodes = {x for e in edges if None not in e and e[0] != e[1] for x in e}
    least = defaultdict(lambda: 10**9)
    for n in nodes:
        least[f.root(n)] = min(least[f.root(n)], n)
    got = connected_components(Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r.node, r.component) for r in got) == sorted((n, least[f.root(n)]) for n in nodes)
    assert connected_components(Scratch(spark, "t"), spark.createDataFrame([], "a long, b long")).count() == 0


def jaccard_by_force(rows):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append(frozenset(zip(*[w[j:] for j in range(5)])) if len(w) >= 5 else (frozenset([tuple(w)]) if w else frozenset()))
    f = Find()
    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * o >= 75 * (len(sets[i]) + len(sets[j]) - o):
                f.join(i, j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[f.root(i)].append(d)
    return [(d, len(sets[i]), (d if not sets[i] else min((x for x in least[f.root(i)] if x is not None), default=None))) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("seed", [0, 1])
def test_jaccard_join(spark, seed):
    rng = random.Random(seed)
    rows = documents() if not seed else []
    for g in range(6):
        base = prose(50 + 10 * seed + g, rng.randint(4, 120))
        rows += [(1000 + 50 * g + k, edited(base, 7 * k + g, rng.randint(6, 60)) + " tail" * (k % 3)) for k in range(7)]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(table(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(jaccard_by_force(rows), key=str)


def test_jaccard_of_rows_without_ids_and_of_a_hot_token(spark):
    """Rows that share an id or have none stand for themselves; a third of the sets share a token of their prefixes."""
    hot = "one phrase of five words"
    rows = [(None, prose(800 + i % 40, 30)) for i in range(2000)] + [(7, prose(900 + i, 12)) for i in range(50)] + [(10 + i, f"{hot} w{i}") for i in range(1000)]
    got = jaccard.join(table(spark, rows)).collect()
    assert len(got) == len(rows)
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert all(r.component_id == r.doc_id for r in got if r.doc_id is not None)
    marked = jaccard.numbered(table(spark, rows[:2000]).withColumn("__rid", F.monotonically_increasing_id())).groupBy("component_row").count().collect()
    assert [r["count"] for r in marked] == [50] * 40


def test_jaccard_of_nothing(spark):
    assert jaccard.join(table(spark, [])).count() == 0
    assert [tuple(r) for r in jaccard.join(table(spark, [(1, None), (None, "")])).orderBy("doc_id").collect()] == [(None, 0, None), (1, 0, 1)]


def test_prefix_filter_loses_nothing():
    rng = np.random.default_rng(1)
    for _ in range(300):
        x = np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.85], rng.integers(0, 60, 3).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)]))
        both = len(np.intersect1d(x, y))
        if 100 * both >= 75 * (len(x) + len(y) - both):
            assert jaccard.meet(*[jaccard.further(v, jaccard.prefix_size(len(v), 75, 100)).tobytes() for v in (x, y)])
    apart = [np.arange(i, i + 40, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for i in (1, 100)]
    assert not jaccard.meet(*[jaccard.further(v, 11).tobytes() for v in apart])


def test_pairs_move_one_text_to_the_other(spark, monkeypatch):
    texts = [prose(9000, 80), prose(9000, 80) + " end", prose(9001, 80)]
    scratch, written = Scratch(spark, "moved"), []
    dealt = scratch.dealt(spark.createDataFrame(list(enumerate(texts)), "rid long, text string"), "rid")
    pairs = scratch.cut(spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "a long, b long"))
    cut = scratch.cut
    monkeypatch.setattr(scratch, "cut", lambda df: (written.append(df), cut(df))[1])
    got = jaccard.verified(scratch, pairs, dealt, 5, 75, 100)
    assert [tuple(r) for r in got.collect()] == [(0, 1)]
    plans = "".join(df._jdf.queryExecution().executedPlan().toString() for df in written)
    assert plans.count("Exchange hashpartitioning") == 2  # the pairs, and the pairs with one text


def test_near_copies_meet_the_text_that_they_come_from():
    """Whatever their order: then prefix tokens need not bring all pairs of them together."""
    rng = random.Random(9100)
    texts = [prose(9100, 150)]
    for i in range(200):
        w = texts[0].split(" ")
        for j in rng.sample(range(150), rng.randint(1, 3)):
            w[j] = f"changed{i}"
        texts.append(" ".join(w))
    sets = jaccard.shingles(pa.array(texts), 5)
    for seed in range(3):
        order = np.random.default_rng(seed).permutation(len(sets)).tolist()
        pairs = jaccard.around([(i, jaccard.sketch(sets[i])) for i in order])
        with_base = {i for p in pairs for i in p if 0 in p}
        assert len(with_base) > 150 and len(pairs) <= len(sets)


def test_candidates_are_of_different_components(spark):
    base = prose(9300, 60)
    rows = [(i, i % 2 * 100, edited(base, 9400 + i, 50)) for i in range(40)] + [(50, 50, prose(9301, 60))]
    rank, _ = jaccard.frequencies(spark.createDataFrame([(t,) for *_, t in rows], "text string"), 5)
    sets = jaccard.shingles(pa.array([t for *_, t in rows]), 5)
    for bits in (0, 3):
        dealt = jaccard.signatures(spark.createDataFrame(rows, "node long, component long, text string"), 5, 75, 100, rank, bits)
        got = {(r.a, r.b) for r in jaccard.candidates(dealt, 75, 100).collect() if (r.ca, r.cb) == (r.a % 2 * 100, r.b % 2 * 100)}
        assert got and all(a < b < 50 and (a + b) % 2 for a, b in got)
        for i in range(40):
            for j in range(i + 1, 40, 2):
                both = len(np.intersect1d(sets[i], sets[j]))
                assert 100 * both < 75 * (len(sets[i]) + len(sets[j]) - both) or (i, j) in got


def test_passages(spark):
    rows = documents()
    got = passages.find(table(spark, rows)).collect()
    pairs = {(r.other_id, r.doc_id) for r in got}
    assert {(3, 10), (40, 41), (20, 21), (3, 12), (3, 4)} <= pairs
    assert not {22, 33, 34, 35, 42, 50} & {i for p in pairs for i in p}  # clean texts, short ones, repeated rows of an id
    r = next(r for r in got if (r.other_id, r.doc_id) == (40, 41))
    assert abs(r.other_start - 80) <= 1 and abs(r.start - 50) <= 1 and 66 <= r.n_words <= 72
    w = {i: words(t) for i, t in rows}
    for r in got:
        assert min(r.end - r.start, r.other_end - r.other_start) >= 50 and r.matched >= 0.75 * r.n_words
        assert r.end <= len(w[r.doc_id]) and r.doc_id > r.other_id
    assert passages.find(table(spark, [])).count() == 0


def test_dropped_passages(spark):
    df = table(spark)
    out = passages.drop_passages(df)
    assert out.columns == df.columns and out.count() == df.count()
    t = {r.doc_id: r.text for r in out.collect() if r.doc_id is not None}
    src = dict((i, x) for i, x in documents() if i is not None)
    assert t[3] == src[3] and t[40] == src[40] and t[10] == "" and len(words(t[41])) < len(words(src[41])) - 60
    assert t[30] is None and t[52] == src[52]
    assert passages.without("a b\tc  d e", [(1, 3)]) == "a d e" and passages.without("a b c", [(0, 2), (1, 3)]) == ""


@pytest.mark.parametrize("n, every", [(55, 10), (55, 8), (60, 8), (80, 7)])
def test_edited_passages_are_found(spark, n, every):
    rows = []
    for g in range(12):
        p = prose(3000 + g, n)
        rows += [(10 * g, prose(3100 + g, 40) + " " + p + " " + prose(3200 + g, 30)), (10 * g + 1, prose(3300 + g, 25) + " " + edited(p, g, every) + " " + prose(3400 + g, 60))]
    got = {(r.other_id, r.doc_id) for r in passages.find(table(spark, rows)).collect()}
    assert got == {(10 * g, 10 * g + 1) for g in range(12)}


@pytest.mark.parametrize("common", [25, 30, 45])
def test_passages_with_a_part_that_others_hold(spark, common):
    p = prose(4000, 60)
    part = " ".join(p.split(" ")[:common])
    rows = [(i, prose(4100 + i, 70) + " " + (p if i in (5, 7) else part) + " " + prose(4200 + i, 40)) for i in (1, 2, 5, 7, 8, 9)]
    got = passages.find(table(spark, rows)).collect()
    assert [(r.other_id, r.doc_id, r.other_start, r.other_end, r.start, r.end) for r in got] == [(5, 7, 70, 130, 70, 130)]


def test_passages_whose_parts_all_have_other_holders(spark):
    """Two texts share 160 words; of each 40 of these, earlier and later texts have a copy."""
    p = prose(6000, 160).split(" ")
    part = [" ".join(p[i : i + 40]) for i in range(0, 160, 40)]
    rows = [(i, prose(6100 + i, 30) + " " + part[i % 4] + " " + prose(6200 + i, 30)) for i in (0, 1, 2, 3, 90, 91, 92, 93)]
    rows += [(i, prose(6100 + i, 50) + " " + " ".join(p) + " " + prose(6200 + i, 20)) for i in (50, 51)]
    got = passages.find(table(spark, rows)).collect()
    assert [(r.other_id, r.doc_id, r.start, r.end) for r in got] == [(50, 51, 50, 210)]


def test_two_frequent_lines_in_a_row(spark):
    one, two = prose(6300, 30), prose(6301, 30)
    rows = [(i, prose(6400 + i, 60) + " " + (one, two)[i % 2] + " " + prose(6500 + i, 60)) for i in range(40)]
    rows += [(i, prose(6400 + i, 60) + " " + one + " " + two + " " + prose(6500 + i, 60)) for i in (18, 19)]
    got = {(r.other_id, r.doc_id, r.start, r.end) for r in passages.find(table(spark, [*rows[:18], *rows[20:]])).collect()}
    assert got == {(18, 19, 60, 120)}


def test_passages_of_a_third_of_all_texts(spark):
    p = prose(6600, 70)
    rows = [(i, prose(6700 + i, 40) + (" " + p if i % 3 == 0 else "") + " " + prose(6900 + i, 40)) for i in range(90)]
    found = passages.find(table(spark, rows)).collect()
    assert {r.doc_id for r in found} | {r.other_id for r in found} == set(range(0, 90, 3))
    assert all(abs(r.start - 40) <= 3 and abs(r.end - 110) <= 3 for r in found) and len(found) < 90
    out = {r.doc_id: r.text for r in passages.drop_passages(table(spark, rows)).collect()}
    assert [i for i in range(90) if p in out[i]] == [0] and all(len(words(out[i])) in range(74, 81) for i in range(1, 90))


def test_a_frequent_passage_stays_with_the_smallest_id_only(spark):
    p = prose(8000, 60)
    rows = [(i, prose(8100 + i, 40) + " " + p + " " + prose(8200 + i, 40)) for i in (7, 19, 3, 11, 2, 18, 5, 9, 14, 1, 16, 12, 4)]
    out = {r.doc_id: r.text for r in passages.drop_passages(table(spark, rows)).collect()}
    assert [i for i in sorted(out) if p in out[i]] == [1]
    assert {r.doc_id for r in passages.find(table(spark, rows)).collect()} == {i for i, _ in rows} - {1}


def test_a_whole_passage_all_of_whose_seeds_are_frequent(spark):
    """Of a passage of 70 words that two texts hold, each part of 35 words has twelve other holders, before and after."""
    p = prose(8300, 70).split(" ")
    part = [" ".join(p[i : i + 35]) for i in (0, 18, 35)]
    rows = [(i, prose(8400 + i, 40) + " " + part[i % 3] + " " + prose(8500 + i, 40)) for i in (*range(18), *range(60, 78))]
    rows += [(i, prose(8400 + i, 50) + " " + " ".join(p) + " " + prose(8500 + i, 20)) for i in (50, 51)]
    got = passages.find(table(spark, sorted(rows))).collect()
    assert [(r.other_id, r.doc_id, r.start, r.end) for r in got if r.n_words >= 70] == [(50, 51, 50, 120)]


def test_words_that_go_round(spark):
    for words_, n in (("ring", 60), ("here we", 35)):
        p = " ".join([words_] * n)
        rows = [(i, prose(8600 + i, 45) + " " + p + " " + prose(8700 + i, 45)) for i in (4, 9)]
        got = passages.find(table(spark, rows)).collect()
        assert [(r.other_id, r.doc_id, r.start, r.end) for r in got] == [(4, 9, 45, 45 + len(words(p)))]


def test_a_passage_is_not_lost_for_what_lies_beside_it():
    p, q = np.arange(1000, 1052), np.arange(2000, 2020)
    a, b = (np.concatenate([s + np.arange(30), p, s + 100 + np.arange(38), q, s + 200 + np.arange(30)]).astype("<u4") for s in (10_000, 20_000))
    assert (30, 82, 30, 82, 52) in passages.meet(passages.Text(a.tobytes()), passages.Text(b.tobytes()), 50)


@pytest.mark.parametrize("share", [0, 0.05, 0.1, 0.2])
def test_recall_against_all_pairs(spark, share):
    """Passages of 50 to 120 words in which a share of the words, at random places, is changed."""
    rng = random.Random(int(100 * share))
    rows, good = [], 0
    for g in range(40):
        p = prose(7000 + g, rng.randint(50, 120)).split(" ")
        q = [f"x{rng.randint(0, 9999)}" if rng.random() < share else w for w in p]
        good += min(sum(x == y for x, y in zip(p, q)) / len(p), 0.75) == 0.75
        rows += [(2 * g, prose(7100 + g, 40) + " " + " ".join(p) + " " + prose(7200 + g, 40)), (2 * g + 1, prose(7300 + g, 20) + " " + " ".join(q) + " " + prose(7400 + g, 70))]
    texts = [passages.Text((hash_words(pa.array([t]))[0] >> np.uint64(32)).astype("<u4").tobytes()) for _, t in rows]
    want = {(i, j) for j in range(len(rows)) for i in range(j) if any(min(e - s, f - t) >= 50 and m >= 0.75 * max(e - s, f - t) for s, e, t, f, m in passages.meet(texts[i], texts[j], 50))}
    got = {(r.other_id, r.doc_id) for r in passages.find(table(spark, rows)).collect()}
    assert got == want and got <= {(2 * g, 2 * g + 1) for g in range(40)}
    assert len(got) >= 0.9 * good


def test_ends_grow_through_changes():
    a = list(range(60))
    b = [100 + i for i in range(9)] + [99 if i in (6, 13, 45, 52) else w for i, w in enumerate(a) if i != 20] + [200 + i for i in range(9)]
    a, b = np.array(a), np.array(b)
    assert passages.align(a, b, [(25, 33, 15)]) == (0, 60, 9, 68, 55)
    assert passages.align(a[:30], np.concatenate([[91] * 5, a[10:20], [92] * 5]), [(10, 5, 10)]) == (10, 20, 5, 15, 10)
    long = np.arange(1, 5000)
    assert passages.align(long, long, [(2000, 2000, 15)]) == (0, 4999, 0, 4999, 4999)


def test_passages_are_dropped_by_row(spark):
    p, q = prose(5000, 60), prose(5001, 70)
    held, clean = prose(5002, 30) + " " + p, prose(5003, 140)
    rows = [(1, p + " " + prose(5004, 20)), (None, held), (None, clean), (7, prose(5005, 90)), (7, p), (None, q + " end"), (None, "Start " + q)]
    got = sorted(((r.doc_id, r.text) for r in passages.drop_passages(table(spark, rows)).collect()), key=str)
    want = [rows[0], (None, prose(5002, 30)), rows[2], rows[3], (7, "")]
    for ends in ([rows[5], (None, "Start")], [(None, "end"), rows[6]]):
        if got == sorted(want + ends, key=str):
            return
    raise AssertionError([(i, t[:40], len(words(t))) for i, t in got])


def test_texts_are_cut_where_they_are(spark):
    p = prose(9500, 70)
    docs = table(spark, [(i, prose(9510 + i, 60) + " " + p) for i in range(3)])
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = passages.drop_passages(docs)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert sorted(len(words(r.text)) for r in out.collect()) == [60, 60, 130]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert plan.count("Exchange hashpartitioning") == 2  # the passages of a row, for the rows that have some and for the others


def test_chains_maximise():
    blocks = np.array([[0, 0, 20], [25, 25, 20], [30, 500, 9], [60, 58, 20], [10, 900, 6]])
    assert passages.chains(blocks)[0] == [0, 1, 3]
    assert sorted(i for c in passages.chains(blocks) for i in c) == [0, 1, 2, 3, 4]


def embeddings(spark):
    rng = np.random.default_rng(5)
    rows, n = [], 0
    for label in (1, 2):
        for _ in range(25):
            c = rng.normal(size=16)
            for _ in range(int(rng.integers(1, 6))):
                rows.append((n, (c + rng.normal(size=16) * rng.choice([0.02, 0.07, 0.1])).tolist(), label))
                n += 1
    rows += [(n, rows[0][1], 1), (n + 1, rows[0][1], 2), (n + 2, [0.0] * 16, 1), (n + 3, None, 1), (n + 4, [None] * 16, 1), (n + 5, [float("nan")] * 16, 1), (n + 6, rows[0][1], None), (n + 7, [1.0], 1), (n + 8, [2.0], 1), (n + 9, [], 1), (None, rows[0][1], 1), (3, rows[3][1], 1)]
    return rows, spark.createDataFrame([(*r, 5, "c") for r in rows], "vec_id long, embedding array<double>, label int, n_links int, cls string")


def test_vectors(spark):
    rows, df = embeddings(spark)
    ok = [e is not None and len(e) and None not in e and np.isfinite(e).all() and np.any(e) and lab is not None for _, e, lab in rows]
    f, n = Find(), [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= 0.98:
                    f.join(i, j)
                    n[i] += 1
                    n[j] += 1
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[f.root(i)].append(r[0])
    want = []
    for i, r in enumerate(rows):
        c = min((x for x in least[f.root(i)] if x is not None), default=None)
        want.append((r[0], n[i], c, r[0] is not None and r[0] == c))
    got = [tuple(r) for r in vectors.near_duplicates(df, cells=5).select("vec_id", "n_links", "component_id", "kept").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert max(n) >= 3
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_traversal_is_ordered_and_whole():
    rng = np.random.default_rng(2)
    a, b = rng.random(6), rng.random(7)
    cells = list(vectors.traverse(a, b, 1.0))
    sums = [a[i] + b[j] for i, j in cells]
    assert sums == sorted(sums) and len(set(cells)) == len(cells) == int((a[:, None] + b[None] <= 1.0).sum())


def test_spanning_connects_all():
    rng = np.random.default_rng(3)
    for _ in range(50):
        mask = rng.random((9, 8)) < 0.15
        f, g = Find(), Find()
        for i, j in zip(*np.nonzero(mask)):
            f.join(("r", i), ("c", j))
        for i, j in vectors.spanning(mask):
            assert mask[i, j]
            g.join(("r", i), ("c", j))
        nodes = [("r", i) for i in range(9)] + [("c", j) for j in range(8)]
        for x in nodes:
            for y in nodes:
                assert (f.root(x) == f.root(y)) == (g.root(x) == g.root(y))


def test_language_model(spark):
    rows = documents() + [(500 + i, prose(700 + i, 150)) for i in range(60)]
    got = lm.score(table(spark, rows)).collect()
    low = [(i, (t or "").translate(LOWER)) for i, t in rows]
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    c = Counter()
    for i, t in low:
        if not held(i):
            c.update([*words(t), "\n"])
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t in low:
        own = [*words(t), "\n"]
        want[(i, held(i), len(own), sum(c[w] > 0 for w in own), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own), 4))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    brute = slow_tree([t for i, t in low if not held(i)], 5)
    texts = defaultdict(list)
    for i, t in low:
        texts[i].append(t)
    for r in got:
        if r.n_bytes < 400:
            assert any(r.score == pytest.approx(brute(t), rel=1e-6, abs=1e-6) for t in texts[r.doc_id])
    assert lm.score(table(spark, [])).count() == 0


def slow_tree(train, depth):
    """Context-tree weighting written out node by node."""
    counts = defaultdict(lambda: [0, 0])
    kids = defaultdict(set)

    def steps(text):
        data = b"\xff" * depth + text.encode() + b"\xff"
        for p in range(depth, len(data)):
            ctx = data[p - depth : p][::-1]
            node = 1
            for k in range(7, -1, -1):
                bit = data[p] >> k & 1
                yield ctx, node, bit
                node = node * 2 + bit

    for t in train:
        for ctx, node, bit in steps(t):
            for d in range(depth + 1):
                counts[ctx[:d], node][bit] += 1
                if d:
                    kids[ctx[: d - 1], node].add(ctx[:d])
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    memo = {}

    def weighted(ctx, node):
        if (ctx, node) not in memo:
            own = kt(*counts[ctx, node])
            if len(ctx) < depth:
                own = float(np.logaddexp(own, sum(weighted(c, node) for c in kids[ctx, node]))) - math.log(2)
            memo[ctx, node] = own
        return memo[ctx, node]

    def p_one(ctx, d, node):
        a, b = counts[ctx[:d], node]
        own = (b + 0.5) / (a + b + 1)
        if d == depth or (ctx[: d + 1], node) not in counts:
            return own
        w = math.exp(kt(a, b) - math.log(2) - weighted(ctx[:d], node))
        return w * own + (1 - w) * p_one(ctx, d + 1, node)

    def score(text):
        total = 0.0
        for ctx, node, bit in steps(text):
            p = p_one(ctx, 0, node) if (b"", node) in counts else 0.5
            total += math.log10(p if bit else 1 - p)
        return total

    return score
