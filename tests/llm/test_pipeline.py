import random
import re
from collections import Counter

import corpus_pipeline as C
import numpy as np
import pytest
from pyspark.sql import functions as F

from deskdb.llm import mixing, quality, simhash
from deskdb.llm.common import documents, saved
from deskdb.llm.exact_dedup import WHITE


def plain(text):
    return (text or "").translate(str.maketrans("", "", WHITE))


def test_stages_one_by_one(spark):
    """Each stage on what its predecessor kept, against a slow version of it."""
    sf = "/root/testdata/sf0.001"
    docs = documents(spark, sf)
    labels = {r["doc_id"]: r["quality"] for r in documents(spark, sf, "labels").collect()}
    steps = dict(C.STAGES)
    kept = saved(steps["quality"](spark, docs, sf), "p1")
    assert kept.schema == docs.schema
    scores = {r["doc_id"]: r["predicted"] for r in quality.classify(docs, documents(spark, sf, "labels")).collect()}
    one = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert set(one) == {i for i, p in scores.items() if p} and not [i for i, y in labels.items() if y == 1 and i not in one]

    kept = saved(steps["exact dedup"](spark, kept, sf), "p2")
    best = {}
    for i, t in one.items():
        k = plain(t)
        best[k] = min(best.get(k, (0, 10**9)), (-len(t), i))
    two = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert set(two) == {i for _, i in best.values()}

    kept = saved(steps["near dedup"](spark, kept, sf), "p3")
    ids = sorted(two)
    near = slow_similar([two[i] for i in ids])
    root = list(range(len(ids)))
    for _ in ids:
        root = [min(root[j] for j in np.flatnonzero(near[i])) for i in range(len(ids))]
    three, want = {r["doc_id"] for r in kept.collect()}, {ids[r] for r in root}
    assert want <= three and len(three) < len(two) and len(three - want) <= 0.1 * (len(two) - len(want)) + 1  # found by fingerprints: nine in ten at least

    kept3 = kept
    kept = saved(steps["mixing"](spark, kept, sf), "p4")
    times = Counter(r["doc_id"] for r in kept.collect())
    assert set(times) <= three and set(times.values()) <= {1, 2} and kept.schema == docs.schema
    assert times == {r["doc_id"]: r["passes"] for r in mixing.mix(kept3).collect() if r["passes"]}

    tokens = Counter()
    for r in steps["packing"](spark, kept, sf).collect():
        tokens[r["doc_id"]] += r["length"]
    once = {r["doc_id"]: r["doc_tokens"] for r in steps["packing"](spark, kept, sf).collect()}
    assert tokens == {i: n * once[i] for i, n in times.items()}


def test_run(spark):
    got = C.run(spark, "/root/testdata/sf0.001").collect()
    assert got and max(r["offset"] + r["length"] for r in got) <= 2048


@pytest.mark.parametrize("stage", [s for s, _ in C.STAGES])
def test_awkward_rows(spark, awkward, no_rows, stage):
    rows, docs = awkward
    run = dict(C.STAGES)[stage]
    for d in (docs, docs.union(docs), no_rows):
        out = run(spark, d, "/root/testdata/sf0.001")
        if stage != "packing":
            assert out.schema == d.schema
        assert out.count() <= 2 * d.count() + 20


def slow_similar(texts):
    """Which pairs of texts have 0.8 of their 5-word shingles in common."""
    def shingles(t):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in texts]
    return np.array([[len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets]).reshape(len(sets), len(sets))


def test_similar_rows_are_those_of_brute_force(spark):
    """Texts with every share of changed words: no false link, and 95% of the true ones connected."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = []
    for g in range(60):
        base = [word() for _ in range(rng.choice([3, 6, 40, 150, 400]))]
        texts.append(base)
        for _ in range(rng.randint(0, 4)):
            share = rng.choice([0.005, 0.01, 0.02, 0.04, 0.1])
            texts.append([w if rng.random() > share else word() for w in base])
    texts = [" ".join(t) for t in texts] + ["", None, " \t"]
    got = {r["doc_id"]: r["root"] for r in simhash.similar_rows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    near = slow_similar(texts)
    reach = near.copy()
    for _ in range(8):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    same = np.array([[got[i] == got[j] for j in range(len(texts))] for i in range(len(texts))])
    assert not (same & ~reach).any()
    pairs = np.triu(near, 1)
    assert pairs.sum() > 60 and (same & pairs).sum() >= 0.95 * pairs.sum()


def test_similar_rows_that_fingerprints_miss(spark):
    """Links of 0.8 and more whose fingerprints differ in more bits than the index searches, and such behind a row of their own fingerprint: all are connected."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    pairs = []
    while len(pairs) < 25:
        words = [word() for _ in range(9)]
        texts = [" ".join(words), " ".join(words[:8])]
        one, two = (int(f) for f in simhash.simhash(texts, simhash.SIMILAR_WORDS))
        if (one ^ two).bit_count() > simhash.REACH:
            pairs.append(texts)
    assert all(slow_similar(p).all() for p in pairs)
    got = {r["doc_id"]: r["root"] for r in simhash.similar_rows(spark.createDataFrame([(k, t) for k, t in enumerate(t for p in pairs for t in p)], "doc_id long, text string")).collect()}
    assert len(got) == 50 and all(got[2 * k] == got[2 * k + 1] for k in range(25)) and len(set(got.values())) == 25
    kept = simhash.one_of_similar(spark.createDataFrame([(k, t) for k, t in enumerate(t for p in pairs for t in p)], "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in kept} == set(range(0, 50, 2))


@pytest.mark.parametrize("similarity", [0.8, 0.6, 0.9])
def test_similar_sets_have_a_key_in_common(similarity):
    rng, seen = np.random.default_rng(3), 0
    for _ in range(4000):
        x = np.unique(rng.integers(0, 2**32, int(rng.integers(1, 90)), dtype=np.uint32))
        y = np.unique(np.concatenate([rng.permutation(x)[rng.integers(0, len(x) // 4 + 1) :], rng.integers(0, 2**32, rng.integers(0, len(x) // 4 + 1), dtype=np.uint32)]))
        both = len(np.intersect1d(x, y))
        if both < len(x) + len(y) - both and both >= similarity * (len(x) + len(y) - both):
            seen += 1
            assert len(np.intersect1d(simhash.part_keys(x, similarity), simhash.part_keys(y, similarity)))
    assert seen > 100


@pytest.mark.parametrize("leaders", [0, 1])
def test_no_link_of_similar_rows_is_left_out(spark, monkeypatch, leaders):
    """Without any link by fingerprints, and with a group in which all share keys but few are similar: the components of brute force."""
    monkeypatch.setattr(simhash, "similar_candidates", lambda classes, n: classes.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0))
    monkeypatch.setattr(simhash, "LEADERS", leaders)
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts, base = [], [word() for _ in range(60)]
    for _ in range(150):
        k, n = rng.randint(0, 20), rng.randint(1, 12)
        texts.append([*base[k:], *[word() for _ in range(n)]])
    for _ in range(60):
        own = [word() for _ in range(rng.randint(1, 80))]
        texts += [own, own, [*own[rng.randint(0, 2) :], *[word() for _ in range(rng.randint(0, 8))]]]
    texts = [" ".join(t) for t in texts] + ["", None, " \t"]
    near = slow_similar(texts)
    while True:
        further = (near.astype(int) @ near.astype(int)) > 0
        if (further == near).all():
            break
        near = further
    got = {r["doc_id"]: r["root"] for r in simhash.similar_rows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    same = np.array([[got[i] == got[j] for j in range(len(texts))] for i in range(len(texts))])
    assert (same == near).all()


@pytest.mark.parametrize("seed", range(10))
def test_spanning_forest_is_least(seed):
    rng = np.random.default_rng(seed)
    a, b, cost = rng.integers(0, 30, 60), rng.integers(0, 30, 60), rng.integers(0, 5, 60)
    got = simhash.spanning(30, a, b, cost)
    root, want, links = list(range(30)), 0, 0

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k in np.argsort(cost, kind="stable").tolist():
        x, y = find(int(a[k])), find(int(b[k]))
        if x != y:
            root[x], want, links = y, want + int(cost[k]), links + 1
    assert len(got) == links == len(set(got.tolist())) and cost[got].sum() == want


def test_large_groups_ask_for_more_bits(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MANY", 20)
    base = [f"w{k}" for k in range(200)]
    texts = [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(150)]
    got = simhash.one_of_similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert 1 <= len(got) <= 3 and min(r["doc_id"] for r in got) == 0


def test_near_dedup_keeps_one_of_each(spark, awkward):
    rows, docs = awkward
    got = simhash.one_of_each(docs.union(docs)).collect()
    prints = simhash.simhash([r["text"] for r in got]).tolist()
    assert len(set(prints)) == len(prints)
