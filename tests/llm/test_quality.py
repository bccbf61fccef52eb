import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from deskdb.llm import quality as Q
from deskdb.llm.common import documents


def test_held_out_accuracy(spark):
    got = Q.op5_quality(spark, "/root/testdata/sf0.1").join(documents(spark, "/root/testdata/sf0.1", "labels"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got) and len(held) > 500
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got)
    good, bad = (np.array([r["score"] for r in held if r["quality"] == y]) for y in (1, 0))
    assert (good[:, None] > bad[None]).mean() > 0.99
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.98


def test_weights_lower_the_loss_to_its_least():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 3))
    y = (x @ [2, -1, 0] + rng.logistic(size=120) > 0).astype(int)
    r = Q.fit(x, y)
    z = np.clip((x - r.mean) / r.scale, -20, 20)
    d = np.array([z[i] - z[j] for i in np.flatnonzero(y == 1) for j in np.flatnonzero(y == 0)])
    loss = lambda w: np.log1p(np.exp(-d @ w)).mean() + Q.RIDGE * (w @ w) / 2
    best = loss(r.weights)
    for _ in range(200):
        assert loss(r.weights + rng.normal(size=3) * 0.05) >= best - 1e-12
    s = np.sort(r.strength(x))
    assert s[(y == 0).sum() - 1] <= r.threshold <= s[(y == 0).sum()]
    assert ((r.score(x) >= 0.3) == (r.strength(x) >= r.threshold)).all() and (np.argsort(r.score(x), kind="stable") == np.argsort(r.strength(x), kind="stable")).all()


@pytest.mark.parametrize("y", [[], [1, 1], [0, 0]])
def test_one_kind_of_label_only(y):
    r = Q.fit(np.ones((len(y), len(Q.FEATURES))), np.array(y, int))
    score = r.score(np.ones((1, len(Q.FEATURES))))[0]
    assert (score >= 0.3) == (y != [0, 0])


def test_features_do_not_depend_on_slices(monkeypatch):
    text = "Some words. AND SOME!! more | words of of of 12 %% é\n" * 300
    whole = Q.text_features(text)
    assert len(whole) == len(Q.FEATURES)
    monkeypatch.setattr(Q, "SLICE", 1000)
    assert np.allclose(Q.text_features(text), whole)
    assert Q.text_features(None) == Q.text_features("") and np.isfinite(Q.text_features("")).all() and np.isfinite(Q.text_features("\0" * 50)).all()


def test_awkward_rows(spark, awkward, no_rows):
    rows, docs = awkward
    labels = spark.createDataFrame([(1, 1, None), (2, None, 1), (None, 0, 0), (4, 0, 0), (5, 1, 0), (5, 0, 0), (6, 0, None), (8, 1, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = Q.classify(docs, labels).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows) and all(0 <= r["score"] <= 1 for r in got) and not any(r["held_out"] for r in got if r["doc_id"] is None)
    assert Q.classify(no_rows, labels).collect() == [] and Q.classify(docs, labels.limit(0)).count() == len(rows)


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs, labels = documents(spark, "/root/testdata/sf0.001"), documents(spark, "/root/testdata/sf0.001", "labels")
    turned = labels.withColumn("quality", F.when(Q.fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r["doc_id"]: r["score"] for r in Q.classify(docs, x).collect()} for x in (labels, turned))
    assert a == b
    c = {r["doc_id"]: r["score"] for r in Q.classify(docs.withColumns({"lang": F.lit("x"), "source": F.lit("y")}), labels).collect()}
    assert a == c


def test_slices_cut_no_word(monkeypatch):
    lines = "\n".join(f"Line{k} of it\tand MORE" for k in range(300)) + "x" * 500
    want = Q.text_features(lines)
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(Q, "SLICE", size)
        assert Q.text_features(lines) == pytest.approx(want, abs=1e-12)


def test_every_labelled_row_is_in_some_pair(monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] + rng.normal(size=300) > 0.8).astype(int)
    seen = []
    monkeypatch.setattr(Q.np, "resize", lambda rows, n: seen.append(set(rows.tolist())) or np.concatenate([rows] * (n // len(rows) + 1))[:n])
    r = Q.fit(x, y, max_pairs=600)
    assert seen == [set(np.flatnonzero(y == 1).tolist()), set(np.flatnonzero(y == 0).tolist())] and abs(r.weights[0]) > abs(r.weights[1])


def test_ids_beyond_floats(spark):
    docs = spark.createDataFrame([(2**53 + 1, "A good text of words."), (None, "zzz !!! ###"), (2**63 - 1, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(2**53 + 1, 1), (None, 0)], "doc_id long, quality int")
    assert {r["doc_id"] for r in Q.classify(docs, labels).collect()} == {2**53 + 1, None, 2**63 - 1}


def slow_features(text):
    """The features by their definition, character by character over the text's bytes."""
    raw = (text or "").encode()
    words, word = [], []
    for b in raw:
        if b in b" \t\n\x0b\x0c\r":
            if word:
                words.append(bytes(word))
            word = []
        else:
            word.append(b)
    words += [bytes(word)] if word else []
    share = lambda test: sum(map(test, raw)) / max(1, len(raw))
    out = [share(lambda b, c=c: b in c) for c in Q.CLASSES] + [share(lambda b: b >= 128)]
    w = max(1, len(words))
    out.append(sum(a == b for a, b in zip(words, words[1:])) / w)
    out.append(sum(len(set(words[k : k + 200])) for k in range(0, len(words), 200)) / w)
    out += [min(50, len(raw) / w) / 10, math.log(1 + len(words)) / 10, sum(x.isupper() for x in words) / w, float(not words)]
    return out


def test_features_equal_slow_ones(spark):
    texts = [r["text"] for r in documents(spark, "/root/testdata/sf0.001").limit(60).collect()] + [None, "", " \n", "A", "a a a A A", "x" * 3000, "ünï ÇØ 日本 😀\x01\x7f"]
    for t in texts:
        assert Q.text_features(t) == pytest.approx(slow_features(t), abs=1e-12)
    assert len(slow_features("a")) == len(Q.FEATURES)
