import random
import time

import numpy as np
import pyarrow as pa

from deskdb.llm import simhash


def test_long_sketches_rule_out_no_similar_pair():
    """Pairs on both sides of 0.8 and of very different sizes: what brute force finds passes, and few others do."""
    rng, similar, others, passed = np.random.default_rng(11), 0, 0, 0
    for _ in range(1500):
        n = int(rng.choice([1, 2, 9, 40, 300, 1500]))
        x = np.unique(rng.integers(0, 2**32, n, dtype=np.uint32))
        lost, new = (int(rng.integers(0, 1 + int(n * rng.choice([0.12, 0.3, 1])))) for _ in range(2))
        y = np.unique(np.concatenate([rng.permutation(x)[lost:], rng.integers(0, 2**32, new, dtype=np.uint32)]))
        both = len(np.intersect1d(x, y))
        row = pa.RecordBatch.from_pydict({"a": [1], "b": [2], "size_a": [len(x)], "size_b": [len(y)], "odd_a": [simhash.long_sketch(x).tobytes()], "odd_b": [simhash.long_sketch(y).tobytes()]})
        may = next(simhash._may_be_alike(0.8)([row])).num_rows
        if both >= 0.8 * (len(x) + len(y) - both):
            similar += 1
            assert may
        elif n > 9 and both < 0.7 * (len(x) + len(y) - both):
            others, passed = others + 1, passed + may
    assert similar > 200 and others > 200 and passed < 0.02 * others


def test_near_dedup_compares_and_leaves_little(spark, monkeypatch, tmp_path):
    """Sets of rows that sketches rule out are not moved to be compared, and shuffle files go with the statement that made them."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    line = [word() for _ in range(60)]
    texts = [" ".join([*line, *[word() for _ in range(60 + k)]]) for k in range(60)]
    texts += [t + " " + word() for t in texts[:3]]
    moved = []

    def compared(df, name, of=simhash.saved):
        out = of(df, name)
        if name == "compared":
            moved.append(out.count())
        return out

    monkeypatch.setattr(simhash, "saved", compared)
    made, seen = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager(), []
    files = lambda: sum(f.getName().startswith("shuffle_") for f in (made.getAllFiles().apply(k) for k in range(made.getAllFiles().size())))
    spark.sparkContext._jvm.System.gc()
    before = files()
    got = simhash.one_of_similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for _ in range(50):  # files are deleted beside what runs
        seen.append(files() - before)
        if seen[-1] <= 24:
            break
        time.sleep(0.1)
    assert seen[-1] <= 24
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(60))
    assert moved and max(moved) <= 6
