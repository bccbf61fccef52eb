import random
import re

import numpy as np
import pytest
import xxhash

from deskdb.llm import simhash as S
from deskdb.llm.common import saved


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(prints, most=4):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in prints:
        for b in prints:
            if a < b and bin(a ^ b).count("1") <= most:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {p: find(p) for p in prints}


def texts():
    rng = random.Random(5)
    words = ["alpha", "Beta", "GAMMA", "é", "日本語テキスト", "x" * 40, "y" * 5000, "İ", "tail,"]
    made = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    return made + [None, "", " \t\n", "one", "one two three", "a  b\x0bc\x0cd\re", "a b c d e", "z " * 3000]


def test_fingerprints_equal_slow_ones():
    assert [int(x) for x in S.simhash(texts())] == [slow_print(t) for t in texts()]


def test_steps_do_not_matter(monkeypatch):
    want = S.simhash(texts())
    monkeypatch.setattr(S, "STEP_BYTES", 500)
    assert (S.simhash(texts()) == want).all()


def planted(n=400, seed=3):
    """Random fingerprints, chains of near ones and a dense cloud."""
    rng = np.random.default_rng(seed)
    out = set(rng.integers(0, 2**64, n, dtype=np.uint64).tolist())
    for base in list(out)[:40]:
        x = base
        for _ in range(rng.integers(1, 5)):
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(b)
            out.add(x)
    cloud = list(out)[50]
    out |= {cloud ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (80, 2)) if a != b}
    return sorted(out | {0, 2**64 - 1, 1})


def test_index_finds_what_brute_force_finds():
    fps = np.array(planted(), np.uint64)
    fps = fps[np.argsort(S.gray_rank(fps))]
    unit = np.repeat([3, 9], [100, len(fps) - 100])
    q, e = S.GrayIndex(unit, fps).search(unit, fps, 4)
    far = np.bitwise_count(fps[:, None] ^ fps[None]) <= 4
    want = {(i, j) for i, j in zip(*np.nonzero(far)) if unit[i] == unit[j]}
    assert set(zip(q.tolist(), e.tolist())) == want


def test_links_connect_what_brute_force_connects(spark):
    fps = planted()
    want = slow_components(fps)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in fps]
    classes = spark.createDataFrame(signed, "fp long")
    for n, tile in ((len(fps), 10**6), (1 << 40, 10**6), (len(fps), 8)):  # one block, three blocks, groups cut into tiles
        got = {r["node"] % 2**64: r["root"] % 2**64 for r in S.components(S.fingerprint_links(classes, n, tile=tile)).collect()}
        assert set(got) == {p for p in fps if sum(want[q] == want[p] for q in fps) > 1}
        groups = {}
        for p, r in got.items():
            groups.setdefault(r, set()).add(want[p])
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({next(iter(g)) for g in groups.values()})


def test_query_rows(spark):
    rows = [(k, t, "x") for k, t in enumerate(texts())] + [(None, "one", "x"), (7, texts()[7], "x"), (7, texts()[7], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = S.simhash_components(docs).collect()
    prints = {}
    for i, t, _ in rows:
        prints.setdefault(slow_print(t), []).append(i)
    roots = slow_components(list(prints))
    least = {}
    for p, ids in prints.items():
        least.setdefault(roots[p], []).extend(i for i in ids if i is not None)
    want = sorted(((i, f"{slow_print(t):016x}", min(least[roots[slow_print(t)]], default=None)) for i, t, _ in rows), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want


def test_empty_table(spark):
    assert S.simhash_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_one_of_each_keeps_components_without_or_with_equal_ids_apart(spark):
    rng = random.Random(8)
    made = [" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(80)) for _ in range(40)]
    rows = [(None, t) for t in made[:30]] + [(None, made[0]), (7, made[30]), (7, made[31]), (7, made[32]), (7, made[30])] + [(50 + k, t) for k, t in enumerate(made[33:])]
    assert len({slow_print(t) for t in made}) == 40 == len(set(slow_components([slow_print(t) for t in made]).values()))
    got = S.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, got)) == sorted(str(r) for r in spark.createDataFrame(sorted(set(rows), key=str), "doc_id long, text string").collect())


@pytest.mark.parametrize("tile", [2, 5, 20])
def test_hot_groups_are_dealt_out_again(spark, tile):
    """Many fingerprints that share a block: all links are found in the finer groups and their tiles."""
    rng = np.random.default_rng(tile)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    fps = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, (40, 3), dtype=np.uint64)).sum(1, dtype=np.uint64) for b in base]))
    classes = saved(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"), "hot-classes")
    got = {r["node"] % 2**64: r["root"] % 2**64 for r in S.components(S.fingerprint_links(classes, len(fps), tile=tile)).collect()}
    groups = {}
    for x, root in slow_components(fps.tolist()).items():
        groups.setdefault(root, set()).add(got.get(x, x))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_masks_cover_the_bits_once():
    for mask in (2**64 - 1, 0xFF00FF, (1 << 64) - (1 << 13)):
        parts = S.runs_of(mask, 5)
        assert sum(parts) == mask and max(x.bit_count() for x in parts) - min(x.bit_count() for x in parts) <= 1
