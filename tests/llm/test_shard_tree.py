import hashlib
import math
import zlib
from collections import Counter

import pytest

from deskdb.llm import shard_tree as S


def slow_walk(key, node, path):
    steps = []
    while node.children:
        def draw(c):
            u = (int(hashlib.md5(f"{key}{path}/{c.name}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
            return math.log(u) / c.weight
        node = max((c for c in node.children if c.weight > 0), key=draw)
        path += f"/{node.name}"
        steps.append(node)
    return steps


def slow_place(key, root):
    for k in range(S.ATTEMPTS):
        region, *_, slot = slow_walk(key, root, f"#{k}" if k else "")
        if slot.shard >= 0 and (not k or not region.whole):
            return slot.shard
        if region.whole:
            break
    rest = S.Node("root", tuple(c for c in root.children if c.whole))
    return slow_walk(key, rest, "")[-1].shard if rest.children else 0


def placed(spark, root, n=3000):
    return {r[0]: r[1] for r in spark.range(n).select("id", S.place("cast(id AS string)", root)).collect()}


def test_awkward_rows(awkward):
    rows, docs = awkward
    root = S.tree(24)
    got = S.shard_documents(docs, root).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in got) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), "key", slow_place("null" if i is None else i, root), slow_place("null" if i is None else i, S.grow(root))) for i, t, *_ in rows
    )
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_one_more_shard_takes_rows_only_into_itself(spark):
    for n in (24, 25, 7, 8):
        root = S.tree(n)
        old, new = placed(spark, root), placed(spark, S.grow(root))
        moved = {k for k in old if old[k] != new[k]}
        assert moved and all(new[k] == n for k in moved) and abs(len(moved) / len(old) - 1 / (n + 1)) < 0.03
        assert set(old.values()) == set(range(n))


@pytest.mark.parametrize("sizes", [(8, 4), (6, 4), (3, 1)])
def test_every_number_of_shards_grows_into_the_new_one_alone(sizes):
    keys, old = range(400), None
    for n in range(1, 66):
        root = S.tree(n, *sizes)
        assert n == 1 or root == S.grow(S.tree(n - 1, *sizes))
        new = [slow_place(k, root) for k in keys]
        assert old is None or all(a == b or b == n - 1 for a, b in zip(old, new))
        assert set(new) <= set(range(n)) and (n < sizes[0] or n > 10 or max(Counter(new).values()) < 2 * 400 / n)
        old = new


@pytest.mark.parametrize("n", [1, 5, 8, 9, 25, 31, 40])
def test_places_are_those_of_the_slow_walk(spark, n):
    root = S.tree(n, weights={0: 2.0, n - 1: 0.5})
    assert placed(spark, root, 500) == {k: slow_place(k, root) for k in range(500)}


def test_placements_are_small_expressions(spark):
    key = "cast(id AS string)"
    both = spark.range(100).filter((S.place(key, S.tree(24)) == 3) | (S.place(key, S.tree(25)) == 24)).select("id", S.place(key, S.tree(40)))
    code = both._jdf.queryExecution().debug().toString()
    assert "Code grows beyond" not in code
    assert both.count() == len([k for k in range(100) if slow_place(k, S.tree(24)) == 3 or slow_place(k, S.tree(25)) == 24])


def test_weights(spark):
    root = S.tree(4, region_size=2, rack_size=1, weights={0: 3.0, 3: 0.0})
    got = Counter(placed(spark, root).values())
    assert 3 not in got and abs(got[0] / 3000 - 0.6) < 0.04 and abs(got[1] / 3000 - 0.2) < 0.03


def test_movement_stays_in_the_subtree_that_changed(spark):
    """A shard that gains weight takes documents of its own rack and region in proportion, and what moves elsewhere moves towards it."""
    old_root, new_root = S.tree(16, region_size=8, rack_size=4), S.tree(16, region_size=8, rack_size=4, weights={0: 2.0})
    old, new = placed(spark, old_root), placed(spark, new_root)
    region, rack = (lambda s: s // 8), (lambda s: s // 4)
    for k in old:
        if old[k] != new[k]:
            assert region(new[k]) == 0
            if region(old[k]) == 0:
                assert rack(new[k]) == 0
                if rack(old[k]) == 0:
                    assert new[k] == 0


def test_no_weight_is_an_error(spark):
    with pytest.raises(ValueError):
        S.place("'a'", S.tree(2, weights={0: 0, 1: 0}))


def test_empty_table(no_rows):
    assert S.shard_documents(no_rows, S.tree(24)).collect() == []
