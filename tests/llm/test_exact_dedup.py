import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from deskdb.llm import exact_dedup as E


def slow(rows, past=None):
    """(doc_id, keep_id, group_size, sha) for each row, sorted; and how many rows stay."""
    key = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest()
    groups = {}
    for i, t in past if past is not None else rows:
        groups.setdefault(key(t), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t in rows:
        g = groups.get(key(t))
        if g:
            out.append((i, min(g)[3], len(g), key(t)))
    return sorted(out, key=str), len(groups)


@given(st.lists(st.binary(min_size=32, max_size=32), max_size=300, unique=True), st.lists(st.binary(min_size=32, max_size=32), max_size=50))
@settings(max_examples=60, deadline=None)
def test_hash_is_minimal_and_perfect(members, others):
    slots = np.zeros(len(members), E.SLOT)
    if members:
        slots["digest"] = np.frombuffer(b"".join(members), "V32")
    slots["rid"] = np.arange(len(members))
    index = E.Mph(E.build_mph(slots))
    if members:
        found = index.find(np.frombuffer(b"".join(members), "V32"))
        assert sorted(found) == list(range(len(members))) and (index.slots["rid"][found] == np.arange(len(members))).all()
    strange = [x for x in others if x not in set(members)]
    if strange:
        assert (index.find(np.frombuffer(b"".join(strange), "V32")) == -1).all()


def test_words_that_collide_are_found_by_comparison():
    members = [b"\1" * 16 + bytes([k]) * 16 for k in range(5)] + [bytes([k]) * 32 for k in range(9, 60)]
    slots = np.zeros(len(members), E.SLOT)
    slots["digest"] = np.frombuffer(b"".join(members), "V32")
    index = E.Mph(E.build_mph(slots))
    assert int(index.rest) >= 4 and sorted(index.find(slots["digest"])) == list(range(len(members)))
    assert index.find(np.frombuffer(b"\1" * 16 + b"\xee" * 16, "V32"))[0] == -1


def test_awkward_rows(awkward):
    rows, docs = awkward
    got = E.exact_dedup(docs).collect()
    want, groups = slow([(r[0], r[1]) for r in rows])
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == want
    assert sum(r["kept"] for r in got) == groups and all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_hot_text_is_split(spark, monkeypatch):
    rows = [(k, f"text {k}") for k in range(300)] + [(1000 + k, "hot  text" if k % 2 else "hot text") for k in range(300)]
    got = E.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    want, groups = slow(rows)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == want and sum(r["kept"] for r in got) == groups


def test_history(spark):
    past = [(1, "a b"), (2, "a  b"), (3, "c"), (None, None)]
    rows = [(10, "ab"), (11, "new"), (12, "n e w"), (13, "c"), (14, None), (15, "solo")]
    frame = lambda x: spark.createDataFrame(x, "doc_id long, text string")
    got = {r["doc_id"]: r for r in E.exact_dedup(frame(rows), frame(past)).collect()}
    assert {k: (r["seen_before"], r["keep_id"], r["group_size"], r["kept"]) for k, r in got.items()} == {
        10: (True, 2, 2, False), 11: (False, 12, 2, False), 12: (False, 12, 2, True), 13: (True, 3, 1, False), 14: (True, None, 1, False), 15: (False, 15, 1, True),
    }
    assert {r["doc_id"] for r in E.exact_dedup(frame(rows), frame([])).filter("kept").collect()} == {10, 12, 13, 14, 15}


def test_empty_table(no_rows):
    assert E.exact_dedup(no_rows).collect() == [] and E.without_copies(no_rows).columns == no_rows.columns and E.without_copies(no_rows).count() == 0


@pytest.mark.parametrize("repeat", [1, 2])
def test_rows_that_stay(awkward, repeat):
    rows, docs = awkward
    for _ in range(repeat - 1):
        docs = docs.union(docs)
    left = E.without_copies(docs)
    assert left.schema == docs.schema
    _, groups = slow([(r[0], r[1]) for r in rows])
    want = {(r["doc_id"], r["text_sha256"]) for r in E.exact_dedup(docs).filter("kept").collect()}
    got = [(r["doc_id"], hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "").encode()).hexdigest()) for r in left.collect()]
    assert len(got) == groups and set(got) == want


def test_ids_beyond_floats_beside_null_ids(spark):
    """Ids above 2^53 are kept to the last digit in parts that hold null ids too."""
    big = 2**53 + 1
    rows = [(big + 2 * k, f"text {k % 700}") for k in range(2000)] + [(None, f"null text {k}") for k in range(900)] + [(-(2**63), "low"), (2**63 - 1, "high"), (None, "high")]
    got = E.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == slow(rows)[0]
