"""Ids beyond what a float holds, beside null ids, through every operator."""

import random

import pytest

from deskdb.llm import media_png, mixing, packing, shard_tree, simhash, substring_dedup
from deskdb.llm.common import saved

IDS = [2**53 + 1, 2**53 + 2, 2**53 + 3, 2**63 - 1, -(2**63), None, None, 7]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    same = " ".join(word() for _ in range(80))
    texts = [same, same, " ".join(word() for _ in range(90)), "", same, None, "short", " ".join(word() for _ in range(60))]
    return spark.createDataFrame([(i, t, "s1" if k % 2 else None) for k, (i, t) in enumerate(zip(IDS, texts))], "doc_id long, text string, source string")


def ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=str)


def test_each_row_keeps_its_id(docs):
    want = sorted(IDS, key=str)
    assert ids(shard_tree.shard_documents(docs, shard_tree.tree(24))) == want
    assert ids(mixing.mix(docs)) == want
    assert ids(media_png.features(saved(media_png.to_media(docs), "ids-media"))) == want
    assert ids(packing.pack_documents(docs)) == want
    got = {(r["doc_id"], r["component_id"]) for r in simhash.simhash_components(docs).collect()}
    low = -(2**63)
    assert {(2**53 + 1, low), (2**53 + 2, low), (low, low), (2**53 + 3, 2**53 + 3), (7, 7)} <= got and {c for i, c in got if i in (None, 2**63 - 1)} <= {2**63 - 1, None}


def test_passages_and_similar_rows_name_whole_ids(docs):
    got = substring_dedup.passages(docs).collect()
    assert {frozenset((r["doc_id"], r["other_id"])) for r in got} <= {frozenset(p) for p in ((2**53 + 1, 2**53 + 2), (2**53 + 1, -(2**63)), (2**53 + 2, -(2**63)))} and len(got) == 2
    kept = ids(simhash.one_of_similar(docs))
    assert kept == sorted([-(2**63), 2**53 + 3, 2**63 - 1, None, 7], key=str)
