import random
import zlib
from collections import defaultdict
from io import BytesIO

import numpy as np
import pyarrow as pa
import pytest

from deskdb.llm import packing as P, sstable as S, tokens as T
from deskdb.llm.common import documents, scratch_path

ATOMS = [" ", "  ", "\n", "a", "b1", "'s", "'ll", ".", ",", "\t", " ", "　", "é", "日本", "<|endoftext|>", "x", "  \n", " \n", "\x1c", "\x85", "😀", "don't", "123", "\x00", "Ġ"]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(T.public_path())
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def strange(n=1500, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ATOMS) for _ in range(rng.randint(0, 25))) for _ in range(n)] + ["", " ", "  ", None]


@pytest.mark.parametrize("step,memo", [(2_000_000, 700_000), (60, 50)])
def test_same_ids_as_the_library(plain, monkeypatch, step, memo):
    monkeypatch.setattr(T, "STEP_CHARS", step)
    monkeypatch.setattr(T, "MEMO_WORDS", memo)
    texts = strange()
    texts.append(" ".join(x for x in texts if x))
    got = list(T.encoded(texts, T.public_path()))
    assert [k for k, _ in got] == list(range(len(texts)))
    for (k, ids), t in zip(got, texts):
        assert ids.tolist() == plain(t), repr(t)


@pytest.mark.parametrize("step,memo", [(4_000_000, 700_000), (90, 8)])
def test_marks_behind_words(plain, monkeypatch, step, memo):
    monkeypatch.setattr(T, "STEP_CHARS", step)
    monkeypatch.setattr(T, "MEMO_WORDS", memo)
    rng = random.Random(3)
    words = ["word", "été", "Ärger", "naïve", "×", "ſ", "b1", "don't", "日本", "I'll", "", "the", "x\u00a0", "\u3000y", "<|endoftext|>", "ŒUVRE", "e\u0301"]
    texts = [" ".join(rng.choice(words) + rng.choice(["", "", ".", ",", "?", "!", ";", ":", "..", ".'s", "'s.", ")", ".\n", "\u2028"]) for _ in range(rng.randint(0, 30))) for _ in range(600)]
    for (k, ids), t in zip(T.encoded(texts, T.public_path()), texts, strict=True):
        assert ids.tolist() == plain(t), repr(t)


def test_a_word_with_and_without_marks_is_learned_once(plain):
    encoder = T.WordEncoder(T.public_path())
    ids, counts = encoder.encode(["a word word. word, word! word?", "Été word; word:"])
    assert ids.tolist() == plain("a word word. word, word! word?") + plain("Été word; word:") and counts.sum() == len(ids)
    assert list(encoder.memo) == ["a", "word", "Été"]


def test_packing_meets_each_word_once_with_any_mark(plain, monkeypatch):
    asked = []
    monkeypatch.setattr(T.WordEncoder, "_learn", lambda self, words, of=T.WordEncoder._learn: asked.extend(words) or of(self, words))
    monkeypatch.setattr(T.WordEncoder, "_made", {})
    rng = random.Random(5)
    texts = [" ".join(f"wort{'abcdefghij'[rng.randrange(10)]}" + rng.choice(["", ".", ",", "!"]) for _ in range(40)) for _ in range(50)]
    assert [x.tolist() for _, x in T.encoded(pa.array(texts), T.public_path())] == [plain(t) for t in texts]
    assert sorted(asked) == [f"wort{c}" for c in "abcdefghij"]


def test_odd_words_are_those_with_white_space_at_an_end():
    words = ["", "a", " a", "a\n", "\u00a0a", "a\u3000", "\x1ca", "a\x85", "é", "éa", "aé", "日本", "a b", "\x00", "\x7f", "\u200b"]
    odd = [not w or w[0].isspace() or w[-1].isspace() for w in words]
    assert T.odd_words(pa.array(words, pa.large_string())).tolist() == odd
    assert T.odd_words(pa.array(words, pa.large_string()).slice(2, 9)).tolist() == odd[2:11]
    assert T.odd_words(pa.array(["", ""], pa.large_string())).tolist() == [True, True]
    assert T.odd_words(pa.array([], pa.large_string())).tolist() == []


class Held(BytesIO):
    def size(self):
        return len(self.getvalue())


def test_shard_file(monkeypatch):
    monkeypatch.setattr(S, "BLOCK_BYTES", 200)
    rng = np.random.default_rng(1)
    keys = sorted([None, None, -5, -(2**63), 2**63 - 1, 7, 7, 7, *range(100, 400)], key=S.key_of)
    docs = [(k, rng.integers(0, 50_000, rng.integers(1, 40)).astype(np.uint32)) for k in keys]
    out = Held()
    w = S.SstWriter(out, 2, 2)
    for k, ids in docs:
        w.add(S.key_of(k), ids)
    assert w.close() == {"docs": len(docs), "tokens": sum(len(x) for _, x in docs)}
    r = S.SstReader(out)
    assert [(k, x.tolist()) for k, x in r.scan()] == [(k, x.tolist()) for k, x in docs] and len(r.blocks) > 20
    by = defaultdict(list)
    for k, x in docs:
        by[k].append(x.tolist())
    assert all(sorted(x.tolist() for x in r.get(k)) == sorted(by[k]) for k in by)
    assert all(r.get(k) == [] for k in (0, 99, 401, -1)) and sum(r.may_hold(k) for k in range(10_000, 12_000)) < 80
    with pytest.raises(ValueError):
        w.add(S.key_of(3), docs[0][1])
    for at in (5, len(out.getvalue()) - S.FOOTER.size - 3, len(out.getvalue()) - 2):
        bad = bytearray(out.getvalue())
        bad[at] ^= 1
        with pytest.raises(ValueError):
            list(S.SstReader(Held(bytes(bad))).scan())


def test_wide_ids():
    out = Held()
    w = S.SstWriter(out, 2, 4)
    w.add(S.key_of(1), np.array([70_000, 2], np.uint32))
    w.close()
    assert S.SstReader(out).get(1)[0].tolist() == [70_000, 2]


def whole(rows, end, plain):
    return [(i, [*plain(t), end]) for i, t in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_shards_of_awkward_rows(spark, awkward, plain):
    rows, docs = awkward
    folder = scratch_path(spark, "sst-test")
    made = S.write_shards(docs, folder, T.public_path(), 2)
    got = S.read_shards(spark, folder, made).collect()
    want = whole([(r[0], r[1]) for r in rows], 2, plain)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((str(i), len(x), crc(x)) for i, x in want)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    # a lookup in the shards by binary search
    from pyarrow import fs

    store, _ = fs.FileSystem.from_uri(folder)
    found = [x.tolist() for m in made for x in S.SstReader(store.open_input_file(m["path"])).get(8)]
    assert found == [[*plain(rows[8][1]), 2]]


def test_shards_of_nothing(spark, no_rows):
    folder = scratch_path(spark, "sst-none")
    assert S.read_shards(spark, folder, S.write_shards(no_rows, folder, T.public_path(), 2)).collect() == []


def test_query_on_real_documents(spark, plain):
    rows = {r["doc_id"]: r["text"] for r in documents(spark, "/root/testdata/sf0.001").collect()}
    at = 0
    for r in S.op7_sstable(spark, "/root/testdata/sf0.001").orderBy("doc_id").collect():
        ids = [*plain(rows[r["doc_id"]]), 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)


# -- packing


def check_pieces(got, want, window=2048):
    """Each id of each document in one piece; offsets gapless; no sequence above the window."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[str(r["doc_id"]), r["doc_tokens"]].append((r["start"], r["length"], r["ids_crc32"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= window
    assert sorted(sequences) == list(range(len(sequences)))
    expected = defaultdict(list)
    for i, ids in want:
        expected[str(i), len(ids)] += [(lo, len(ids[lo : lo + window]), crc(ids[lo : lo + window])) for lo in range(0, len(ids), window)]
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in expected.items()}
    return len(sequences)


def test_packing_awkward_rows(awkward, plain):
    rows, docs = awkward
    check_pieces(P.pack_documents(docs).collect(), whole([(r[0], r[1]) for r in rows], 1, plain))


def test_packing_real_documents(spark, plain):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, "/root/testdata/sf0.001").collect()]
    want = whole(rows, 1, plain)
    got = P.op10_packing(spark, "/root/testdata/sf0.001").collect()
    n = check_pieces(got, want)
    assert sum(len(x) for _, x in want) / (n * 2048) > 0.95


def test_packing_nothing(no_rows):
    assert P.pack_documents(no_rows).collect() == []


def test_sequences_hold_their_ids(spark, awkward, plain):
    from deskdb.llm.common import saved

    rows, docs = awkward
    pieces = saved(P.cut_pieces(docs, T.public_path(), 1), "pieces-test")
    packed = P.pack(pieces)
    got = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in P.sequences(packed, pieces).collect()}
    ids = {r["piece"]: np.frombuffer(r["ids"], "<u2").tolist() for r in pieces.collect()}
    for r in packed.collect():
        assert got[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == ids[r["piece"]]
    assert sum(map(len, got.values())) == sum(map(len, ids.values()))


@pytest.mark.parametrize("seed,kind", [(1, "mixed"), (2, "short"), (3, "long"), (4, "one")])
def test_plan_places_every_piece_once(seed, kind):
    rng = np.random.default_rng(seed)
    draw = {"mixed": lambda: rng.integers(1, 2048), "short": lambda: rng.integers(1, 60), "long": lambda: rng.integers(1500, 2048), "one": lambda: 700}[kind]
    lengths = np.array([draw() for _ in range(5000)])
    u, c = np.unique(lengths, return_counts=True)
    plan = P.Plan(dict(zip(u.tolist(), c.tolist())))
    numbers = np.concatenate([np.arange(k) for k in c])
    lengths = np.repeat(u, c)
    order = rng.permutation(len(lengths))
    s, place = P.place_pieces(lengths[order], numbers[order], plan.tables(), 2048, plan.unit, plan.sequences)
    assert (s >= 0).all() and len(set(zip(s.tolist(), place.tolist()))) == len(s) and sorted(set(s.tolist())) == list(range(plan.sequences))
    sums = np.bincount(s, weights=lengths[order])
    assert sums.max() <= 2048
    if kind in ("mixed", "short"):
        assert lengths.sum() / (plan.sequences * 2048) > 0.97


def test_least_squares_against_brute_force():
    rng = np.random.default_rng(3)
    from itertools import combinations

    for _ in range(30):
        a, b = rng.random((4, 6)), rng.random(4)
        best = min(
            (float(np.sum((a[:, s] @ x - b) ** 2)) for n in range(5) for s in map(list, combinations(range(6), n)) for x in [np.linalg.lstsq(a[:, s], b, rcond=None)[0] if s else np.zeros(0)] if (x >= -1e-12).all()),
        )
        x = P.nnls(a, b)
        assert (x >= 0).all() and float(np.sum((a @ x - b) ** 2)) <= best + 1e-9


def test_combinations():
    assert P.combinations(4, 3) == [(4,), (3, 1), (2, 2), (2, 1, 1)] and len(P.combinations(128, 3)) == 1430


def test_width_follows_the_vocabulary(spark, monkeypatch, tmp_path):
    import json

    path = tmp_path / "many.json"
    path.write_text(json.dumps({"version": "1.0", "added_tokens": [], "model": {"type": "WordLevel", "vocab": {f"w{k}": k for k in range(70_001)}, "unk_token": "w0"}}))
    assert S.id_bytes(T.public_path(), 2) == 2 and S.id_bytes(T.public_path(), 1 << 16) == 4 and S.id_bytes(str(path), 2) == 4
    writer = S.SstWriter(pa.BufferOutputStream(), 2, 2)
    with pytest.raises(ValueError):
        writer.add(S.key_of(1), np.array([70_000, 2], np.uint32))
    docs = spark.createDataFrame([(2**53 + 1, "some words"), (2**53 + 2, None), (None, "x")], "doc_id long, text string")
    folder = scratch_path(spark, "sst-wide")
    made = S.write_shards(docs, folder, T.public_path(), 70_000)
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in S.read_shards(spark, folder, made).collect())[-1] == (2**53 + 2, 1)


def test_packed_ids_make_the_windows(spark, awkward, plain):
    rows, docs = awkward
    windows = defaultdict(list)
    for r in P.pack_documents(docs, with_ids=True).collect():
        ids = np.frombuffer(bytes(r["ids"]), "<u2")  # 50,000 words take two bytes
        assert crc(ids) == r["ids_crc32"] and len(ids) == r["length"]
        windows[r["sequence_id"]].append((r["offset"], ids.tolist()))
    made = [[x for _, part in sorted(w) for x in part] for w in windows.values()]
    assert all(len(w) <= 2048 and all(at == sum(len(p) for _, p in sorted(parts)[:k]) for k, (at, _) in enumerate(sorted(parts))) for w, parts in zip(made, windows.values()))
    assert sorted(x for w in made for x in w) == sorted(x for r in rows for x in [*plain(r[1]), 1])
