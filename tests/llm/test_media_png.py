import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from deskdb.llm import media_png as M


def slow_unfilter(kinds, rows):
    """The five filters, byte by byte."""
    out = []
    for kind, row in zip(kinds.tolist(), rows.tolist()):
        up, line = out[-1] if out else [0] * len(row), []
        for x, v in enumerate(row):
            a, b, c = (line[x - 1] if x else 0), up[x], (up[x - 1] if x else 0)
            p = a + b - c
            paeth = min((a, b, c), key=lambda q: abs(p - q))
            line.append((v + [0, a, b, (a + b) // 2, paeth][kind]) & 255)
        out.append(line)
    return np.array(out, np.uint8)


@given(st.lists(st.integers(1, 12), min_size=1, max_size=5), st.integers(1, 9), st.integers(0, 4), st.randoms(use_true_random=False))
@settings(max_examples=120, deadline=None)
def test_unfiltering(heights, width, least, rng):
    images = [(np.array([rng.randrange(least, 5) for _ in range(h)], np.uint8), np.array([[rng.randrange(256) for _ in range(width)] for _ in range(h)], np.uint8)) for h in heights]
    first = np.concatenate([[True] + [False] * (h - 1) for h in heights])
    got = M.unfilter(np.concatenate([k for k, _ in images]), np.concatenate([r for _, r in images]), first)
    assert (got == np.concatenate([slow_unfilter(k, r) for k, r in images])).all()


def test_images_of_several_widths_are_decoded_together():
    rng = np.random.default_rng(3)
    data = [rng.integers(0, 256, 576 * n, dtype=np.uint8).tobytes() for n in (1, 5, 2, 9)]
    got = M.decode_pngs([M.encode_png(d, w, f) for d, w, f in zip(data, (64, 32, 64, 576), (4, 3, None, 2))])
    assert [g.tobytes() for g in got] == data and M.decode_pngs([]) == []


def test_rows_get_the_filter_of_the_least_bits(monkeypatch):
    image = np.concatenate([np.frombuffer(b"some plain words of a text " * 64, np.uint8)[: 64 * 20].reshape(20, 64), np.tile(np.arange(64, dtype=np.uint8) * 3, (20, 1)), np.full((5, 64), 255, np.uint8)])
    tried = np.stack([M.filter_rows(image, k) for k in range(5)])
    cost = np.array([[sum(-np.log2((np.sum(f == v) + 1) / (image.size + 256)) for v in row) for row in f] for f in tried])
    blob = M.encode_png(image.tobytes())
    kinds = M.filtered_rows(blob)[:, 0]
    assert len(set(kinds.tolist())) > 2 and np.allclose(cost[kinds, np.arange(45)], cost.min(0), rtol=1e-5)
    monkeypatch.setattr(M, "STRIP_ROWS", 7)
    assert M.encode_png(image.tobytes()) == blob


@pytest.mark.parametrize("row_filter", [0, 1, 2, 3, 4, None])
def test_round_trip(row_filter):
    rng = np.random.default_rng(1)
    for data in (M.payload_of("ünï " * 400), M.payload_of(""), rng.integers(0, 256, 576 * 7, dtype=np.uint8).tobytes()):
        assert M.decode_png(M.encode_png(data, row_filter=row_filter)).tobytes() == data


def test_other_readers_agree(monkeypatch):
    """The chunks by another reading of the format: lengths, checksums, zlib."""
    monkeypatch.setattr(M, "CHUNK_BYTES", 50)
    data = M.payload_of("some text " * 100)
    blob, at, kinds, idat = M.encode_png(data, row_filter=0), 8, [], b""
    while at < len(blob):
        n, kind = struct.unpack_from(">I4s", blob, at)
        assert zlib.crc32(blob[at + 4 : at + 8 + n]) == struct.unpack_from(">I", blob, at + 8 + n)[0]
        kinds.append(kind)
        idat += blob[at + 8 : at + 8 + n] * (kind == b"IDAT")
        at += 12 + n
    assert kinds[0] == b"IHDR" and kinds[-1] == b"IEND" and kinds.count(b"IDAT") > 1
    rows = np.frombuffer(zlib.decompress(idat), np.uint8).reshape(-1, 65)
    assert rows[:, 1:].tobytes() == data and (rows[:, 0] == 0).all()


@given(st.integers(0, 10**6), st.integers(1, 255))
@settings(max_examples=200, deadline=None)
def test_damage_is_found(at, flip):
    data = M.payload_of("text to damage " * 60)
    blob = bytearray(M.encode_png(data))
    blob[at % len(blob)] ^= flip
    with pytest.raises(ValueError):
        M.decode_png(bytes(blob))


def test_cut_files_are_found():
    blob = M.encode_png(M.payload_of("abc"))
    for n in range(0, len(blob), 7):
        with pytest.raises(ValueError):
            M.decode_png(blob[:n])


def test_payloads():
    assert M.payload_of(None) == b"\xff" * 576 == M.payload_of("") and len(M.payload_of("a" * 576)) == 576 and len(M.payload_of("a" * 577)) == 1152 and M.payload_of("é")[:3] == b"\xc3\xa9\xff"


def test_low_frequencies_equal_the_definition(monkeypatch):
    rng = np.random.default_rng(2)
    image = rng.integers(0, 256, (45, 64)).astype(np.uint8)
    y, x = np.arange(45), np.arange(64)
    want = [[(image * np.outer(np.cos(np.pi * u * (2 * y + 1) / 90), np.cos(np.pi * v * (2 * x + 1) / 128))).sum() / 45 / 64 for v in range(8)] for u in range(8)]
    assert np.allclose(M.low_frequencies(image), want)
    whole = M.low_frequencies(image)
    monkeypatch.setattr(M, "STRIP_ROWS", 10)
    assert np.allclose(M.low_frequencies(image), whole)


def test_awkward_rows(awkward, no_rows):
    from deskdb.llm.common import saved

    rows, docs = awkward
    got = M.features(saved(M.to_media(docs), "media-test")).collect()
    want = sorted(((str(i), len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])) for i, t, *_ in rows for p in [M.payload_of(t)]))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["payload_sha256"], set()).add((r["media_bytes"], r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in by.values())
    assert M.features(M.to_media(no_rows)).collect() == []


def test_stored_images_use_several_filters(spark):
    from deskdb.llm.common import documents

    blobs = [bytes(r["media"]) for r in M.to_media(documents(spark, "/root/testdata/sf0.001")).collect()]
    used = [set(M.filtered_rows(b)[:, 0].tolist()) for b in blobs]
    assert set.union(*used) >= {0, 1, 2, 4} and sum(len(u) > 1 for u in used) > len(used) / 2


def test_hash_is_near_for_near_texts():
    text = "The quick brown fox jumps over the lazy dog and runs away. " * 40
    a, b, c = (int(M.cosine_hash(M.decode_png(M.encode_png(M.payload_of(t)))), 16) for t in (text, text.replace("lazy", "mazy", 1), "".join(reversed(text)).upper()))
    assert bin(a ^ b).count("1") <= 6 < bin(a ^ c).count("1")
