"""Media columns: texts as greyscale PNG images in a binary column, and cosine-transform hashes of the images.

A payload (the text's UTF-8 bytes, then bytes 255 up to a positive multiple of 576) becomes the rows of an 8-bit greyscale
image 64 samples wide. The encoder gives each row the one of the five filters under which its bytes are least surprising, by the
image's byte counts under that filter; it compresses the rows with zlib and cuts the stream into IDAT chunks. The decoder checks the
signature, every chunk's CRC-32 and zlib's own checksum, and undoes the filters of many images at once with numpy: rows
that hang on the row above go in a wave front, one sample further to the left for each row further down.
The hash holds the signs of the image's lowest 8 x 8 cosine-transform coefficients against their median.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from deskdb.llm.common import documents, saved, spread

UNIT, WIDTH = 576, 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHUNK_BYTES = 1 << 20
LOW = 8
#: Rows of the image that are transformed at a time.
STRIP_ROWS = 1 << 14


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b"\xff" * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    a, b, c = (x.astype(np.int16) for x in (a, b, c))
    pa_, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
    return np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c)).astype(np.uint8)


def filter_rows(image: np.ndarray, kind: int) -> np.ndarray:
    """All rows filtered by one of the five filters, their differences modulo 256."""
    left, up = np.zeros_like(image), np.zeros_like(image)
    left[:, 1:], up[1:] = image[:, :-1], image[:-1]
    corner = np.zeros_like(image)
    corner[1:, 1:] = image[:-1, :-1]
    if kind == 3:
        less = ((left.astype(np.uint16) + up) >> 1).astype(np.uint8)
    else:
        less = (np.zeros_like(image), left, up, None, None)[kind] if kind < 3 else _paeth(left, up, corner)
    return image - less


def encode_png(samples: bytes, width: int = WIDTH, row_filter: int | None = None, level: int = 6) -> bytes:
    """A greyscale PNG of ``samples``. ``row_filter`` 0 to 4 for all rows, or None: for each row the one with the least bits by the byte counts. Ties go to the lower filter."""
    image = np.frombuffer(samples, np.uint8).reshape(-1, width)
    kinds = list(range(5)) if row_filter is None else [row_filter]
    parts = [(lo, min(lo + STRIP_ROWS, len(image))) for lo in range(0, len(image), STRIP_ROWS)]

    def tried(lo: int, hi: int) -> np.ndarray:
        return np.stack([filter_rows(image[max(0, lo - 1) : hi], k) for k in kinds])[:, min(lo, 1) :]

    made = tried(*parts[0]) if len(parts) == 1 else None  # a long image is filtered twice, a strip at a time
    bits = None
    if len(kinds) > 1:
        counts = sum(np.stack([np.bincount(f.ravel(), minlength=256) for f in (tried(*p) if made is None else made)]) for p in parts)
        bits = -np.log2((counts + 1) / (image.size + 256)).astype(np.float32)
    packer, data = zlib.compressobj(level), []
    for lo, hi in parts:
        some = tried(lo, hi) if made is None else made
        best = np.stack([b[f].sum(1) for b, f in zip(bits, some)]).argmin(0) if bits is not None else np.zeros(hi - lo, int)
        rows = np.empty((hi - lo, width + 1), np.uint8)
        rows[:, 0] = np.array(kinds, np.uint8)[best]
        rows[:, 1:] = some[best, np.arange(hi - lo)]
        data.append(packer.compress(rows.tobytes()))
    stream = b"".join([*data, packer.flush()])
    head = struct.pack(">IIBBBBB", width, len(image), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + b"".join(_chunk(b"IDAT", stream[k : k + CHUNK_BYTES]) for k in range(0, len(stream), CHUNK_BYTES)) + _chunk(b"IEND", b"")


def filtered_rows(blob: bytes) -> np.ndarray:
    """The rows of an 8-bit greyscale PNG, each its filter and the filtered samples; raises ValueError where a signature, checksum or length is wrong."""
    if blob[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, parts, head, ended = 8, [], None, False
    while at < len(blob) and not ended:
        if len(blob) - at < 12:
            raise ValueError("chunk cut short")
        (n,) = struct.unpack_from(">I", blob, at)
        kind, data = blob[at + 4 : at + 8], blob[at + 8 : at + 8 + n]
        if at + 12 + n > len(blob) or struct.unpack_from(">I", blob, at + 8 + n)[0] != zlib.crc32(kind + data):
            raise ValueError(f"checksum of {kind!r} is wrong")
        if kind == b"IHDR":
            if n != 13:
                raise ValueError("wrong header")
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            parts.append(data)
        ended = kind == b"IEND"
        at += 12 + n
    if not ended or head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit greyscale image that is whole")
    try:
        raw = zlib.decompress(b"".join(parts))
    except zlib.error as e:
        raise ValueError(f"data damaged: {e}") from e
    width, height = head[:2]
    if len(raw) != height * (width + 1):
        raise ValueError("wrong number of samples")
    return np.frombuffer(raw, np.uint8).reshape(height, width + 1)


def decode_pngs(blobs: list[bytes]) -> list[np.ndarray]:
    """The samples of each PNG; raises ValueError where one is damaged. Images of one width are unfiltered together."""
    made = [filtered_rows(b) for b in blobs]
    out: list = [None] * len(made)
    for width in {m.shape[1] for m in made}:
        own = [k for k, m in enumerate(made) if m.shape[1] == width]
        heights = np.array([len(made[k]) for k in own])
        rows = np.concatenate([made[k] for k in own])
        first = np.zeros(len(rows) + 1, bool)
        first[np.cumsum(heights) - heights] = True
        plain = unfilter(rows[:, 0], rows[:, 1:], first[:-1])
        for k, part in zip(own, np.split(plain, np.cumsum(heights)[:-1])):
            out[k] = part
    return out


def decode_png(blob: bytes) -> np.ndarray:
    return decode_pngs([blob])[0]


def unfilter(kinds: np.ndarray, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Undoes the row filters of images that stand one below the other, each beginning where ``first`` is true.

    Rows under filter 0 stay, those under filter 1 are cumulative sums modulo 256. Rows under the filters 2 to 4 need the row above: runs of them are
    decoded together, in step s the sample s - d of every row that is the d-th of its run, so that what it needs is there.
    """
    if kinds.size and kinds.max() > 4:
        raise ValueError("unknown row filter")
    width = rows.shape[1]
    out = np.zeros((len(rows) + 1, width), np.uint8)  # the last row stands above each image
    out[:-1] = rows
    sums = np.flatnonzero(kinds == 1)
    out[sums] = np.cumsum(rows[sums], 1, dtype=np.uint8)
    hung = np.flatnonzero(kinds >= 2)
    if not len(hung):
        return out[:-1]
    fresh = first[hung] | np.concatenate([[True], hung[1:] != hung[:-1] + 1])
    start = np.flatnonzero(fresh)
    depth = np.arange(len(hung)) - np.repeat(start, np.diff(start, append=len(hung)))
    order = np.argsort(depth, kind="stable")
    at, depth = hung[order], depth[order]
    above, kind, deepest = np.where(first[at], len(rows), at - 1), kinds[at], int(depth[-1])
    cuts = np.searchsorted(depth, np.arange(deepest + 2))
    left, corner = np.zeros(len(at), np.int16), np.zeros(len(at), np.int16)
    for step in range(deepest + width):
        some = slice(cuts[max(0, step - width + 1)], cuts[min(deepest, step) + 1])
        x, a, c, k = step - depth[some], left[some], corner[some], kind[some]
        b = out[above[some], x].astype(np.int16)
        da, db, dc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
        guess = np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))
        guess = np.where(k == 2, b, np.where(k == 3, (a + b) >> 1, guess))
        value = (out[at[some], x] + guess) & 255
        out[at[some], x] = value
        left[some], corner[some] = value, b
    return out[:-1]


@lru_cache(maxsize=128)
def _cosines(n: int) -> np.ndarray:
    return np.cos(np.pi * np.arange(LOW)[:, None] * (2 * np.arange(n) + 1) / (2 * n)) / n


def low_frequencies(image: np.ndarray) -> np.ndarray:
    """The image's LOW x LOW lowest cosine-transform coefficients (type II, up to scale); strips bound the memory."""
    height, width = image.shape
    across, total = _cosines(width).T, np.zeros((LOW, LOW))
    for lo in range(0, height, STRIP_ROWS):
        strip = image[lo : lo + STRIP_ROWS]
        down = _cosines(height) if height <= STRIP_ROWS else np.cos(np.pi * np.arange(LOW)[:, None] * (2 * np.arange(lo, lo + len(strip)) + 1) / (2 * height)) / height
        total += down @ (strip.astype(np.float64) @ across)
    return total


def cosine_hash(image: np.ndarray) -> str:
    """16 hex digits: which of the 64 coefficients exceed the median of those but the mean's own."""
    c = np.round(low_frequencies(image), 6).ravel()
    return np.packbits(c > np.median(c[1:])).tobytes().hex()


def to_media(docs: DataFrame, width: int = WIDTH, row_filter: int | None = None, level: int = 6, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: a PNG for each row of ``docs``.

    Null texts count as empty (one unit of bytes 255); repeated rows give equal images; null doc_ids stay null. A text of any length is one image; it is held
    whole, and filtered in strips. An empty table gives an empty result. Other columns are ignored.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column("doc_id"), b.column("text")
            for lo in range(0, len(ids), 256):
                some = texts.slice(lo, 256).to_pylist()
                blobs = [encode_png(payload_of(t), width, row_filter, level) for t in some]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, 256), pa.array([len((t or "").encode()) for t in some], pa.int64()), pa.array(blobs, pa.binary())], ["doc_id", "n_bytes", "media"])

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))).mapInArrow(make, "doc_id long, n_bytes long, media binary")


#: Bytes of stored images that are decoded together.
TOGETHER_BYTES = 1 << 19


def features(media: DataFrame) -> DataFrame:
    """Decodes each row's stored image and describes it: digests of the payload and of the stored form, and the cosine hash.

    A damaged image ends the job with a ValueError. Repeated rows give equal rows, an empty table an empty result; other columns are ignored. The longest image is held whole.
    """

    def described(blob: bytes, image: np.ndarray) -> tuple:
        data = image.tobytes()
        return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(blob), hashlib.sha256(blob).hexdigest(), cosine_hash(image)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, held, size = [], [], 0
            for blob in b.column("media"):
                held.append(blob.as_py())
                size += len(held[-1])
                if size >= TOGETHER_BYTES:
                    rows += map(described, held, decode_pngs(held))
                    held, size = [], 0
            rows += map(described, held, decode_pngs(held))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *cols], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op4_media_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(saved(to_media(documents(spark, sf_dir)), "media"))


QUERIES = {"op4_media_png": op4_media_png}
ORACLE: dict = {}
