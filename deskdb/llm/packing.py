"""Packing token pieces into windows by non-negative least squares over the length histogram.

1. Documents are encoded once; each is cut into full windows and one remainder. Pieces, with their ids, go to a table in the
   shared folder.
2. On the driver, over the histogram alone (one count for each length below the window): lengths are rounded up to bins of
   1/128 of a window; all ways to fill a window with one to three bins are the columns of a matrix; non-negative least squares
   finds how often to repeat each so that the bins' counts are met. Repeats are rounded down and kept within what there is.
3. What remains is packed greedily, again on counts: the longest length that remains, then the longest that still fits, the
   pattern repeated as often as the counts allow. Each step uses up a length, so there are few patterns.
4. Pieces are numbered within their length (distributed, see ``numbered``); a piece's number decides its pattern, copy and
   place. Offsets are running sums within a sequence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from deskdb.llm.common import documents, numbered, saved, spread
from deskdb.llm.tokens import encoded, id_bytes, public_path

WINDOW = 2048
BINS = 128
DEPTH = 3


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, text: str = "text") -> DataFrame:
    """piece, doc_id, start, length, ids, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), doc_tokens: full windows, then the remainder of each document.

    ids are little-endian unsigned integers of 2 bytes where the vocabulary allows it, else 4.
    """
    width = id_bytes(tokenizer, end_id)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, size = batch.column("doc_id").to_pylist(), [], 0
            for k, tokens in encoded(batch.column("text"), tokenizer):
                tokens = np.append(tokens, np.uint32(end_id)).astype("<u4")
                for lo in range(0, len(tokens), window):
                    part = tokens[lo : lo + window]
                    rows.append((ids[k], lo, len(part), part.astype(f"<u{width}").tobytes(), zlib.crc32(part), len(tokens)))
                    size += len(part)
                if size > 1 << 20:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    made = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))).mapInArrow(cut, "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long")
    return made.withColumn("piece", F.monotonically_increasing_id())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens"])


def combinations(total: int, depth: int) -> list[tuple[int, ...]]:
    """All ways to write ``total`` as up to ``depth`` parts, largest first."""
    out: list[tuple[int, ...]] = []

    def extend(parts: tuple[int, ...], left: int) -> None:
        if left == 0:
            out.append(parts)
        elif len(parts) < depth:
            for p in range(min(left, parts[-1] if parts else left), 0, -1):
                extend((*parts, p), left - p)

    extend((), total)
    return out


def nnls(a: np.ndarray, b: np.ndarray, steps: int = 1000) -> np.ndarray:
    """x >= 0 with least |a x - b|: the active-set method of Lawson and Hanson, on the normal equations."""
    x, on = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    gram, rhs = a.T @ a, a.T @ b
    tol = 1e-9 * max(1.0, float(np.abs(rhs).max(initial=0)))

    def solved(at: np.ndarray) -> np.ndarray:
        try:
            return np.linalg.solve(gram[np.ix_(at, at)], rhs[at])
        except np.linalg.LinAlgError:
            return np.linalg.lstsq(a[:, at], b, rcond=None)[0]

    for _ in range(steps):
        now = np.flatnonzero(on)
        w = np.where(on, -np.inf, rhs - gram[:, now] @ x[now])
        j = int(np.argmax(w))
        if w[j] <= tol:
            break
        on[j] = True
        while True:
            at = np.flatnonzero(on)
            s = solved(at)
            if (s > tol * 1e-3).all():
                break
            low = s <= tol * 1e-3
            step = np.min(x[at][low] / np.maximum(x[at][low] - s[low], 1e-300))
            x[at] += step * (s - x[at])
            off = at[low & (x[at] <= tol * 1e-3)] if (low & (x[at] <= tol * 1e-3)).any() else at[low][:1]
            on[off], x[off] = False, 0.0
            if not on.any():
                break
        x[:] = 0
        if on.any():
            x[np.flatnonzero(on)] = s
    return x


class Plan:
    """From a histogram (length -> pieces) to where the n-th piece of each length goes."""

    def __init__(self, counts: dict[int, int], window: int = WINDOW, bins: int = BINS, depth: int = DEPTH) -> None:
        self.window, self.unit = window, max(1, window // bins)
        short = {n: c for n, c in counts.items() if 0 < n < window and c}
        full = window // self.unit
        have = np.zeros(full + 1, np.int64)
        self.first: dict[int, int] = {}  # pieces of the same bin that are shorter
        for n in sorted(short):
            b = -(-n // self.unit)
            self.first[n] = int(have[b])
            have[b] += short[n]
        self.sequences, self.rows = 0, []  # (kind, key, first number, copies, sequence, place)
        used = np.zeros_like(have)
        if short:
            ways = combinations(full, depth)
            a = np.zeros((full, len(ways)))
            for k, way in enumerate(ways):
                for b in way:
                    a[b - 1, k] += 1
            scale = max(1.0, float(have.max()))
            x = nnls(a, have[1:] / scale) * scale
            for k in np.argsort(-x):
                n = min([int(x[k] + 1e-6), *((have[b] - used[b]) // ways[k].count(b) for b in set(ways[k]))])
                if n <= 0:
                    continue
                place = 0
                for b in dict.fromkeys(ways[k]):
                    m = ways[k].count(b)
                    self.rows.append((0, b, int(used[b]), int(n), m, self.sequences, place))
                    used[b] += n * m
                    place += m
                self.sequences += int(n)
        self.planned = used
        rest = np.zeros(window + 1, np.int64)
        for n, c in short.items():
            rest[n] = c - min(c, max(0, int(used[-(-n // self.unit)]) - self.first[n]))
        self._greedy(rest)

    def _greedy(self, rest: np.ndarray) -> None:
        start = np.zeros_like(rest)
        while rest.any():
            room, way, left = self.window, [], rest.copy()
            while True:
                fits = np.flatnonzero(left[: room + 1])
                if not len(fits):
                    break
                n = int(fits[-1])
                m = 1 if not way else min(int(left[n]), room // n)
                way.append((n, m)) if not way or way[-1][0] != n else way.__setitem__(-1, (n, way[-1][1] + m))
                left[n] -= m
                room -= n * m
            copies = min(int(rest[n]) // m for n, m in way)
            place = 0
            for n, m in way:
                self.rows.append((1, n, int(start[n]), copies, m, self.sequences, place))
                start[n] += copies * m
                rest[n] -= copies * m
                place += m
            self.sequences += copies

    def tables(self) -> dict[str, np.ndarray]:
        """Rows sorted by (kind, key, first number), and the per-length numbers; their size follows the window, not the data."""
        rows = np.array(sorted((k * (self.window + 1) + key, first, copies, m, seq, place) for k, key, first, copies, m, seq, place in self.rows), np.int64).reshape(-1, 6)
        first, planned = np.zeros(self.window + 1, np.int64), np.zeros(self.window + 1, np.int64)
        for n, f in self.first.items():
            first[n], planned[n] = f, self.planned[-(-n // self.unit)]
        return {"rows": rows, "first": first, "planned": planned}


def place_pieces(lengths: np.ndarray, numbers: np.ndarray, t: dict, window: int, unit: int, sequences: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, place) of the ``numbers``-th piece of each length. Full windows follow the planned sequences."""
    rows = t["rows"]
    r = t["first"][lengths] + numbers
    planned = t["planned"][lengths]
    in_plan = r < planned
    key = np.where(in_plan, -(-lengths // unit), window + 1 + lengths)
    n = np.where(in_plan, r, r - np.maximum(planned, t["first"][lengths]))
    sequence, place = np.full(len(lengths), -1, np.int64), np.zeros(len(lengths), np.int64)
    whole = lengths == window
    sequence[whole] = sequences + numbers[whole]
    if len(rows) and not whole.all():
        order = np.lexsort((n, key))
        span = int(max(rows[:, 1].max(), n.max())) + 1
        whole_numbers = object if span > 1 << 40 else np.int64  # beyond it the product could pass 64 bits
        known, asked = (a.astype(whole_numbers) * span + b for a, b in ((rows[:, 0], rows[:, 1]), (key[order], n[order])))
        k = np.searchsorted(known, asked, side="right") - 1
        hit = np.maximum(k, 0)
        d = n[order] - rows[hit, 1]
        seq = np.where(whole[order], sequence[order], rows[hit, 4] + d % rows[hit, 2])
        sequence[order], place[order] = seq, np.where(whole[order], 0, rows[hit, 5] + d // rows[hit, 2])
    return sequence, place


def pack(pieces: DataFrame, window: int = WINDOW, bins: int = BINS, depth: int = DEPTH) -> DataFrame:
    """Adds sequence_id and offset to the pieces (a saved table), without their ids but with ids_crc32.

    Of equal lengths, doc_id (nulls first), start and row decide. Sequence numbers are gapless. An empty table gives an empty result.
    Documents without text are one piece of the end id. A very long document is many full windows, each a sequence of its own.
    """
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # one row for each length up to the window
    plan = Plan(counts, window, bins, depth)
    tables, unit, sequences = plan.tables(), plan.unit, plan.sequences

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sequence, place = place_pieces(b.column("length").to_numpy(), b.column("number").to_numpy(), tables, window, unit, sequences)
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(sequence), pa.array(place)], [*names, "sequence_id", "place"])

    names = ["piece", "doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    slim = pieces.select("piece", "doc_id", "start", "length", "ids_crc32", "doc_tokens")
    rows = numbered(slim, "length", ["doc_id", "start", "piece"], "number").select(*names, "number")
    put_ = rows.mapInArrow(put, "piece long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, place long")
    before = W.partitionBy("sequence_id").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    return put_.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0).cast("long"))).drop("place")


def sequences(packed: DataFrame, pieces: DataFrame) -> DataFrame:
    """sequence_id, ids: the packed windows themselves (little-endian unsigned 32-bit ids, unpadded). A group is one window at most."""
    both = packed.select("piece", "sequence_id", "offset", "length").join(pieces.select("piece", "ids"), "piece")
    put = both.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("n"))

    @F.arrow_udf("binary")
    def wide(ids: pa.Array, n: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(x, f"<u{len(x) // k}").astype("<u4").tobytes() for x, k in zip(ids.to_pylist(), n.to_pylist())], pa.binary())

    return put.select("sequence_id", wide(F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])), F.col("n")).alias("ids"))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece of ``docs``; ``with_ids``: and ids, as cut_pieces gives them."""
    pieces = saved(cut_pieces(docs, tokenizer or public_path(), end_id), "pieces")
    packed = pack(pieces).select("piece", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    if with_ids:
        packed = pieces.select("piece", "ids").join(packed.hint("shuffle_hash"), "piece")
    return packed.drop("piece")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))


QUERIES = {"op10_packing": op10_packing}
ORACLE: dict = {}
