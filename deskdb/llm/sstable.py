"""Token ids in sorted-string-table shards.

A shard file holds documents in ascending key order:

    data blocks   entries: varint shared, varint own, varint value bytes, own key bytes, value; then CRC-32 of the block
    block index   for each block: its last key, offset and length
    Bloom filter  of the keys, seven probes by double hashing
    footer        offsets and counts, end id, bytes of an id, magic

A key is one byte (0 for a null id, else 1) and the id as 8 big-endian bytes with the sign bit flipped, so byte order is id order, nulls
first. Keys are prefix-compressed against the one before within a block. A value is the document's ids, end id included,
as little-endian integers of 2 bytes where the vocabulary allows it, else 4. Repeated ids are repeated entries.
``get`` asks the Bloom filter, searches the block index by halving and reads one run of blocks.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from deskdb.llm.common import documents, scratch_path, table_bytes, tasks_for
from deskdb.llm.tokens import encoded, id_bytes, public_path

BLOCK_BYTES = 1 << 16
BLOOM_BITS, PROBES = 10, 7
FOOTER = struct.Struct("<QQQQQQIII4s")
MAGIC = b"DSST"


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & (2**64 - 1))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(block: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = block[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(keys: np.ndarray, bits: int) -> np.ndarray:
    """PROBES bit numbers for each key's hash pair."""
    with np.errstate(over="ignore"):
        x = keys * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        y = (x * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)
        y ^= y >> np.uint64(29)
        return (x[:, None] + np.arange(PROBES, dtype=np.uint64) * y[:, None]) % np.uint64(bits)


def _number(key: bytes) -> int:
    return struct.unpack(">Q", key[1:])[0] ^ (0 if key[0] else 0x5555)


class SstWriter:
    """Writes entries in ascending key order to an open binary stream; holds one block, the block index and the keys' hashes."""

    def __init__(self, out, end_id: int, width: int) -> None:
        self.out, self.end_id, self.width = out, end_id, width
        self.block, self.last, self.at, self.index = bytearray(), b"", 0, []
        self.numbers, self.tokens = array("Q"), 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if key < self.last:
            raise ValueError("keys must ascend")
        if len(ids) and int(ids.max()) >> 8 * self.width:
            raise ValueError(f"id {int(ids.max())} doesn't fit {self.width} bytes")
        value = ids.astype(f"<u{self.width}").tobytes()
        shared = 0
        if self.block:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last, self.tokens = key, self.tokens + len(ids)
        self.numbers.append(_number(key))
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = bytes(self.block) + struct.pack("<I", zlib.crc32(self.block))
            self.out.write(data)
            self.index.append((self.last, self.at, len(data)))
            self.at += len(data)
            self.block = bytearray()

    def close(self) -> dict:
        self._flush()
        index = b"".join(k + struct.pack("<QQ", at, n) for k, at, n in self.index)
        bits = max(64, BLOOM_BITS * len(self.numbers))
        marks = np.zeros(bits, bool)
        for lo in range(0, len(self.numbers), 1 << 16):
            marks[_probes(np.frombuffer(self.numbers[lo : lo + (1 << 16)], np.uint64), bits).ravel()] = True
        bloom = np.packbits(marks).tobytes()
        self.out.write(index + bloom + FOOTER.pack(self.at, len(index), self.at + len(index), bits, len(self.numbers), self.tokens, self.end_id, self.width, zlib.crc32(index + bloom), MAGIC))
        return {"docs": len(self.numbers), "tokens": self.tokens}


class SstReader:
    def __init__(self, source) -> None:
        self.source = source  # a random-access file
        size = source.size()
        source.seek(size - FOOTER.size)
        index_at, index_bytes, bloom_at, self.bits, self.docs, self.tokens, self.end_id, self.width, crc, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        source.seek(index_at)
        tail = source.read(size - FOOTER.size - index_at)
        if zlib.crc32(tail) != crc:
            raise ValueError("index or filter damaged")
        index = np.frombuffer(tail[:index_bytes], "S9,<u8,<u8") if index_bytes else []
        self.last_keys = [bytes(tail[25 * k : 25 * k + 9]) for k in range(len(index))]
        self.blocks = [(int(x[1]), int(x[2])) for x in index]
        self.bloom = np.frombuffer(tail, "u1", offset=bloom_at - index_at)

    def _block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        self.source.seek(self.blocks[k][0])
        data = self.source.read(self.blocks[k][1])
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("block damaged")
        at, key = 0, b""
        while at < len(data) - 4:
            shared, at = _read_varint(data, at)
            own, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + own]
            yield key, np.frombuffer(data, f"<u{self.width}", n // self.width, at + own)
            at += own + n

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.blocks)):
            for key, ids in self._block(k):
                yield id_of(key), ids

    def may_hold(self, doc_id: int | None) -> bool:
        at = _probes(np.array([_number(key_of(doc_id))], np.uint64), self.bits)[0].astype(np.int64)
        return bool((self.bloom[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).all())

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each document with this id."""
        if not self.may_hold(doc_id):
            return []
        key, out = key_of(doc_id), []
        for k in range(bisect_left(self.last_keys, key), len(self.blocks)):
            rows = list(self._block(k))
            out += [ids for x, ids in rows if x == key]
            if not rows or rows[-1][0] > key:
                break
        return out


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int, width: int | None = None, text: str = "text") -> list[dict]:
    """Writes the shards and returns their manifest: shard, path, docs, tokens, and start (ids in the shards before it).

    ``folder`` is a URI that every executor reaches. Rows are range-partitioned by doc_id and, among equal ids, spread, so that one
    id with a third of all rows is cut over shards. A task writes under a name of its own attempt and renames it when whole; a
    repeated task replaces the file with the same bytes. ``width`` is the bytes of an id, by default what the vocabulary takes; an id that doesn't fit is a
    ValueError. Null texts count as empty, null ids come first, equal ids are entries of their own. A document's ids are held whole, and texts of any length are encoded in
    segments. An empty table gives no shard and an empty manifest. Other columns are ignored.
    """
    width = width or id_bytes(tokenizer, end_id)
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        shard = task.partitionId()
        name, tmp = f"{root}/shard-{shard:06d}.sst", f"{root}/.part-{shard:06d}-{task.taskAttemptId()}"
        out = writer = None
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            if writer is None and ids:
                out = store.open_output_stream(tmp)
                writer = SstWriter(out, end_id, width)
            for k, tokens in encoded(texts, tokenizer):
                writer.add(key_of(ids[k]), np.append(tokens, np.uint32(end_id)))
        if writer:
            done = writer.close()
            out.close()
            store.move(tmp, name)
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [name], "docs": [done["docs"]], "tokens": [done["tokens"]]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("spread"))
    rows = rows.repartitionByRange(tasks_for(docs.sparkSession, table_bytes(docs)), "doc_id", "spread").sortWithinPartitions("doc_id", "spread").drop("spread")
    made = sorted((r.asDict() for r in rows.mapInArrow(write, "shard long, path string, docs long, tokens long").collect()), key=lambda r: r["shard"])  # a row for each shard
    start = 0
    for r in made:
        r["start"] = start
        start += r["tokens"]
    return made


def read_shards(spark: SparkSession, folder: str, manifest: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files, a task for each shard, block by block."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                rows = []
                with store.open_input_file(path) as source:
                    for doc_id, ids in SstReader(source).scan():
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) >= 10_000:
                            yield _rows(rows)
                            rows = []
                yield _rows(rows)

    shards = spark.createDataFrame([(r["shard"], r["path"], r["start"]) for r in manifest], "shard long, path string, start long")
    return shards.repartitionByRange(max(1, len(manifest)), "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def op7_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "sst")
    return read_shards(spark, folder, write_shards(documents(spark, sf_dir), folder, public_path(), end_id=2))


QUERIES = {"op7_sstable": op7_sstable}
ORACLE: dict = {}
