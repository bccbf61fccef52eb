"""Exact dedup through a minimal perfect hash over the distinct digests of a history.

Texts are equal when their SHA-256 digests agree after the six ASCII white-space characters are deleted. Of equal
texts the row with the most code points in the original text stays, then the smallest doc_id (nulls last).

1. Each row becomes (row id, doc_id, digest, code points), written once to the shared folder. No later step reads texts.
2. The digests of the history are grouped (with map-side combine, so a hot text costs each task one row) into
   count and winner, and dealt into index parts by digest hash; a part holds some 32,000 distinct digests.
3. Each part gets a minimal perfect hash: levels of bitmaps, where a key stays on the first level on which it
   collides with none; its slot is the rank of its bit. Slots hold the full digest, the winner's locator (row id
   and doc_id) and the group's size.
4. Rows meet their part and look up their slot; the digest there is compared byte by byte. Members take the winner from
   the slot. Nonmembers (possible when the history is another table) are grouped by themselves the same way.

A part with more than 1/200 of all rows (at most 200 of them) is split: its index goes to several tasks and its rows are
dealt among them, so a text that makes up a third of all rows is looked up in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from deskdb.llm.common import WHITE, documents, keep_rows, saved, table_bytes, tasks_for, text_of

#: Distinct digests that an index part holds at most, on average; an index part is some 2 MB.
PART_KEYS = 32_768
#: Index parts at least, so that small inputs are dealt out as well.
LEAST_PARTS = 256
#: A part with more than this share of the rows is split over tasks.
HOT_SHARE = 200

GAMMA, LEVELS = 1.5, 48
SLOT = np.dtype([("digest", "V32"), ("rid", "<i8"), ("keep_id", "<i8"), ("no_id", "u1"), ("group_size", "<i8")])


def _level_hash(a: np.ndarray, b: np.ndarray, level: int, m: int) -> np.ndarray:
    """Double hashing on two words of the digest, mixed once more."""
    with np.errstate(over="ignore"):
        x = a + np.uint64(2 * level + 1) * b
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return (x % np.uint64(m)).astype(np.int64)


def _words(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = np.ascontiguousarray(digests).view("<u8").reshape(-1, 4)
    return w[:, 0].copy(), w[:, 1] | np.uint64(1)


def build_mph(slots: np.ndarray) -> bytes:
    """The index of distinct digests: sizes of levels, bitmaps, and the records in slot order."""
    a, b = _words(np.ascontiguousarray(slots["digest"]))
    left, sizes, maps, order = np.arange(len(slots)), [], [], []
    for level in range(LEVELS):
        if not len(left):
            break
        m = max(8, int(np.ceil(GAMMA * len(left))))
        h = _level_hash(a[left], b[left], level, m)
        alone = np.bincount(h, minlength=m) == 1
        stays = alone[h]
        sizes.append(m)
        maps.append(np.packbits(alone))
        order.append(left[stays][np.argsort(h[stays])])
        left = left[~stays]
    head = np.array([len(slots), len(left), len(sizes), *sizes], "<i8")  # those left over share both words: found by comparison
    return head.tobytes() + b"".join(m.tobytes() for m in maps) + slots[np.concatenate([*order, left])].tobytes()


class Mph:
    """Reads what build_mph wrote."""

    def __init__(self, blob: bytes) -> None:
        n, self.rest, levels = np.frombuffer(blob, "<i8", 3)
        self.sizes = np.frombuffer(blob, "<i8", levels, 24)
        at, self.maps, self.ranks, base = 24 + 8 * int(levels), [], [], 0
        for m in self.sizes:
            bits = np.unpackbits(np.frombuffer(blob, "u1", (int(m) + 7) // 8, at), count=int(m))
            at += (int(m) + 7) // 8
            self.maps.append(bits.astype(bool))
            self.ranks.append(np.cumsum(bits, dtype=np.int64) - 1 + base)
            base += int(bits.sum())
        self.slots = np.frombuffer(blob, SLOT, int(n), at)

    def find(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 for nonmembers."""
        slot, left = np.full(len(digests), -1), np.arange(len(digests))
        a, b = _words(digests)
        for level, m in enumerate(self.sizes):
            h = _level_hash(a[left], b[left], level, int(m))
            on = self.maps[level][h]
            slot[left[on]] = self.ranks[level][h[on]]
            left = left[~on]
        if self.rest and len(left):
            tail = {x.tobytes(): k for k, x in enumerate(self.slots["digest"][-int(self.rest):], len(self.slots) - int(self.rest))}
            slot[left] = [tail.get(digests[k].tobytes(), -1) for k in left]
        if len(self.slots):
            same = self.slots["digest"][slot] == digests
            slot[~same] = -1
        return slot


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    slots = np.zeros(len(pdf), SLOT)
    slots["digest"] = np.frombuffer(b"".join(pdf["digest"]), "V32")
    for name in ("rid", "keep_id", "no_id", "group_size"):  # none holds nulls, which pandas would turn into floats
        slots[name] = pdf[name]
    return pd.DataFrame({"part": pdf["part"].iloc[:1], "blob": [build_mph(slots)]})


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by part and split, the index first; one index is held at a time."""
    at, index = None, None
    for batch in batches:
        unit = np.stack([batch.column(n).to_numpy() for n in ("part", "split")], 1)
        cuts = [0, *(np.flatnonzero((unit[1:] != unit[:-1]).any(1)) + 1), len(unit)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            if at != tuple(unit[lo]):
                at, index = tuple(unit[lo]), None
            own = batch.slice(lo, hi - lo)
            if own["blob"].null_count < own.num_rows:
                index = Mph(next(x for x in own["blob"].to_pylist() if x is not None))
                own = own.filter(pc.is_null(own["blob"]))
            if not own.num_rows:
                continue
            digests = np.frombuffer(b"".join(own["digest"].to_pylist()), "V32")
            slot = index.find(digests) if index is not None else np.full(own.num_rows, -1)
            hit = slot >= 0
            got = index.slots[slot] if index is not None and len(index.slots) else np.zeros(own.num_rows, SLOT)
            yield pa.RecordBatch.from_pydict({
                "rid": own["rid"], "doc_id": own["doc_id"], "digest": own["digest"], "n_points": own["n_points"],
                "keep_id": pa.array(got["keep_id"], pa.int64(), mask=~hit | (got["no_id"] > 0)),
                "keep_rid": pa.array(got["rid"], pa.int64(), mask=~hit), "group_size": pa.array(got["group_size"], pa.int64(), mask=~hit),
            })


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """rid (unique), doc_id, digest of the text without white space, code points of the original; null texts count as empty."""
    plain = F.translate(text_of(text), WHITE, "")
    return docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(plain, 256)).alias("digest"), F.length(text_of(text)).cast("long").alias("n_points"))


def _part(n: int):
    return F.pmod(F.xxhash64("digest"), F.lit(n)).cast("int")


def build_index(prints: DataFrame, parts: int) -> DataFrame:
    """(part, blob): the minimal perfect hash of each part of the distinct digests of ``prints``."""
    best = F.min(F.struct((-F.col("n_points")).alias("p"), F.col("doc_id").isNull().alias("z"), F.col("doc_id"), F.col("rid"))).alias("best")
    groups = prints.groupBy("digest").agg(best, F.count(F.lit(1)).alias("group_size"))
    slots = groups.select(_part(parts).alias("part"), "digest", F.coalesce("best.doc_id", F.lit(0)).alias("keep_id"), F.col("best.z").alias("no_id"), F.col("best.rid").alias("rid"), "group_size")
    return slots.groupBy("part").applyInPandas(_build, "part int, blob binary")


def look_up(prints: DataFrame, index: DataFrame, parts: int) -> DataFrame:
    """Each row of ``prints`` (a saved table) with what its slot in ``index`` holds; nulls for nonmembers."""
    spark = prints.sparkSession
    rows, total = prints.withColumn("part", _part(parts)), prints.count()
    hot = [(r["part"], -(-r["count"] * HOT_SHARE // total)) for r in rows.groupBy("part").count().filter(F.col("count") * HOT_SHARE > total).collect()]
    hot = spark.createDataFrame(hot, "part int, splits long")  # HOT_SHARE rows at most
    ways = F.coalesce("splits", F.lit(1).cast("long"))
    rows = rows.join(F.broadcast(hot), "part", "left").select("part", F.pmod("rid", ways).cast("int").alias("split"), F.lit(None).cast("binary").alias("blob"), "rid", "doc_id", "digest", "n_points")
    none = [F.lit(None).cast(t).alias(n) for n, t in (("rid", "long"), ("doc_id", "long"), ("digest", "binary"), ("n_points", "long"))]
    index = index.join(F.broadcast(hot), "part", "left").select("part", F.explode(F.sequence(F.lit(0), (ways - 1).cast("int"))).alias("split"), "blob", *none)
    met = index.unionByName(rows).repartition(tasks_for(spark, 2 * table_bytes(prints)), "part", "split").sortWithinPartitions("part", "split", F.col("blob").isNull())
    return met.mapInArrow(_look_up, "rid long, doc_id long, digest binary, n_points long, keep_id long, keep_rid long, group_size long")


def exact_dedup(docs: DataFrame, history: DataFrame | None = None, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, seen_before.

    Without a ``history`` the documents are their own history. With one, texts that it holds are repeats
    (keep_id: the historical winner, kept false, group_size counts the historical rows); the others are grouped among themselves.

    Null texts count as empty; all empty texts form one group. Null doc_ids lose ties. Rows repeated in full are one group, of
    which exactly one row is kept. An empty table gives an empty result. Other columns of ``docs`` are ignored.
    """
    prints = saved(fingerprints(docs, text), "prints")
    past = prints if history is None else saved(fingerprints(history, text), "history")
    parts = max(LEAST_PARTS, -(-past.count() // PART_KEYS))
    found = look_up(prints, build_index(past, parts), parts)
    if history is not None:
        found = saved(found, "members")
        own = saved(found.filter("group_size is null").select("rid", "doc_id", "digest", "n_points"), "nonmembers")
        parts = max(LEAST_PARTS, -(-own.count() // PART_KEYS))
        members = found.filter("group_size is not null").withColumn("keep_rid", F.lit(-1).cast("long")).withColumn("seen_before", F.lit(True))
        found = members.unionByName(look_up(own, build_index(own, parts), parts).withColumn("seen_before", F.lit(False)))
    else:
        found = found.withColumn("seen_before", F.lit(False))
    return found.select("doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "seen_before")


def without_copies(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that exact_dedup keeps, with all their columns. Of rows with one doc_id and equal texts the longest stays."""
    found = saved(exact_dedup(docs, text=text).select("doc_id", "text_sha256", "kept"), "exact")
    repeated = bool(found.groupBy("doc_id", "text_sha256").count().filter("count > 1").take(1))
    sha = F.sha2(F.translate(text_of(text), WHITE, ""), 256)
    return keep_rows(docs, found.filter("kept"), {"doc_id": F.col("doc_id").cast("long"), "text_sha256": sha}, repeated, F.struct(F.length(text_of(text)), text_of(text)))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).drop("seen_before")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM (
  SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id
  FROM d
)
"""

QUERIES = {"op9_exact_dedup": op9_exact_dedup}
ORACLE = {"op9_exact_dedup": OP9_SQL}
