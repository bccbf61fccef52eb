"""SimHash near-dedup with a hierarchical index over fingerprints in Gray order.

A fingerprint has a bit where over half the hashes of a text's 4-word shingles (repeats included) have it; fingerprints that
differ in 4 bits at most are linked; a component is what links reach.

1. Fingerprints are computed with numpy over whole texts (XXH64 of spans of a byte buffer). Rows with one fingerprint are one
   class from here on, so copies never form pairs.
2. Two fingerprints that differ in d bits agree on at least c of d + c blocks of bits. For each choice of c blocks every
   class is dealt out by its bits there (5 choices of one block; more blocks as classes grow, so that groups stay small).
3. Within such a group the fingerprints are sorted by Gray rank, so that neighbours share most bits. Eight neighbours
   are one node, eight nodes the next above; a node holds the masked pattern of the bits that all below it share, less
   those already held above. A search adds up differences from the root down and drops a node, with all below it, once
   there are more than d. What it links is kept as one link from each fingerprint to the least it is connected with, never as
   all pairs. A group beyond TILE fingerprints is dealt out once more, by d + 1 runs of the bits that its members needn't agree on, one of which two that are
   linked must share; what is still beyond TILE is cut into tiles, and every pair of tiles is searched by a task of its own.
4. Components are found by distributed pointer rounds (see ``components``) and joined back to the rows.

``similar_rows`` links by similarity instead: rows whose sets of 5-word shingles have 0.8 or more of their union in common. Most are found by fingerprints: classes are
dealt out by samples of bits, the index searches each group up to 14 bits, the links of a minimum spanning forest by bits are candidates, and a candidate counts if
the shingle sets themselves are as similar as asked. Which pairs this finds is a matter of chance, so what it leaves apart is then searched exactly (``part_keys``): sets that
are as similar as asked differ in few shingles, so of a few more ranges of hashes than that they agree on one, and whatever agrees on a range is compared unless it is connected already.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from deskdb.llm.common import documents, keep_rows, saved, shuffles_dropped, spread, table_bytes, tasks_for, text_of
from deskdb.llm.components import components

SEED, WORDS, BITS = 42, 4, 4
#: Bytes of text that are hashed at a time, and the longest span hashed with the others.
STEP_BYTES, LONG_SPAN = 2 << 20, 2048
#: Fingerprints in a group beyond which it is cut into tiles.
TILE = 32_768
#: Groups hold this many classes at most on average; beyond it, one more block must agree.
GROUP = 4_096
FAN = 8
#: Fingerprints searched together, and (fingerprint, node) pairs held at once.
TOGETHER, FRONTIER = 150_000, 1 << 20

# Fixed values of XXH64
P1 = np.uint64(11400714785074694791)
P2 = np.uint64(14029467366897019727)
P3 = np.uint64(1609587929392839161)
P4 = np.uint64(9650029242287828579)
P5 = np.uint64(2870177450012600261)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def xxh64_spans(buffer: bytes, starts: np.ndarray, lengths: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of buffer[starts[k]:starts[k]+lengths[k]] for each k, all spans at once."""
    raw = np.frombuffer(buffer + b"\0" * 40, np.uint8)
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    four = np.ndarray((len(raw) - 3,), "<u4", raw, strides=(1,))
    out = np.empty(len(starts), np.uint64)
    long = np.flatnonzero(lengths > LONG_SPAN)
    for k in long:
        out[k] = xxhash.xxh64_intdigest(buffer[starts[k] : starts[k] + lengths[k]], seed)
    at = np.flatnonzero(lengths <= LONG_SPAN) if len(long) else slice(None)
    s, n = starts[at], lengths[at]
    with np.errstate(over="ignore"):
        seed = np.uint64(seed)
        h = np.full(len(s), seed + P5, np.uint64)
        stripes = n >> 5
        big = np.flatnonzero(stripes)
        if len(big):
            v = [np.full(len(big), x, np.uint64) for x in (seed + P1 + P2, seed + P2, seed, seed - P1)]
            for k in range(int(stripes.max())):
                on = np.flatnonzero(stripes[big] > k)
                base = s[big[on]] + 32 * k
                for j in range(4):
                    v[j][on] = _round(v[j][on], eight[base + 8 * j])
            acc = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for j in range(4):
                acc = (acc ^ _round(np.zeros_like(acc), v[j])) * P1 + P4
            h[big] = acc
        h += n.astype(np.uint64)
        pos, rest = s + 32 * stripes, n & 31
        for k in range(3):
            on = np.flatnonzero(rest >= 8 * (k + 1))
            if len(on):
                h[on] = _rotl(h[on] ^ _round(np.zeros(len(on), np.uint64), eight[pos[on] + 8 * k]), 27) * P1 + P4
        pos = pos + (rest & 24)
        on = np.flatnonzero(rest & 4)
        h[on] = _rotl(h[on] ^ (four[pos[on]].astype(np.uint64) * P1), 23) * P2 + P3
        pos = pos + (rest & 4)
        for k in range(3):
            on = np.flatnonzero((rest & 3) > k)
            h[on] = _rotl(h[on] ^ (raw[pos[on] + k].astype(np.uint64) * P5), 11) * P1
        h ^= h >> np.uint64(33)
        h *= P2
        h ^= h >> np.uint64(29)
        h *= P3
        h ^= h >> np.uint64(32)
    out[at] = h
    return out


#: For each byte value, a word whose byte k is bit k of it.
SPREAD = (np.arange(256, dtype=np.uint64)[:, None] >> np.arange(8, dtype=np.uint64) & np.uint64(1)).astype(np.uint8).view("<u8").ravel()


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of ``counts[k]`` > 0 hashes, the bits set in over half of them."""
    starts = np.cumsum(counts) - counts
    blocks = -(-counts // 255)
    first = np.cumsum(blocks) - blocks
    at = np.repeat(starts, blocks) + 255 * (np.arange(int(blocks.sum())) - np.repeat(first, blocks))
    octets, out = hashes.view(np.uint8).reshape(-1, 8), np.empty((len(counts), 8), np.uint8)
    for k in range(8):
        sums = np.add.reduceat(SPREAD[octets[:, k]], at).view(np.uint8).reshape(-1, 8)
        bits = np.add.reduceat(sums.astype(np.int64), first, axis=0) * 2 > counts[:, None]
        out[:, k] = np.packbits(bits, axis=1, bitorder="little")[:, 0]
    return out.view("<u8").ravel()


def simhash(texts: list[str | None], words: int = WORDS, sets: list | None = None) -> np.ndarray:
    """The fingerprint of each text; without words, zero. ``sets`` gets each text's distinct shingles, as sorted 32-bit hashes."""
    plain = [b" ".join((t or "").encode().lower().split()) for t in texts]  # bytes: A-Z and the six ASCII white-space characters only
    out, lo = np.zeros(len(plain), np.uint64), 0
    while lo < len(plain):
        hi, size = lo, 0
        while hi < len(plain) and (hi == lo or size + len(plain[hi]) <= STEP_BYTES):
            size += len(plain[hi])
            hi += 1
        some = [k for k in range(lo, hi) if plain[k]]
        if some:
            buffer = b"\n".join(plain[k] for k in some)
            raw = np.frombuffer(buffer, np.uint8)
            cuts = np.flatnonzero((raw == 32) | (raw == 10))
            begin, end = np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(raw)]])
            last = np.concatenate([np.flatnonzero(raw[cuts] == 10), [len(cuts)]])  # each text's last word
            n = np.diff(last, prepend=-1)
            made = np.maximum(n - words + 1, 1)
            first = last - n + 1
            k = np.repeat(first - (np.cumsum(made) - made), made) + np.arange(int(made.sum()))
            ends = end[np.minimum(k + words - 1, np.repeat(last, made))]
            hashes = xxh64_spans(buffer, begin[k], ends - begin[k])
            out[some] = majority(hashes, made)
        if sets is not None:
            parts = dict(zip(some, np.split(hashes.astype(np.uint32), np.cumsum(made)[:-1]))) if some else {}
            sets += [np.unique(parts[k]) if k in parts else np.empty(0, np.uint32) for k in range(lo, hi)]
        lo = hi
    return out


def fingerprints(docs: DataFrame, text: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, digest (of the text), fp (the fingerprint's bits as a signed long) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("digest"), pa.array(simhash(b.column("text").to_pylist(), words).view(np.int64))], ["doc_id", "digest", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of(text)).alias("digest"), F.col(text).alias("text"))
    return spread(rows).mapInArrow(run, "doc_id long, digest long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each word in the Gray sequence."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


class GrayIndex:
    """Levels of nodes over fingerprints sorted by (unit, Gray rank); no node crosses units. Level 0 are the fingerprints."""

    def __init__(self, unit: np.ndarray, fp: np.ndarray) -> None:
        full = np.full(len(fp), ~np.uint64(0))
        self.levels = [{"unit": unit, "value": fp, "mask": full, "last": np.arange(len(fp))}]
        while True:
            below = self.levels[-1]
            u = below["unit"]
            fresh = np.concatenate([[True], u[1:] != u[:-1]])
            start = np.flatnonzero(fresh)
            if len(start) == len(u):
                break
            rank = np.arange(len(u)) - np.repeat(start, np.diff(start, append=len(u)))
            at = np.flatnonzero(rank % FAN == 0)
            count = np.diff(at, append=len(u))
            shared = np.bitwise_and.reduceat(below["mask"], at)
            lead = below["value"][at]
            shared &= ~np.bitwise_or.reduceat((below["value"] ^ np.repeat(lead, count)), at)
            below["residual"] = below["mask"] & ~np.repeat(shared, count)
            self.levels.append({"unit": u[at], "value": lead & shared, "mask": shared, "last": below["last"][at + count - 1], "child": at, "count": count})
        self.levels[-1]["residual"] = self.levels[-1]["mask"]

    def search(self, unit: np.ndarray, fp: np.ndarray, most: int, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, entry) in the same unit that differ in ``most`` bits at most; with ``after``, entries behind that place only."""
        top = self.levels[-1]
        node = np.searchsorted(top["unit"], unit)
        q = np.flatnonzero((node < len(top["unit"])) & (top["unit"][np.minimum(node, len(top["unit"]) - 1)] == unit))
        node, gone = node[q], np.zeros(len(q), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            here = self.levels[level]
            if level < len(self.levels) - 1:
                above = self.levels[level + 1]
                n = above["count"][node]
                ends = np.cumsum(n)
                q, gone, node = np.repeat(q, n), np.repeat(gone, n), np.repeat(above["child"][node] - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)
            if after is not None:
                keep = here["last"][node] > after[q]
                q, gone, node = q[keep], gone[keep], node[keep]
            gone = gone + np.bitwise_count((fp[q] ^ here["value"][node]) & here["residual"][node])
            keep = gone <= most
            q, gone, node = q[keep], gone[keep], node[keep]
        return q, node


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the least member's place) after the links between a and b."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            jump = label[label]
            if (jump == label).all():
                break
            label = jump


def links_within(unit: np.ndarray, side: np.ndarray, fp: np.ndarray, most: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within each unit. side 0: entries to be linked among themselves; 1 and 2: with the other side."""
    order = np.lexsort((side, gray_rank(fp), unit))
    unit, side, fp = unit[order], side[order], fp[order]
    label = np.arange(len(fp))
    for own, other in ((0, 0), (1, 2)):
        asks, holds = np.flatnonzero(side == own), np.flatnonzero(side == other)
        if not len(asks) or not len(holds):
            continue
        index = GrayIndex(unit[holds], fp[holds])
        width = np.cumsum(np.searchsorted(unit[holds], unit[asks], "right") - np.searchsorted(unit[holds], unit[asks]))
        lo = 0
        while lo < len(asks):
            hi = max(lo + 1, int(np.searchsorted(width, (width[lo - 1] if lo else 0) + FRONTIER, "right")))
            some = asks[lo:hi]
            q, e = index.search(unit[some], fp[some], most, np.arange(lo, hi) if own == 0 else None)
            label = _unite(label, some[q], holds[e])
            lo = hi
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return fp[moved], fp[label[moved]]


def _search_units(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by unit; whole units are searched together until there are TOGETHER rows."""
        held: list[tuple] = []

        def done(rows: list[tuple], upto: int | None) -> tuple[pa.RecordBatch | None, list[tuple]]:
            unit, side, fp = (np.concatenate(c) for c in zip(*rows))
            cut = len(unit) if upto is None else int(np.searchsorted(unit, upto))
            if not cut:
                return None, [(unit, side, fp)]
            a, b = links_within(unit[:cut], side[:cut], fp[:cut], most)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"]), [(unit[cut:], side[cut:], fp[cut:])]

        for b in batches:
            if b.num_rows:
                held.append((b.column("unit").to_numpy(), b.column("side").to_numpy(), b.column("fp").to_numpy().view(np.uint64)))
                if sum(len(x[0]) for x in held) >= TOGETHER:
                    out, held = done(held, held[-1][0][-1])
                    if out is not None:
                        yield out
        if held:
            yield done(held, None)[0]

    return run


def blocks(n_blocks: int) -> list[int]:
    """Masks of nearly equal runs of bits."""
    cuts = [64 * k // n_blocks for k in range(n_blocks + 1)]
    return [(1 << hi) - (1 << lo) for lo, hi in zip(cuts, cuts[1:])]


def runs_of(mask: int, n: int) -> list[int]:
    """The bits of ``mask`` in ``n`` nearly equal runs, as masks."""
    bits = [k for k in range(64) if mask >> k & 1]
    return [sum(1 << k for k in bits[len(bits) * j // n : len(bits) * (j + 1) // n]) for j in range(n)]


def fingerprint_links(classes: DataFrame, n_classes: int, most: int = BITS, tile: int = TILE) -> DataFrame:
    """(a, b): links that connect what chains of links of ``most`` bits connect. classes: a saved table of distinct fp."""
    agree = 1
    while agree < 4 and n_classes >> (64 * agree // (most + agree)) > GROUP:
        agree += 1
    masks = [sum(c) for c in combinations(blocks(most + agree), agree)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    dealt = classes.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("bits")) for k, m in enumerate(masks)])).alias("g")).select("fp", "g.k", "g.bits")
    rows = dealt.select("fp", "k", F.xxhash64("k", "bits").alias("unit"))
    large = lambda rows: saved(rows.groupBy("unit").count().filter(F.col("count") > tile).select("unit", F.ceil(F.col("count") / tile).cast("int").alias("tiles")), "tiles")
    units = rows.select("unit", F.lit(0).alias("side"), "fp")
    if (hot := large(rows)).take(1):
        rest = F.array(*[F.array(*[F.lit(signed(x)).cast("long") for x in runs_of(~m & (1 << 64) - 1, most + 1)]) for m in masks])
        finer = F.transform(F.element_at(rest, F.col("k") + 1), lambda m, j: F.xxhash64("unit", j, F.col("fp").bitwiseAND(m)))
        rows = rows.join(hot, "unit", "left").select("fp", F.explode(F.when(F.col("tiles").isNull(), F.array("unit")).otherwise(finer)).alias("unit"))
        # each row goes to the units of its tile with every tile, once for each; units of a hot group are as large as others
        both = rows.join(large(rows), "unit", "left").withColumn("own", F.pmod(F.xxhash64("fp"), F.coalesce("tiles", F.lit(1))).cast("int"))
        both = both.select("fp", "unit", "own", F.explode(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1)).alias("other"))
        side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
        units = both.select(F.xxhash64("unit", F.least("own", "other"), F.greatest("own", "other")).alias("unit"), side.alias("side"), "fp")
    return units.repartition(tasks_for(classes.sparkSession, len(masks) * table_bytes(classes)), "unit").sortWithinPartitions("unit").mapInArrow(_search_units(most), "a long, b long")


def component_rows(docs: DataFrame, most: int = BITS, text: str = "text") -> DataFrame:
    """doc_id, digest, fp, root (a fingerprint that names the component), component_id (null if no row of it has a doc_id) for each row of ``docs``."""
    prints = saved(fingerprints(docs, text), "fingerprints")
    classes = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(fingerprint_links(classes.select("fp"), classes.count(), most))
    linked = roots.withColumnRenamed("node", "fp").join(classes, "fp")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of = roots.join(least, "root").select(F.col("node").alias("fp"), "root", "component_id")
    of = saved(classes.join(of, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "least").alias("component_id")), "class-components")  # a table: AQE splits hot fingerprints
    return prints.join(of, "fp").select("doc_id", "digest", "fp", "root", "component_id")


def simhash_components(docs: DataFrame, most: int = BITS, text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable) for each row of ``docs``.

    Null and wordless texts have fingerprint zero and link like any other. Null doc_ids are never a component's id unless it has
    no other. Rows repeated in full share a component. An empty table gives an empty result; other columns are ignored.
    """
    return component_rows(docs, most, text).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


SIMILARITY, SIMILAR_WORDS = 0.8, 5
#: Bits by which candidates differ at most; a pair that differs in AIM_BITS is found with 1 - exp(-AIM_TABLES).
REACH, AIM_BITS, AIM_TABLES = 14, 10, 3.0
#: Classes in a group of a table: on average, and at most.
FEW, MANY = 64, 4096


def spanning(n: int, a: np.ndarray, b: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Numbers of the links of a minimum spanning forest over nodes 0 to n - 1: in each round every tree takes its cheapest link."""
    order = np.lexsort((b, a, cost))
    a, b, label, taken = a[order], b[order], np.arange(n), []
    live = np.arange(len(a))
    while True:
        x, y = label[a[live]], label[b[live]]
        apart = x != y
        if not apart.any():
            return order[np.concatenate(taken)] if taken else np.empty(0, np.int64)
        live, x, y = live[apart], x[apart], y[apart]
        best = np.full(n, len(a))
        np.minimum.at(best, x, live)
        np.minimum.at(best, y, live)
        pick = np.unique(best[best < len(a)])
        taken.append(pick)
        label = _unite(label, a[pick], b[pick])


def nearest_links(unit: np.ndarray, fp: np.ndarray, reach: int = REACH) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints linked by a minimum spanning forest of each unit's pairs that differ in ``reach`` bits at most."""
    order = np.lexsort((gray_rank(fp), unit))
    unit, fp = unit[order], fp[order]
    index, at = GrayIndex(unit, fp), np.arange(len(fp))
    width = np.cumsum(np.searchsorted(unit, unit, "right") - np.searchsorted(unit, unit))
    a = b = np.empty(0, np.int64)
    lo = 0
    while lo < len(fp):  # the forest so far goes on with the next queries' pairs
        hi = max(lo + 1, int(np.searchsorted(width, (width[lo - 1] if lo else 0) + FRONTIER, "right")))
        q, e = index.search(unit[lo:hi], fp[lo:hi], reach, at[lo:hi])
        a, b = np.concatenate([a, q + lo]), np.concatenate([b, e])
        keep = spanning(len(fp), a, b, np.bitwise_count(fp[a] ^ fp[b]).astype(np.int64))
        a, b, lo = a[keep], b[keep], hi
    return fp[a], fp[b]


def bit_samples(n_classes: int, seed: int = 7) -> list[list[int]]:
    """For each table the order in which it asks for bits, and first how many: enough that groups hold FEW classes on average."""
    asked = max(8, (n_classes // FEW).bit_length())
    tables = int(np.ceil(AIM_TABLES / (1 - AIM_BITS / 64) ** asked))
    rng = np.random.default_rng(seed)
    return [[min(asked, 64), *rng.permutation(64).tolist()] for _ in range(tables)]


def similar_candidates(classes: DataFrame, n_classes: int) -> DataFrame:
    """(a, b): distinct pairs of fingerprints that may be of similar rows. classes: a saved table of distinct fp."""
    spark, tables = classes.sparkSession, bit_samples(n_classes)

    def mask(t: list[int], lo: int, hi: int) -> Column:
        bits = sum(1 << b for b in t[1:][lo:hi])
        return F.lit(bits - (1 << 64) if bits >> 63 else bits).cast("long")

    first = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(mask(t, 0, t[0])).alias("bits")) for k, t in enumerate(tables)])
    rows = classes.select("fp", F.explode(first).alias("g")).select("fp", "g.k", F.xxhash64("g.k", "g.bits").alias("unit"))
    done = tables[0][0]
    while done < 64:  # groups beyond MANY ask for more bits
        hot = saved(rows.groupBy("unit").count().filter(F.col("count") > MANY).select("unit"), "many")
        if not hot.take(1):
            break
        more = F.element_at(F.array(*[mask(t, done, done + 6) for t in tables]), F.col("k") + 1)
        rows = rows.join(hot.withColumn("hot", F.lit(True)), "unit", "left").select("fp", "k", F.when(F.col("hot"), F.xxhash64("unit", F.col("fp").bitwiseAND(more))).otherwise(F.col("unit")).alias("unit"))
        done += 6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by unit; whole units are searched together until there are TOGETHER rows."""
        held: list[tuple] = []

        def found(upto: int | None) -> pa.RecordBatch:
            unit, fp = (np.concatenate(c) for c in zip(*held))
            cut = len(unit) if upto is None else int(np.searchsorted(unit, upto))
            held[:] = [(unit[cut:], fp[cut:])]
            a, b = nearest_links(unit[:cut], fp[:cut])
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b).view(np.int64)), pa.array(np.maximum(a, b).view(np.int64))], ["a", "b"])

        for b in batches:
            if b.num_rows:
                held.append((b.column("unit").to_numpy(), b.column("fp").to_numpy().view(np.uint64)))
                if sum(len(x[0]) for x in held) >= TOGETHER:
                    yield found(held[-1][0][-1])
        if held:
            yield found(None)

    dealt = rows.select("unit", "fp").repartition(tasks_for(spark, len(tables) * table_bytes(classes)), "unit").sortWithinPartitions("unit")
    return dealt.mapInArrow(run, "a long, b long").distinct()


#: Rows up to which those that are to be compared go to all tasks, so that other rows' sets stay where they are.
FEW_ROWS = 250_000


def alike(links: DataFrame, grams: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """Those of ``links`` (a, b) whose rows' sets have the similarity. grams: rid, grams (sorted 32-bit hashes); sketches: a saved table of them.

    Sketches rule out nearly all others, so few sets are moved.
    """
    one, two = (sketches.select("rid", "size", "odd").toDF(k, f"size_{k}", f"odd_{k}") for k in ("a", "b"))
    may = saved(links.join(one, "a").join(two, "b").mapInArrow(_may_be_alike(similarity), "a long, b long"), "may-be-alike")
    rows = saved(may.select(F.col("a").alias("rid")).union(may.select("b")).distinct(), "compared")
    grams = grams.join(F.broadcast(rows) if rows.count() <= FEW_ROWS else rows, "rid", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for one, two in zip(b.column("one"), b.column("two")):
                x, y = (np.frombuffer(s.as_buffer(), "<u4") for s in (one, two))
                both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= similarity * max(len(x), len(y)) else 0
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return may.join(grams.toDF("a", "one"), "a").join(grams.toDF("b", "two"), "b").mapInArrow(run, "a long, b long")


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(29))


LEVEL = np.uint64(63)


def differing(sizes: int | np.ndarray, similarity: float) -> float | np.ndarray:
    """What two sets of the similarity differ in at most, given the sum of their sizes; rounded up a little, so that floor() is right."""
    return (1 - similarity) / (1 + similarity) * sizes + 1e-9


@lru_cache
def size_classes(similarity: float) -> np.ndarray:
    """The greatest size of each class; no set is as similar to sets of other classes than its own and the two beside it."""
    tops = [5]
    while tops[-1] < 1 << 31 and len(tops) < 63:
        tops.append(max(-(-3 * tops[-1] // 2), int(np.ceil(tops[-1] / similarity))))
    return np.array([*tops[:-1], max(tops[-1], 1 << 31)])


#: 64-bit words of a sketch.
SKETCH = 4


def sketch(grams: np.ndarray) -> np.ndarray:
    """Bits that tell whether an odd number of hashes falls on them: two sets' sketches differ in no more bits than the sets in hashes."""
    odd = np.bincount(grams >> np.uint32(7) & np.uint32(64 * SKETCH - 1), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view("<u8")


#: Bits of a long sketch at most.
MOST_ODD = 1 << 18


def long_sketch(grams: np.ndarray) -> np.ndarray:
    """As ``sketch``, with two to four bits for each hash (a power of two, 64 at least): exclusive or of its halves gives that of half as many bits."""
    bits = min(max(64, 1 << (2 * len(grams) - 1).bit_length()), MOST_ODD)
    odd = np.bincount(grams & np.uint32(bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def _may_be_alike(similarity: float):
    """Rows (a, b, their sizes and long sketches) to pairs whose sizes and sketches allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for n, m, one, two in zip(b.column("size_a").to_pylist(), b.column("size_b").to_pylist(), b.column("odd_a"), b.column("odd_b")):
                may = min(n, m) >= similarity * max(n, m)
                if may:
                    x, y = (np.frombuffer(s.as_buffer(), "<u8") for s in (one, two))
                    while len(x) != len(y):
                        x, y = (x, y) if len(x) > len(y) else (y, x)
                        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                    may = int(np.bitwise_count(x ^ y).sum()) <= differing(n + m, similarity)
                keep.append(may)
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def part_keys(grams: np.ndarray, similarity: float) -> np.ndarray:
    """Keys (64-bit) of a set of sorted 32-bit hashes: any two different sets of the similarity have one in common.

    Sets are in classes of sizes up to ``top``, and in the next class too if a partner may be there. Two sets of the similarity differ in at most
    (1 - s) / (1 + s) of both sizes' sum; the hashes are cut into more ranges than that, so that some range is the same in both. A key is
    a range with what the set has there, and in its last 6 bits the class: such a pair has a key of the class of its larger set in common. Empty ranges say nothing and give no key, unless the set has so many that they could be all that agree.
    """
    n, out = len(grams), []
    most = int(n / similarity + 1e-9)
    bound = lambda size: int(differing(size, similarity))
    if not n or not bound(n + most):
        return np.empty(0, np.uint64)  # only equal sets are as similar
    tops = size_classes(similarity)
    level = int(np.searchsorted(tops, n))
    wide = grams.astype(np.uint64)
    while True:
        top = int(tops[level])
        parts = bound(2 * top) + 2 + bound(2 * top) // 8
        at = (wide * np.uint64(parts)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        with np.errstate(over="ignore"):
            salt = np.uint64(level + 1) * P1
            out.append(_mixed(np.add.reduceat(_mixed(wide), first) + _mixed(at[first] * P2 + salt)) & ~LEVEL | np.uint64(level))
            if parts - len(first) >= parts - bound(n + min(most, top)):
                empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), at[first], assume_unique=True)
                out.append(_mixed(_mixed(empty * P2 + salt)) & ~LEVEL | np.uint64(level))
        if most <= top:
            return np.concatenate(out)
        level += 1


#: Keys and pairs that leave a Python worker at a time.
STEP_ROWS = 1 << 17


def _key_rows(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0

        def out() -> pa.RecordBatch:
            keys = np.concatenate([k for _, k in held])
            rids = np.repeat(np.array([r for r, _ in held], np.int64), [len(k) for _, k in held])
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(rids)], ["key", "rid"])

        for b in batches:
            for rid, blob in zip(b.column("rid").to_pylist(), b.column("grams")):
                held.append((rid, part_keys(np.frombuffer(blob.as_buffer(), "<u4"), similarity)))
                many += len(held[-1][1])
                if many >= STEP_ROWS:
                    yield out()
                    many = 0
        if held:
            yield out()

    return run


def _groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[np.ndarray]]:
    """The columns, of which the first is sorted, in pieces that cut no run of equal values of it."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append([b.column(c).to_numpy() for c in columns])
        last = held[-1][0][-1]
        if held[0][0][0] != last:
            cols = [np.concatenate(c) for c in zip(*held)]
            cut = int(np.searchsorted(cols[0], last))
            yield [c[:cut] for c in cols]
            held = [[c[cut:] for c in cols]]
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _repeated_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, rid), sorted by key, of keys that occur more than once."""
    for key, rid in _groups(batches, ["key", "rid"]):
        same = key[1:] == key[:-1]
        more = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        yield pa.RecordBatch.from_arrays([pa.array(key[more]), pa.array(rid[more])], ["key", "rid"])


def _pairs_apart(similarity: float, leader: int | None):
    """Rows (key, rid, root, size, sketch in words), sorted by key, to pairs of one key and several roots whose sizes and sketches allow the similarity: with one member
    of the group, or (None) all."""
    tops = size_classes(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0

        def out() -> pa.RecordBatch:
            a, b = (np.concatenate(c) for c in zip(*held))
            held.clear()
            a, b = np.minimum(a, b), np.maximum(a, b)
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            fresh = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            return pa.RecordBatch.from_arrays([pa.array(a[fresh]), pa.array(b[fresh])], ["a", "b"])

        for key, rid, root, size, *words in _groups(batches, ["key", "rid", "root", "size", *SKETCH_WORDS]):
            bits, level, own = np.stack(words, 1).view(np.uint64), key & int(LEVEL), np.searchsorted(tops, size)
            cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            turn = np.concatenate([[0], np.cumsum(root[1:] != root[:-1])])
            cuts = [(lo, hi) for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()) if turn[hi - 1] > turn[lo]]  # of several roots
            for lo, hi in cuts:
                for k in range(lo, hi - 1) if leader is None else [lo + leader % (hi - lo)]:
                    other = np.arange(k + 1 if leader is None else lo, hi)
                    small, large = np.minimum(size[other], size[k]), np.maximum(size[other], size[k])
                    other = other[(root[other] != root[k]) & (small >= similarity * large) & (np.maximum(own[other], own[k]) == level[k])]
                    other = other[np.bitwise_count(bits[other] ^ bits[k]).sum(1) <= differing(size[other] + size[k], similarity)]
                    if len(other):
                        held.append((np.full(len(other), rid[k]), rid[other]))
                        many += len(other)
                    if many >= STEP_ROWS:
                        yield out()
                        many = 0
        if held:
            yield out()

    return run


SKETCH_WORDS = [f"s{k}" for k in range(SKETCH)]


def sketch_table(grams: DataFrame) -> DataFrame:
    """rid, size, words of the sketch, odd (the long sketch) for each row of ``grams``. A saved table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.frombuffer(g.as_buffer(), "<u4") for g in b.column("grams")]
            words = np.array([sketch(x) for x in sets], np.uint64).reshape(-1, SKETCH).view(np.int64)
            cols = [b.column("rid"), pa.array([len(x) for x in sets], pa.int32()), *[pa.array(words[:, k].copy()) for k in range(SKETCH)], pa.array([long_sketch(x).tobytes() for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["rid", "size", *SKETCH_WORDS, "odd"])

    return saved(grams.mapInArrow(run, "rid long, size int, " + ", ".join(f"{w} long" for w in SKETCH_WORDS) + ", odd binary"), "sketches")


#: Rounds in which each group of a key compares its members with one of them, before all that is still apart is compared.
LEADERS = 1


def connected(links: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    """(node, root) after those of ``links`` (a, b) that have the similarity, and every other link that has it. grams: a saved table of rid, grams.

    Rows of one set are one class. Keys that more than one class has are kept; members of such a key are compared unless they are connected already, first with
    one member each, as that connects most, then all with all: no size of a group ends the search.
    """
    spark, size = grams.sparkSession, table_bytes(grams)
    known = grams.select("rid", F.xxhash64("grams").alias("set"), (F.length("grams") / 4).cast("int").alias("size"))
    sets = saved(known.groupBy("set", "size").agg(F.min("rid").alias("first")), "sets")
    copies = saved(known.join(sets, ["set", "size"]).filter("rid <> first").select(F.col("first").alias("a"), F.col("rid").alias("b")), "copies")
    sketches = sketch_table(grams)
    links = saved(alike(links, grams, sketches, similarity).union(copies), "alike")
    roots = components(links)
    each = grams.join(copies.select(F.col("b").alias("rid")), "rid", "left_anti")
    keys = each.mapInArrow(_key_rows(similarity), "key long, rid long").repartition(tasks_for(spark, 2 * size), "key").sortWithinPartitions("key")
    keys = saved(keys.mapInArrow(_repeated_keys, "key long, rid long"), "keys")
    for leader in [*range(LEADERS), None]:
        known = sketches.drop("odd").join(roots.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
        rows = keys.join(known, "rid").select("key", "rid", "root", "size", *SKETCH_WORDS)
        rows = rows.repartition(tasks_for(spark, 2 * table_bytes(keys)), "key").sortWithinPartitions("key", "rid")
        pairs = saved(rows.mapInArrow(_pairs_apart(similarity, leader), "a long, b long").distinct(), "pairs-apart")
        more = saved(alike(pairs, grams, sketches, similarity), "alike")
        if more.take(1):
            links = links.union(more)
            roots = components(links)
    return roots


def similar_rows(docs: DataFrame, similarity: float = SIMILARITY, words: int = SIMILAR_WORDS, text: str = "text") -> DataFrame:
    """doc_id, digest, rid, root for each row of ``docs``: rows of one root are connected by links of ``similarity`` or more (Jaccard, over sets of shingles).

    Every such link counts, whether fingerprints find it or not. Rows without words are alike, rows of fewer words than a shingle have one shingle. Equal texts share a root. Null texts count as empty; null doc_ids and
    equal ones are rows of their own; an empty table gives an empty result; other columns are ignored. A text's shingles are held whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part, sets = b.slice(lo, 512), []
                fp = simhash(part.column("text").to_pylist(), words, sets)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("digest"), pa.array(fp.view(np.int64)), pa.array([s.astype("<u4").tobytes() for s in sets], pa.binary())], ["doc_id", "digest", "fp", "grams"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of(text)).alias("digest"), F.col(text).alias("text"))
    prints = saved(spread(rows).mapInArrow(run, "doc_id long, digest long, fp long, grams binary").withColumn("rid", F.monotonically_increasing_id()), "similar")
    classes = saved(prints.groupBy("fp").agg(F.min("rid").alias("first")), "similar-classes")
    ends = similar_candidates(classes.select("fp"), classes.count()).join(classes.select(F.col("fp").alias("a"), F.col("first").alias("ra")), "a").join(classes.select(F.col("fp").alias("b"), F.col("first").alias("rb")), "b")
    within = prints.select("fp", "rid").join(classes, "fp").filter("rid <> first").select(F.col("first").alias("a"), F.col("rid").alias("b"))
    links = saved(ends.select(F.col("ra").alias("a"), F.col("rb").alias("b")).union(within), "candidates")  # a table: AQE splits hot classes
    grams = prints.select("rid", "grams")
    roots = connected(links, grams, similarity)
    return prints.select("doc_id", "digest", "rid").join(roots.withColumnRenamed("node", "rid"), "rid", "left").select("doc_id", "digest", "rid", F.coalesce("root", "rid").alias("root"))


def one_of_similar(docs: DataFrame, similarity: float = SIMILARITY, words: int = SIMILAR_WORDS, text: str = "text") -> DataFrame:
    """Of the rows of ``docs`` that similarity connects the one with the smallest doc_id (null last, then the first row), with all its columns."""
    with shuffles_dropped(docs.sparkSession):
        found = saved(similar_rows(docs, similarity, words, text), "near")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "rid", "digest")).alias("f")).select("f.doc_id", "f.digest")
    repeated = bool(found.groupBy("doc_id", "digest").count().filter("count > 1").take(1))
    return keep_rows(docs, first, {"doc_id": F.col("doc_id").cast("long"), "digest": F.xxhash64(text_of(text))}, repeated, text_of(text))


def one_of_each(docs: DataFrame, most: int = BITS, text: str = "text") -> DataFrame:
    """Of each component of ``docs`` the row with the smallest doc_id, with all its columns. Components without doc_ids, or with equal ones, stay apart."""
    found = saved(component_rows(docs, most, text), "near")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "fp", "digest")).alias("f")).select("f.doc_id", "f.digest")
    repeated = bool(found.groupBy("doc_id", "digest").count().filter("count > 1").take(1))
    return keep_rows(docs, first, {"doc_id": F.col("doc_id").cast("long"), "digest": F.xxhash64(text_of(text))}, repeated, text_of(text))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(documents(spark, sf_dir))


QUERIES = {"op6_simhash": op6_simhash}
ORACLE: dict = {}
