"""Mixing sources to target weights by min-cost flow over membership patterns.

1. Each document has a set of sources (its membership pattern). Tokens are summed by pattern, and by pattern and
   slice of a seeded hash, with map-side combine.
2. On the driver, over patterns and sources only: every source gets a token quota; every pattern offers its tokens once for
   each pass, pass k (0, 1, ...) at cost k, so that repeating is convex in cost; a min-cost maximum flow routes capacity
   to quotas, taking fresh documents before repeats.
3. In each pass a pattern's documents are taken in seeded order, past those larger than what is left of its flow, until none fits;
   the tokens that remain are met by the one untaken document whose size comes nearest. Only slices in which a document
   doesn't fit are walked row by row (1/4096 of a pattern's rows or, in large tables, about the root of their number); all other rows are
   decided by their slice and size alone, so a hot source needs neither a shuffle nor one task.

Where every document has one source, as in the query and the pipeline (their contract gives a document the target of its own source), no two patterns
compete for a quota, and the flow of a pattern is the lesser of its quota and what its passes offer. Overlapping sources are given by ``members``.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from deskdb.llm.common import documents, saved, text_of

#: Slices of the seeded order, by the hash's leading bits: so many bits at least, and more so that slices are about as many as a slice's rows.
SLICE_BITS = 12
#: Rows behind a slice that are walked together with it.
ROWS_TOGETHER = 4_096
#: Places from (lo_u, lo_size, lo_rid) to (hi_u, hi_size, hi_rid), both included, in the seeded order; documents of ``most`` words at most.
SPAN = "struct<lo_u: long, lo_size: long, lo_rid: long, hi_u: long, hi_size: long, hi_rid: long, most: long>"
SPANS = f"n int, span {SPAN}, tokens long"
#: Rows of the per-pattern tables up to which they are broadcast; beyond it they are joined by a shuffle (AQE splits hot keys).
BROADCAST_ROWS = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def quotas(sizes: dict, weights: dict, share: float, most: float) -> dict:
    """share of all sizes by weight; a quota stops at ``most`` times its source's size, and the excess is shared by weight among the others."""
    total, capped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in capped]
        left, weight = total - sum(capped.values()), sum(weights[s] for s in free)
        if not weight:
            return {s: capped.get(s, 0.0) for s in sizes}
        over = [s for s in free if left * weights[s] / weight > most * sizes[s]]
        if not over:
            return {s: capped[s] if s in capped else left * weights[s] / weight for s in sizes}
        capped |= {s: float(most * sizes[s]) for s in over}


def min_cost_flow(offers: dict[tuple, int], needs: dict, passes: int) -> dict[tuple, int]:
    """(pattern, pass, source) -> tokens. Successive shortest paths; a pattern (tuple of sources) offers ``offers`` tokens in each pass at cost pass."""
    graph: dict = {}

    def edge(a, b, cap, cost):
        graph.setdefault(a, {})[b] = [cap, cost]
        graph.setdefault(b, {}).setdefault(a, [0, -cost])

    for p, n in offers.items():
        for k in range(passes):
            edge("from", (p, k), n, k)
            for s in p:
                edge((p, k), ("source", s), n, 0)
    for s, n in needs.items():
        edge(("source", s), "to", n, 0)
    while "from" in graph and "to" in graph:
        cost, before, queue, queued = {"from": 0}, {}, deque(["from"]), {"from"}
        while queue:
            a = queue.popleft()
            queued.discard(a)
            for b, (cap, c) in graph[a].items():
                if cap > 0 and cost[a] + c < cost.get(b, 1 << 60):
                    cost[b], before[b] = cost[a] + c, a
                    if b not in queued:
                        queue.append(b)
                        queued.add(b)
        if "to" not in cost:
            break
        path, b = [], "to"
        while b != "from":
            path.append((before[b], b))
            b = before[b]
        push = min(graph[a][b][0] for a, b in path)
        for a, b in path:
            graph[a][b][0] -= push
            graph[b][a][0] += push
    return {(p, k, s): f for p in offers for k in range(passes) for s in p if (f := graph[("source", s)].get((p, k), [0])[0]) > 0}


def words(text: str | Column = "text") -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def weigh(sources: list) -> dict:
    """Weights 3, 1, 2, repeating, in code-point order, null last."""
    named = sorted((s for s in sources if s is not None), key=lambda s: s.encode()) + [None] * (None in sources)
    return {s: float((3, 1, 2)[k % 3]) for k, s in enumerate(named)}


def _span(lo: int, hi: int, most: int, bits: int) -> tuple:
    """The slices from ``lo`` to before ``hi``, as a span."""
    return (lo << 63 - bits, -1, -1, (hi << 63 - bits) - 1, (1 << 63) - 1, (1 << 63) - 1, most)


def _first_fits(rows: pd.DataFrame) -> pd.DataFrame:
    """Takes rows in seeded order, past those that don't fit what is left; a new span begins where one doesn't fit that is within the span's size."""
    rows = rows.sort_values(["u", "size", "rid"])
    n, left, out = int(rows["n"].iloc[0]), int(rows["rest"].iloc[0]), []
    most, first, last, tokens = left, None, None, 0
    for place in zip(rows["u"].tolist(), rows["size"].tolist(), rows["rid"].tolist()):
        size = place[1]
        if left < size <= most:
            if tokens:
                out.append((n, (*first, *last, most), tokens))
            most, first, tokens = left, None, 0
        if size <= most:
            first, last, left, tokens = first or place, place, left - size, tokens + size
    if tokens:
        out.append((n, (*first, *last, most), tokens))
    return pd.DataFrame(out, columns=["n", "span", "tokens"])


def mix(docs: DataFrame, members: Column | None = None, share: float = 1.5, most: int = 2, weights: dict | None = None, seed: int = 11) -> DataFrame:
    """One row per row of ``docs``: doc_id, crc (of the text), rid, size, pattern, source (null in a mixed pattern), source_size, target, taken, passes.

    ``members``: an array of sources, several for a document in overlapping sources; by default the array of its one source. A null
    source is a source of its own. size: words (null text: 0). taken = passes * size, passes 0 to ``most``. A repeated row counts as a document
    of its own; ties in the seeded order are broken by size and row. Documents of size 0 are never taken. Empty tables
    give an empty result. Other columns are ignored. Patterns and sources go to the driver, documents never.
    """
    spark = docs.sparkSession
    members = members if members is not None else F.array("source")
    crc = F.crc32(text_of().cast("binary"))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.array_sort(F.array_distinct(members)).alias("pattern"), words().alias("size"), crc.alias("crc"), F.xxhash64("doc_id", crc, F.lit(seed)).alias("u"))
    rows = saved(rows.withColumn("u", F.shiftrightunsigned("u", 1)), "mix")
    bits = max(SLICE_BITS, rows.count().bit_length() // 2)
    rows = rows.withColumn("slice", F.shiftright("u", 63 - bits).cast("int"))
    sums = saved(rows.groupBy("pattern", "slice").agg(F.sum("size").alias("tokens")), "mix-slices")
    offers = {tuple(r["pattern"]): int(r["tokens"]) for r in sums.groupBy("pattern").agg(F.sum("tokens").alias("tokens")).collect()}
    sizes: dict = {}
    for p, n in offers.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    target = quotas(sizes, weights or weigh(list(sizes)), share, most)
    flow = min_cost_flow(offers, {s: int(t + 0.5) for s, t in target.items()}, most)

    held = lambda data, schema: (lambda d: F.broadcast(d) if len(data) <= BROADCAST_ROWS else d)(spark.createDataFrame(data, schema))
    plan = [(p, k, n) for p in offers for k in range(most) if (n := sum(flow.get((p, k, s), 0) for s in p))]
    # spans of the seeded order of each pattern and pass, of which the documents up to some size are taken; what remains; the next slice
    spans: dict = {(p, k): [] for p, k, _ in plan}
    rest, ahead = {(p, k): n for p, k, n in plan}, {(p, k): 0 for p, k, _ in plan}
    going = list(spans)
    while going:
        openings = held([(n, list(key[0]), ahead[key], rest[key]) for n, key in enumerate(going)], "n int, pattern array<string>, ahead int, rest long")
        fits = rows.join(openings, "pattern").filter("size > 0 and size <= rest and slice >= ahead")
        upto = fits.groupBy("n", "rest", "slice").agg(F.sum("size").alias("tokens"), F.count(F.lit(1)).alias("many"))
        order = W.partitionBy("n").orderBy("slice")
        upto = upto.withColumn("end", F.sum("tokens").over(order)).withColumn("count", F.sum("many").over(order))
        first = upto.groupBy("n").agg(F.min(F.when(F.col("end") > F.col("rest"), F.struct("slice", (F.col("end") - F.col("tokens")).alias("start"), "count"))).alias("c"), F.max("end").alias("end"))
        cut = {}
        for r in first.collect():
            key, c = going[r["n"]], r["c"]
            spans[key].append(_span(ahead[key], c["slice"] if c else 1 << bits, rest[key], bits))
            rest[key] -= c["start"] if c else r["end"]
            if c and rest[key]:
                cut[r["n"]] = c
        if not cut:
            break
        # on from the slice that doesn't fit whole, row by row: that slice, and those behind it while there are few rows
        cuts = held([(n, c["slice"], c["count"]) for n, c in cut.items()], "n int, cut int, seen long")
        last = upto.join(cuts, "n").filter(f"slice = cut or (slice > cut and count <= seen + {ROWS_TOGETHER})").groupBy("n").agg(F.max("slice").alias("last"))
        lasts = {r["n"]: r["last"] for r in last.collect()}
        inner = held([(n, list(going[n][0]), c["slice"], lasts[n], rest[going[n]]) for n, c in cut.items()], "n int, pattern array<string>, cut int, last int, rest long")
        inside = rows.join(inner, "pattern").filter("size > 0 and size <= rest and slice between cut and last").select("n", "u", "size", "rid", "rest")
        for r in inside.groupBy("n").applyInPandas(_first_fits, SPANS).collect():
            key = going[r["n"]]
            spans[key].append(tuple(r["span"]))
            rest[key] -= r["tokens"]
        for n in cut:
            ahead[going[n]] = lasts[n] + 1
        going = [going[n] for n in sorted(cut) if rest[going[n]] and ahead[going[n]] < 1 << bits]
    # the untaken document that comes nearest to what is left, if it is nearer than none
    place = F.struct("u", "size", "rid")
    within = lambda all_: F.exists(all_, lambda m: (F.col("size") <= m["most"]) & (place >= F.struct(m["lo_u"].alias("u"), m["lo_size"].alias("size"), m["lo_rid"].alias("rid"))) & (place <= F.struct(m["hi_u"].alias("u"), m["hi_size"].alias("size"), m["hi_rid"].alias("rid"))))
    short = held([(list(p), k, rest[p, k], spans[p, k]) for p, k in spans if rest[p, k]], f"pattern array<string>, pass int, rest long, spans array<{SPAN}>")
    near = rows.join(short, "pattern").filter((F.col("size") > 0) & (F.col("size") < 2 * F.col("rest")) & ~within(F.col("spans")))
    near = near.groupBy("pattern", "pass").agg(F.min(F.struct(F.abs(F.col("size") - F.col("rest")).alias("d"), "u", "size", "rid")).alias("n"))
    extra = {(tuple(r["pattern"]), r["pass"]): r["n"]["rid"] for r in near.collect()}
    info = [(list(p), p[0] if len(p) == 1 else None, sizes[p[0]] if len(p) == 1 else offers[p], float(target[p[0]]) if len(p) == 1 else None, [(spans.get((p, k), []), extra.get((p, k), -1)) for k in range(most)]) for p in offers]
    info = held(info, f"pattern array<string>, source string, source_size long, target double, passes array<struct<spans: array<{SPAN}>, extra: long>>")
    joined = rows.join(info, "pattern")
    one = lambda m: F.when((F.col("size") > 0) & (within(m["spans"]) | (F.col("rid") == m["extra"])), 1).otherwise(0)
    times = sum((one(F.col("passes")[k]) for k in range(most)), F.lit(0))
    return joined.withColumn("times", times).select("doc_id", "crc", "rid", "pattern", "source", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"), F.col("times").alias("passes"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of the mix, with all columns of ``docs``: a row as often as the mix takes it."""
    key = {"__dd_id": F.col("doc_id").cast("long"), "__dd_crc": F.crc32(text_of().cast("binary"))}
    found = saved(mix(docs, **how).groupBy(F.col("doc_id").alias("__dd_k"), F.col("crc").alias("__dd_c")).agg(F.sum("passes").cast("int").alias("__dd_n"), F.count(F.lit(1)).alias("__dd_rows")), "mixed")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__dd_row"), *[c.alias(k) for k, c in key.items()])
    taken = own.join(found.filter("__dd_n > 0").hint("shuffle_hash"), F.col("__dd_id").eqNullSafe(F.col("__dd_k")) & (F.col("__dd_crc") == F.col("__dd_c")))
    if found.filter("__dd_rows > 1").take(1):  # repeated rows share what the mix takes of them
        taken = taken.groupBy("__dd_id", "__dd_crc", "__dd_n").agg(F.min("__dd_row").alias("__dd_row"))
    return taken.withColumn("__dd_k", F.explode(F.sequence(F.lit(1), F.col("__dd_n")))).select("__dd_row.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source")


QUERIES = {"op3_mixing": op3_mixing}
ORACLE: dict = {}
